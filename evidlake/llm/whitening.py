"""Embedding whitening by a tiled covariance.

Components c become integers x = floor(1024 c) + 100000. One pass counts the rows and adds up x for each
dimension; a second one centres x at the nearest integer to its mean and cuts rows into row blocks and
dimensions into column blocks. Pairs of column blocks are the tiles of the covariance: column blocks are
shuffled by row block, meet there as pairs, and are multiplied; products are added up for each tile, in
the task, then over salted groups, then over all. Everything up to here is exact integers, so nothing
depends on how the rows lie, and the mean of x, large against its spread, takes no digits away. The
driver assembles the tiles (dimensions squared numbers, whatever the rows), corrects for the part of the
mean below one, and takes eigenvectors. A last pass projects the rows, and the covariance of what it
wrote is measured in Spark.

Edge cases: rows whose vector is null or holds a null or non-finite component take no part; an id may be
null or repeat, every row counts; an empty table gives no rows; with fewer dimensions than components
asked for there are as many components as dimensions; a component without variance (at or below rounding
of the largest: constant dimensions, fewer rows than dimensions) has a null `whitened` and is left out of
`identity_error`, and where nothing has variance `explained` and `identity_error` are null; equal
eigenvalues have any orthonormal directions; an eigenvector's entry of largest size is positive; a
deviation of more than 38 digits is null. Vectors of several lengths and components of 1,000,000 or more
are errors. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, give_back, new_folder
from .vectors import kept_vectors, matrix, whole

OFFSET = 100_000
COMPONENTS = 8
#: Columns of a tile at least; wide vectors have at most MOST_TILES column blocks.
TILE = 32
MOST_TILES = 16
BLOCK_ROWS = 4096
#: Bytes of tile sums that a task holds before it sends them on.
HELD_BYTES = 64 << 20
SALTS = 32
LARGEST = 1_000_000 << 10


@dataclass
class Whitening:
    """What a fit knows: rows, sums of x, the eigenvalues (falling) and unit eigenvectors (columns) of x's covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the mean has beyond the centre."""
        return [s - self.n * m for s, m in zip(self.sums, self.centre, strict=True)]

    def varied(self) -> np.ndarray:
        """Which components have variance above rounding."""
        e = self.values
        return e > (len(e) * np.finfo(float).eps * e[0] if len(e) else 0.0)


def _integers(column: pa.Array, dim: int | None = None) -> np.ndarray:
    return whole(matrix(column, dim), LARGEST) + OFFSET


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch.column("v"), None if sums is None else len(sums))
            n, sums = n + len(x), x.sum(axis=0).astype(object) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0)))], names=["n", "sums"])


def _column_blocks(centre: list[int], tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                z = (_integers(batch.column("v").slice(i, BLOCK_ROWS), len(centre)) - np.array(centre, dtype=np.int64)).astype(np.int32)
                starts = range(0, len(centre), tile)
                parts = [np.ascontiguousarray(z[:, s : s + tile]).tobytes() for s in starts]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(parts), pa.int64()), "tile": pa.array(range(len(parts)), pa.int32()), "rows": pa.array([len(z)] * len(parts), pa.int32()), "z": pa.array(parts, pa.binary())})
                block += 1
            give_back()

    return run


def exact_products(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Integer matrices whose sum is a' b: one product in doubles where they hold it exactly, else pieces that fit 64 bits."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top * len(a) < 1 << 53:
        yield (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return
    a, b, step = a.astype(np.int64), b.astype(np.int64), max(1, (1 << 62) // top)
    for i in range(0, len(a), step):
        yield a[i : i + step].T @ b[i : i + step]


TILE_KIND = "a int, b int, hi binary, lo binary, salt int"


def _tile_rows(held: dict, salt: int) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_pydict({
        "a": pa.array([k[0] for k in keys], pa.int32()), "b": pa.array([k[1] for k in keys], pa.int32()),
        "hi": pa.array([held[k][0].tobytes() for k in keys], pa.binary()), "lo": pa.array([held[k][1].tobytes() for k in keys], pa.binary()),
        "salt": pa.array([salt] * len(keys), pa.int32()),
    })


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of column blocks to sums of their products for each tile; a sum is kept as its high bits and its low 32."""
    held, size, salt = {}, 0, TaskContext.get().partitionId() % SALTS
    for batch in batches:
        for a, b, rows, za, zb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "rows", "za", "zb")], strict=True):
            left, right = (np.frombuffer(z, np.int32).reshape(rows, -1) for z in (za, zb))
            for product in exact_products(left, right):
                if (a, b) not in held:
                    held[a, b] = np.zeros((2, *product.shape), np.int64)
                    size += held[a, b].nbytes
                held[a, b][0] += product >> 32
                held[a, b][1] += product & 0xFFFFFFFF
            if size > HELD_BYTES:
                yield _tile_rows(held, salt)
                held, size = {}, 0
        give_back()
    if held:
        yield _tile_rows(held, salt)


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for a, b, hi, lo in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "hi", "lo")], strict=True):
            more = np.stack([np.frombuffer(x, np.int64) for x in (hi, lo)])
            held[a, b] = held[a, b] + more if (a, b) in held else more
    if held:
        yield _tile_rows(held, 0)


def _summed(parts: DataFrame) -> list[tuple[int, list[int]]]:
    total = parts.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
    return [(r.n, int(r.total)) for r in total.orderBy("pos").collect()]


def fit(table: DataFrame, tile: int = TILE) -> Whitening | None:
    """The whitening of a frame of vectors `v`; None without rows."""
    spark = table.sparkSession
    sums = _summed(table.select("v").mapInArrow(_add_up, "n bigint, sums array<decimal(38,0)>"))
    if not sums:
        return None
    n, dim = sums[0][0], len(sums)
    if any(m != n for m, _ in sums):
        raise ValueError("vectors of several lengths")
    out = Whitening(n, [s for _, s in sums], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    tile = max(tile, -(-dim // MOST_TILES))
    folder = new_folder(spark, "columns")
    table.select("v").mapInArrow(_column_blocks(out.centre, tile), "block bigint, tile int, rows int, z binary").write.parquet(folder)
    blocks = spark.read.parquet(folder)
    left = blocks.select("block", F.col("tile").alias("a"), "rows", F.col("z").alias("za"))
    right = blocks.select("block", F.col("tile").alias("b"), F.col("z").alias("zb"))
    products = left.join(right, "block").where("a <= b").select("a", "b", "rows", "za", "zb").mapInArrow(_multiply, TILE_KIND)
    salted = products.repartition("a", "b", "salt").mapInArrow(_add_tiles, TILE_KIND)
    square = np.zeros((dim, dim))
    for r in salted.repartition("a", "b").mapInArrow(_add_tiles, TILE_KIND).collect():
        i, j = r.a * tile, r.b * tile
        shape = (min(tile, dim - i), min(tile, dim - j))
        hi, lo = (np.frombuffer(x, np.int64).reshape(shape).astype(np.float64) for x in (r.hi, r.lo))
        square[i : i + shape[0], j : j + shape[1]] = hi * 2.0**32 + lo
        square[j : j + shape[1], i : i + shape[0]] = square[i : i + shape[0], j : j + shape[1]].T
    discard(spark, folder)
    beyond = np.array([r / n for r in out.rest])
    out.covariance = square / n - np.outer(beyond, beyond)
    values, vectors = np.linalg.eigh(out.covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)])
    out.values, out.vectors = values, vectors * np.where(signs == 0, 1.0, signs)
    return out


def deviations(z: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Sums over dimensions of (n x - S)^2, exactly: in 64 bits where they fit, else in Python's integers."""
    kind = pa.decimal128(38, 0)
    most = n * int(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * max(1, z.shape[1]) < 1 << 63:
        y = n * z - np.array(rest, dtype=np.int64)
        return pa.array((y * y).sum(axis=1, dtype=np.int64)).cast(kind)
    y = n * z.astype(object) - np.array(rest, dtype=object)
    return pa.array([Decimal(int(s)) if s < 10**38 else None for s in (y * y).sum(axis=1)], kind)


def _project(w: Whitening, components: int):
    centre, rest, n = np.array(w.centre, dtype=np.int64), w.rest, w.n
    has = w.varied()[:components]
    axes = w.vectors[:, :components] / np.sqrt(np.where(has, w.values[:components], 1.0))
    beyond = np.array([r / n for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                z = _integers(part.column("v"), len(centre)) - centre
                out = (z - beyond) @ axes
                flat = pa.array(out.reshape(-1), mask=np.tile(~has, len(out)))
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("id"), deviations(z, n, rest), pa.ListArray.from_arrays(offsets, flat)], names=["id", "deviation", "whitened"])
            give_back()

    return run


def _identity_error(rows: DataFrame, components: list[int], n: int) -> float | None:
    """The largest absolute entry of the covariance of what was written, less the identity."""
    if not components:
        return None
    w = [F.col("whitened")[k] for k in components]
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    r = rows.agg(*[F.sum(x) for x in w], *[F.sum(w[i] * w[j]) for i, j in pairs]).first()
    mean = [x / n for x in r[: len(w)]]
    return max(abs(s / n - mean[i] * mean[j] - (i == j)) for (i, j), s in zip(pairs, r[len(w) :], strict=True))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """(id, component int, n long, deviation decimal, whitened double, explained double, identity_error double) for each row and component."""
    if components < 1 or tile < 1:
        raise ValueError("1 component and 1 column a tile at least")
    spark, table = rows.sparkSession, kept_vectors(rows, vec_col, id=id_col)
    kind, w = table.schema["id"].dataType.simpleString(), fit(table, tile)
    if w is None or not len(w.values):
        return spark.createDataFrame([], f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    folder = new_folder(spark, "whitened")
    table.mapInArrow(_project(w, components), f"id {kind}, deviation decimal(38,0), whitened array<double>").write.parquet(folder)
    done = spark.read.parquet(folder)
    error = _identity_error(done, [int(k) for k in np.flatnonzero(w.varied()[:components])], w.n)
    trace = float(np.trace(w.covariance))
    explained = [max(0.0, float(e)) / trace if trace > 0 else None for e in w.values[:components]]
    each = done.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.array(*[F.lit(x).cast("double") for x in explained])[F.col("k")]
    return each.select("id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
