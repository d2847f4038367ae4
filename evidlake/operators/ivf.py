"""A stored vector index: an inverted file of coarse cells, with a byte a component beside each vector.

Centres are fitted on about SAMPLE rows; each row lies in the cell of its nearest centre, and the index is
a Parquet table partitioned by cell, with each cell's centre, radius and count in a small table beside it.
A row has its vector, and for the search a code of one byte for each component of the unit vector together
with the code's error, so that a code bounds the row's cosine from both sides. A search has three steps:
the codes of the FIRST_CELLS nearest cells give each query a floor, its k-th best lower bound; codes of all
cells whose bound (distance of the centre less the radius) reaches that floor leave the rows that can be
among the k best; only these are read as vectors and ranked by their exact cosine. That is exact. With
`probes`, only so many nearest cells are met, which is not, and is for the caller to measure.

Rows without id or with a null, zero or non-finite vector are not in the index; such queries find nothing.
Repeated ids count as rows of their own. Ties go to the smaller id.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..plans import new_folder, settle, small
from .vector import _read_block

SAMPLE = 16_384
MOST_CELLS = 1024
ROUNDS = 8
FIRST_CELLS = 8
QUERY_BLOCK = 1024
SLICE_ROWS = 2048
#: Most rows of cells or candidates that are sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_QUERIES = 10_000


@dataclass
class Cells:
    """What tasks know of an index."""

    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    def distances(self, unit: np.ndarray) -> np.ndarray:
        """Of each unit query from each cell's centre."""
        return np.sqrt(np.maximum(0.0, (unit * unit).sum(axis=1)[:, None] - 2.0 * unit @ self.centres.T + (self.centres**2).sum(axis=1)))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each unit query and cell, a cosine that no row of the cell exceeds."""
        gap = self.distances(unit) - self.radii
        return np.where(self.counts > 0, 1.0 - np.maximum(0.0, gap - 1e-9) ** 2 / 2 + 1e-9, -np.inf)


@dataclass
class InvertedFile:
    rows: DataFrame
    cells: Cells
    folder: str


def usable(v: Column) -> Column:
    """Whether a vector of doubles can be compared."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) != dim * len(column):
        raise ValueError(f"a vector has another length than {dim}")
    x = flat.reshape(len(column), dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    c = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(ROUNDS):
        at = (c * c).sum(axis=1)[None] - 2.0 * sample @ c.T
        at = at.argmin(axis=1)
        for j in np.unique(at):
            c[j] = sample[at == j].mean(axis=0)
    return c


def build(rows: DataFrame, folder: str, *, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None) -> InvertedFile:
    """Writes the index of all rows into a folder; `cells` is the square root of the rows, up to MOST_CELLS, by default."""
    spark = rows.sparkSession
    table = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = table.count()
    share = min(1 << 30, math.ceil(SAMPLE / max(1, n) * (1 << 30)))
    picked = table.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy("id", "v").collect() or table.limit(1).collect()
    dim = len(picked[0].v) if picked else 0
    some = np.array([r.v for r in picked], dtype=np.float64).reshape(len(picked), dim)
    some = some / np.linalg.norm(some, axis=1)[:, None] if len(some) else some
    centres = _centres(some, max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, len(some)))) if len(some) else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(i, SLICE_ROWS)
                unit = _units(batch.column("v"), dim)
                d = (unit * unit).sum(axis=1)[:, None] - 2.0 * unit @ centres.T + (centres**2).sum(axis=1)
                cell = d.argmin(axis=1)
                step = np.abs(unit).max(axis=1) / 127
                code = np.rint(unit / step[:, None]).astype(np.int8)
                error = np.linalg.norm(unit - code * step[:, None], axis=1) * (1 + 1e-9) + 1e-12
                far = np.sqrt(np.maximum(0.0, d[np.arange(len(d)), cell]))
                out = {"id": batch.column("id"), "v": batch.column("v"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "step": pa.array(step), "error": pa.array(error), "far": pa.array(far), "cell": pa.array(cell.astype(np.int32))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = table.schema["id"].dataType.simpleString()
    placed = table.mapInArrow(assign, f"id {kind}, v array<double>, code binary, step double, error double, far double, cell int")
    # Hashing the id beside the cell spreads a hot cell over several files.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(posixpath.join(folder, "rows"))
    stored = _stored(spark, folder, kind)
    found = {r.cell: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # at most MOST_CELLS rows
    meta = [(j, int(found[j].n) if j in found else 0, float(found[j].radius) if j in found else 0.0, c.tolist()) for j, c in enumerate(centres)]
    spark.createDataFrame(meta, "cell int, n long, radius double, centre array<double>").coalesce(1).write.parquet(posixpath.join(folder, "cells"))
    return load(spark, folder)


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id {kind}, v array<double>, code binary, step double, error double, far double, cell int").parquet(posixpath.join(folder, "rows"))


def load(spark: SparkSession, folder: str) -> InvertedFile:
    meta = spark.read.parquet(posixpath.join(folder, "cells")).orderBy("cell").collect()
    dim = len(meta[0].centre) if meta else 0
    cells = Cells(np.array([r.centre for r in meta], dtype=np.float64).reshape(len(meta), dim), np.array([r.radius for r in meta]), np.array([r.n for r in meta]))
    return InvertedFile(spark.read.parquet(posixpath.join(folder, "rows")) if len(meta) else None, cells, folder)


def _scan(cells: Cells, k: int, probes: int | None, floors: bool):
    """Batches of (id, cell, code, step, error, block) to (q, u, id, low, high): with `floors`, rows that can beat their query's; else the k best of its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict = {}
        for mixed in batches:
            for uri in mixed.column("block").unique().to_pylist():
                if uri not in read:
                    t = _read_block(uri)
                    unit = np.array(t.column("v").to_pylist(), dtype=np.float64).reshape(len(t), -1)
                    unit = unit / np.linalg.norm(unit, axis=1)[:, None] if len(t) else unit
                    bound = cells.bounds(unit) if len(t) else np.zeros((0, len(cells.counts)))
                    far = np.where(cells.counts > 0, cells.distances(unit), np.inf) if len(t) else bound
                    rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
                    wanted = rank < (probes or FIRST_CELLS)
                    floor = np.full(len(t), -np.inf)
                    if floors:
                        floor = np.array([-np.inf if x is None else x for x in t.column("floor").to_pylist()])
                        wanted = (wanted if probes else np.isfinite(bound)) & (bound >= floor[:, None])
                    read[uri] = (t, unit, wanted, floor)
                t, unit, wanted, floor = read[uri]
                at = np.flatnonzero(np.asarray(mixed.column("block").to_numpy(zero_copy_only=False) == uri))
                cell = mixed.column("cell").to_numpy()[at]
                for c in np.unique(cell):
                    asked = np.flatnonzero(wanted[:, c]) if len(t) else []
                    mine = at[cell == c]
                    for i in range(0, len(mine) if len(asked) else 0, SLICE_ROWS):
                        rows = mixed.take(pa.array(mine[i : i + SLICE_ROWS]))
                        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1)
                        near = unit[asked] @ (code * rows.column("step").to_numpy()[:, None]).T
                        error = rows.column("error").to_numpy() + 1e-9
                        low, high = near - error, near + error
                        least = floor[asked]
                        if rows.num_rows > k:
                            least = np.maximum(least, np.partition(low, rows.num_rows - k, axis=1)[:, rows.num_rows - k])
                        q, r = np.nonzero(high >= least[:, None])
                        if len(q):
                            who = pa.array(np.asarray(asked)[q])
                            yield pa.RecordBatch.from_arrays([t.column("q").combine_chunks().take(who), t.column("u").combine_chunks().take(who), rows.column("id").take(pa.array(r)), pa.array(low[q, r]), pa.array(high[q, r])], names=["q", "u", "id", "low", "high"])

    return run


def _files(asked: DataFrame, n: int) -> list[str]:
    folder = new_folder(asked.sparkSession, "queries")
    asked.repartition(max(1, math.ceil(n / QUERY_BLOCK)), "q", "u").write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(folder)
    return asked.sparkSession.read.parquet(folder).inputFiles()


def topk(index: InvertedFile, queries: DataFrame, k: int, *, query_id: str = "qid", id_col: str = "chunk_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of every query by cosine; exact unless `probes` says how many cells to meet."""
    if k <= 0 or (probes is not None and probes <= 0):
        raise ValueError("k and probes must be positive")
    spark, qkind = queries.sparkSession, queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("q"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v"))).distinct().withColumn("u", F.xxhash64("v"))
    asked = settle(asked)
    n = asked.count()
    if not n or index.rows is None:
        return spark.createDataFrame([], f"{query_id} {qkind}, {id_col} string, score double, rank int")
    kind = index.rows.schema["id"].dataType.simpleString()
    held = index.rows.select("id", "cell", "code", "step", "error")
    out = f"q {qkind}, u bigint, id {kind}, low double, high double"

    def scanned(df: DataFrame, floors: bool) -> DataFrame:
        files = _files(df, n)
        blocks = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in files], len(files)), "block string")
        # With this hint a task has one partition of rows and one of the blocks, not all blocks at once.
        return held.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(_scan(index.cells, k, probes, floors), out)

    by_low = Window.partitionBy("q", "u").orderBy(F.desc("low"))
    kth = scanned(asked, False).withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k).groupBy("q", "u").agg(F.when(F.count("*") == k, F.min("low")).alias("floor"))
    kth = settle(kth.withColumnsRenamed({"q": "fq", "u": "fu"}))
    floors = asked.join(small(kth, BROADCAST_ROWS), F.col("q").eqNullSafe(F.col("fq")) & (F.col("u") == F.col("fu")), "left").select("q", "u", "v", "floor")
    found = scanned(floors, True)
    candidates = settle(found.withColumn("n", F.row_number().over(by_low)).withColumn("kth", F.min(F.when(F.col("n") <= k, F.col("low"))).over(Window.partitionBy("q", "u"))).where("high >= kth").select("q", "u", "id").distinct())
    # A cell's vectors are read where they may be among the best: the candidates are few and go to the rows.
    rows = index.rows.select("id", F.col("v").alias("rv")).join(small(candidates, BROADCAST_ROWS), "id")
    by_query = small(asked.select(F.col("q").alias("aq"), F.col("u").alias("au"), F.col("v").alias("av")), BROADCAST_QUERIES)
    pairs = rows.join(by_query, F.col("q").eqNullSafe(F.col("aq")) & (F.col("u") == F.col("au"))).select("q", "u", "id", cosine(F.col("rv"), F.col("av")).alias("score"))
    w = Window.partitionBy("q", "u").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
