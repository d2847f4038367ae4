"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has a codebook of its own, fitted on about SAMPLE rows that a hash of the id picks;
a row's cell is the pair of its nearest entries, so K entries a half make K * K cells. All rows are
indexed. A query walks the pairs of entries in order of their summed squared distances with a heap until
the cells it has met hold `effort` rows, and only rows of these cells are compared, on the original
vectors in double precision. The effort is measured, not guessed: the true neighbours of CALIBRATE
queries (picked by a hash, found by comparing them with all rows) must be met with the share `recall`;
it is never less than LEAST_EFFORT rows. With `exact` the cells that were not met are bounded by their
radii, and those that could hold a nearer row are searched as well: then nothing is missed.

In Spark, neighbouring cells make a part of about PART_ROWS rows; rows are written in blocks by part, and a
query is sent once to each part with a cell that it met, in packs of queries. Blocks and packs meet in a
join by part, which Spark splits where a part is large (a hot cell is a part of many blocks); a task
holds one block and one pack. Equal vectors are one: of a vector's ids only the k + 1 smallest can be
among anyone's k nearest, and queries with equal vectors are searched once. The driver holds codebooks,
a count and two radii for each cell (at most MOST_ENTRIES squared), and what it calibrates with.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
with a null id; rows that repeat id and vector count once; an id with several vectors has the least of
them, by components; ties go to the smaller id; a query finds all candidates if there are fewer than k,
and none if it is alone; a distance that overflows is infinite; without queries or rows there are no
results. Vectors of several lengths are an error. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, settle, stored
from .vectors import kept_vectors, matrix

SAMPLE = 16_384
CALIBRATE = 64
RECALL = 0.95
LEAST_EFFORT = 4096
#: Rows that a cell should have, and most entries of a half's codebook.
CELL_ROWS = 32
MOST_ENTRIES = 256
PART_ROWS = 8192
BLOCK_BYTES = 1 << 20
PACK_QUERIES = 256
LLOYD_ROUNDS = 8
SLICE_ROWS = 2048

FOUND = "q bigint, id bigint, score double"


@dataclass
class Cells:
    """What tasks know of an index: the two codebooks; counts and radii by cell."""

    dim: int
    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: np.ndarray

    @property
    def entries(self) -> int:
        return len(self.halves[0])

    @property
    def parts(self) -> np.ndarray:
        """The part of each cell: neighbouring cells together, about PART_ROWS rows a part."""
        return (np.cumsum(self.counts) - self.counts) // PART_ROWS

    def squares(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of vectors to the entries."""
        cut = self.dim // 2
        return _squares(v[:, :cut], self.halves[0]), _squares(v[:, cut:], self.halves[1])


@dataclass
class Index:
    """rows: (cell, id, v), stored."""

    rows: DataFrame
    cells: Cells


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1))


def _codebook(sample: np.ndarray, entries: int) -> np.ndarray:
    """Lloyd's rounds on a sample; starts at evenly spaced distinct rows of it."""
    distinct = np.unique(sample, axis=0)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(distinct))
    c = distinct[np.sort(order[:entries])].copy()
    for _ in range(LLOYD_ROUNDS):
        at = _squares(sample, c).argmin(axis=1)
        for j in np.unique(at):
            c[j] = sample[at == j].mean(axis=0)
    return np.concatenate([c, np.repeat(c[-1:], entries - len(c), axis=0)])


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs of entries by summed distance, nearest first, from a heap that holds the edge of what was met."""
    o1, o2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[o1].tolist(), second[o2].tolist()
    met = [0] * len(a)  # so many pairs of each row have been met
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        met[i] = j + 1
        yield int(o1[i]), int(o2[j])
        if i + 1 < len(a) and met[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or met[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def met_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, effort: float) -> list[int]:
    """Cells with rows, in the order of the walk, until they hold `effort` rows."""
    out, held, n = [], 0, len(second)
    for i, j in walk(first, second):
        cell = i * n + j
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
            if held >= effort:
                break
    return out


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest allowed rows by distance, then id.

    A matrix product preselects with room for its rounding; what it leaves is compared component by component.
    """
    scale = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)
    d, room = scale - 2.0 * (q @ v.T), scale * (4e-16 * max(8, q.shape[1]))
    if allowed is not None:
        d[~allowed] = np.inf
    near = np.ones(d.shape, dtype=bool)
    if d.shape[1] > k:
        near = ~(d - room > np.partition(d + room, k - 1, axis=1)[:, k - 1 : k])
    if allowed is not None:
        near &= allowed
    qi, ri = np.nonzero(near)
    total = np.zeros(len(qi))
    for c in range(q.shape[1]):
        step = q[qi, c] - v[ri, c]
        total += step * step
    distance = np.sqrt(total)
    order = np.lexsort((ids[ri], distance, qi))
    qi, ri, distance = qi[order], ri[order], distance[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = rank < k
    return qi[keep], ri[keep], distance[keep]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, an id once."""
    table = kept_vectors(rows, vec_col, id=id_col).where(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).withColumn("id", F.col("id").cast("bigint"))
    repeated = table.groupBy("id").count().where("count > 1").limit(1).count()
    return table.groupBy("id").agg(F.min("v").alias("v")) if repeated else table


def build(table: DataFrame, k: int, *, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> Index | None:
    """The index of (id, v); k: how many neighbours searches will ask for. None without rows."""
    n = table.count()
    if not n:
        return None
    share = min(1 << 30, math.ceil(sample / n * (1 << 30)))
    picked = table.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy("id").collect() or table.limit(1).collect()
    if len({len(r.v) for r in picked}) > 1:
        raise ValueError("vectors of several lengths")
    fit = np.array([r.v for r in picked], dtype=np.float64)
    dim, entries = fit.shape[1], max(1, min(MOST_ENTRIES, round(math.sqrt(n / cell_rows)), len(fit)))
    cut = dim // 2
    out = Cells(dim, (_codebook(fit[:, :cut], entries), _codebook(fit[:, cut:], entries)), np.zeros(0), np.zeros(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                both = out.squares(matrix(part.column("v"), dim))
                at = [d.argmin(axis=1) for d in both]
                far = [np.sqrt(d[np.arange(len(d)), a]) for d, a in zip(both, at, strict=True)]
                cell = pa.array((at[0] * entries + at[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([cell, part.column("id"), part.column("v"), *map(pa.array, far)], names=["cell", "id", "v", "far1", "far2"])
            give_back()

    few_ids = table.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1).select("id", "v")
    placed = stored(few_ids.mapInArrow(assign, "cell int, id bigint, v array<double>, far1 double, far2 double"), "cells")
    counts, radii = np.zeros(entries * entries, np.int64), np.zeros((2, entries * entries))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect():
        counts[r.cell], radii[:, r.cell] = r.n, (r.far1, r.far2)
    out.counts, out.radii = counts, radii
    return Index(placed.select("cell", "id", "v"), out)


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = RECALL, least: int = LEAST_EFFORT) -> int:
    """Rows that a walk must meet so that `recall` of the true neighbours of CALIBRATE queries are among them."""
    cells = index.cells
    some = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATE).collect()
    if not some or least >= cells.counts.sum():
        return least
    own, q = [r.id for r in some], np.array([r.v for r in some], dtype=np.float64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                ids, cell = part.column("id").to_numpy(), part.column("cell").to_numpy()
                qi, ri, d = nearest(q, matrix(part.column("v"), cells.dim), ids, k + 1)
                held = [np.concatenate(x) for x in zip(held, (qi, ids[ri], cell[ri], d), strict=True)]
                order = np.lexsort((held[1], held[3], held[0]))
                held = [x[order] for x in held]
                keep = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k + 1
                held = [x[keep] for x in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["q", "id", "cell", "score"])

    found = index.rows.mapInArrow(compare, "q bigint, id bigint, cell int, score double")
    true = _ranked(found.where(~F.array(*[F.lit(i) for i in own])[F.col("q").cast("int")].eqNullSafe(F.col("id"))), k).collect()
    first, second = cells.squares(q)
    needed = []
    for i in range(len(own)):
        wanted = [r.cell for r in true if r.q == i]
        walked = met_cells(first[i], second[i], cells.counts, math.inf)
        held = dict(zip(walked, np.cumsum(cells.counts[walked]).tolist(), strict=True))
        needed += [held[c] for c in wanted]
    return max(least, sorted(needed)[math.ceil(recall * len(needed)) - 1]) if needed else least


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(index: Index) -> DataFrame:
    """Rows in blocks by part: (part, cells, ids, vectors) packed."""
    spark, most = index.rows.sparkSession, max(1, BLOCK_BYTES // (8 * max(1, index.cells.dim)))
    dim, used = index.cells.dim, np.flatnonzero(index.cells.counts)
    places = spark.createDataFrame([(int(c), int(p)) for c, p in zip(used, index.cells.parts[used], strict=True)], "cell int, part bigint")
    rows = index.rows.join(F.broadcast(places), "cell").repartitionByRange("part", "cell", "id").sortWithinPartitions("part", "cell", "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for i in range(lo, hi, most):
                    own = batch.slice(i, min(most, hi - i))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[lo])]), "cells": pa.array([own.column("cell").to_numpy().tobytes()], pa.binary()), "ids": pa.array([own.column("id").to_numpy().tobytes()], pa.binary()), "rows": pa.array([matrix(own.column("v"), dim).tobytes()], pa.binary())})
            give_back()

    return rows.select("part", "cell", "id", "v").mapInArrow(make, "part bigint, cells binary, ids binary, rows binary")


def _visits(known: Cells, effort: int, beyond: bool):
    """Batches of queries (id, v, and with `beyond` the distance to beat) to rows (part, q, v, cells) for each part that a query must see."""
    parts, dim = known.parts, known.dim

    def cells_of(first: np.ndarray, second: np.ndarray, worst: float | None) -> np.ndarray:
        met = np.array(met_cells(first, second, known.counts, effort), dtype=np.int64)
        if worst is None:
            return met
        r1, r2 = known.radii
        n = known.entries
        gap = np.maximum(0.0, np.sqrt(np.repeat(first, n)) - r1) ** 2 + np.maximum(0.0, np.sqrt(np.tile(second, n)) - r2) ** 2
        can = (known.counts > 0) & (np.sqrt(gap) * (1 - 1e-9) - 1e-9 <= worst)
        can[met] = False
        return np.flatnonzero(can)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, PACK_QUERIES):
                own = batch.slice(s, PACK_QUERIES)
                v = matrix(own.column("v"), dim)
                first, second = known.squares(v)
                worst = own.column("worst").to_pylist() if beyond else [None] * len(v)
                out: dict = {"part": [], "q": [], "v": [], "cells": []}
                for i, q in enumerate(own.column("id").to_pylist()):
                    cells = np.sort(cells_of(first[i], second[i], worst[i]))
                    for p in np.unique(parts[cells]):
                        out["part"].append(int(p))
                        out["q"].append(q)
                        out["v"].append(v[i].tobytes())
                        out["cells"].append(cells[parts[cells] == p].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int64()), "q": pa.array(out["q"], pa.int64()), "v": pa.array(out["v"], pa.binary()), "cells": pa.array(out["cells"], pa.binary())})

    return run


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one part as one row: ids, vectors, cells and how many cells each query has."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for i in range(lo, hi, PACK_QUERIES):
                own = batch.slice(i, min(PACK_QUERIES, hi - i))
                cells = own.column("cells").to_pylist()
                sizes = np.array([len(c) // 4 for c in cells], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[lo])]), "qs": pa.array([own.column("q").to_numpy().tobytes()], pa.binary()), "vs": pa.array([b"".join(own.column("v").to_pylist())], pa.binary()), "met": pa.array([b"".join(cells)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary())})


def _rerank(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, ids, rows, qs, vs, met, sizes in zip(*[batch.column(c).to_pylist() for c in ("cells", "ids", "rows", "qs", "vs", "met", "sizes")], strict=True):
                cell, own, q = np.frombuffer(cells, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(qs, np.int64)
                local, at = np.unique(cell, return_inverse=True)
                wanted, owner = np.frombuffer(met, np.int32), np.repeat(np.arange(len(q)), np.frombuffer(sizes, np.int32))
                place = np.minimum(np.searchsorted(local, wanted), len(local) - 1)
                there = local[place] == wanted
                allowed = np.zeros((len(q), len(local)), dtype=bool)
                allowed[owner[there], place[there]] = True
                some = np.flatnonzero(allowed.any(axis=1))
                if len(some):
                    v = np.frombuffer(vs, np.float64).reshape(len(q), dim)[some]
                    qi, ri, d = nearest(v, np.frombuffer(rows, np.float64).reshape(len(own), dim), own, k, allowed[some][:, at])
                    yield pa.RecordBatch.from_arrays([pa.array(q[some][qi]), pa.array(own[ri]), pa.array(d)], names=["q", "id", "score"])
            give_back()

    return run


def _found(index: Index, blocks: DataFrame, queries: DataFrame, effort: int, k: int, beyond: bool = False) -> DataFrame:
    visits = queries.mapInArrow(_visits(index.cells, effort, beyond), "part bigint, q bigint, v binary, cells binary")
    packs = visits.repartitionByRange("part", "q").sortWithinPartitions("part", "q").mapInArrow(_packs, "part bigint, qs binary, vs binary, met binary, sizes binary")
    return blocks.join(packs.hint("merge"), "part").drop("part").mapInArrow(_rerank(index.cells.dim, k), FOUND)


def search(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, least: int = LEAST_EFFORT, exact: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank int, id, score): each query's k nearest rows but its own, by Euclidean distance."""
    if k < 1 or not 0 < recall <= 1:
        raise ValueError("k of 1 at least, recall above 0 and up to 1")
    spark = rows.sparkSession
    table, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    index = build(table, k, cell_rows=cell_rows)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    alike = stored(asked.groupBy("v").agg(F.min("id").alias("id")), "queries")
    effort = calibrated(index, alike, k, recall, least)
    blocks = stored(_blocks(index), "blocks")
    found = _ranked(_found(index, blocks, alike, effort, k + 1), k + 1).select("q", "id", "score")
    if exact:
        found = settle(found)
        worst = found.groupBy("q").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(math.inf)).alias("worst"))
        left = alike.join(worst, alike.id == worst.q, "left").select("id", "v", F.coalesce("worst", F.lit(math.inf)).alias("worst"))
        found = _ranked(found.unionByName(_found(index, blocks, left, effort, k + 1, beyond=True)), k + 1).select("q", "id", "score")
    own = asked.join(alike.withColumnRenamed("id", "q"), "v").select(F.col("id").alias("query_id"), "q")
    pairs = own.join(found, "q").where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
