"""Exact vector search: one query or many against all rows, and an approximate index beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..plans import new_folder, settle, small

#: Queries held by a task at once; more are searched in blocks of as many.
QUERY_BLOCK = 4096
#: Queries of a block, and rows of a batch, that are multiplied with each other at once.
PRODUCT_QUERIES = 256
PRODUCT_ROWS = 2048


def check_request(k: int, vector: list[float], dim: int) -> None:
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    if len(vector) != dim:
        raise ValueError(f"the query has {len(vector)} dimensions, the table {dim}")


def exact_topk(rows: DataFrame, vector: list[float], k: int, *, id_col="chunk_id", vec_col="embedding", dim: int | None = None) -> DataFrame:
    """The k rows nearest by cosine, ties by id. The limit is the feature; each task sends k rows at most."""
    check_request(k, vector, dim or len(vector))
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = rows.withColumn("score", cosine(F.col(vec_col), q)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_col).limit(k).drop(vec_col)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then by id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def batch_topk(queries: DataFrame, rows: DataFrame, k: int, *, query_id="qid", id_col="chunk_id", vec_col="embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of every query.

    A query is a distinct pair of id and vector: an id with several vectors has k rows for each of them, a
    null id is one as any other, a null vector is none. Spark writes the queries as files of at most
    `block` into the shared folder; each partition of rows meets each file in a task of its own, which
    multiplies its rows with that block, so many of both at once, and keeps k per query; those are ranked once more.
    The result is the same for any number of tasks.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    spark, kind, qkind = queries.sparkSession, rows.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    ids = queries.select(F.col(query_id).alias("q"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null").distinct().withColumn("u", F.xxhash64("v"))
    folder, n = new_folder(spark, "queries"), ids.count()
    ids.repartition(max(1, math.ceil(n / block)), "q", "u").write.option("maxRecordsPerFile", block).parquet(folder)
    files = spark.read.parquet(folder).inputFiles() if n else []
    if not files:
        return spark.createDataFrame([], f"{query_id} {qkind}, {id_col} {kind}, score double, rank int")
    # A range, so that a block's name costs no Python worker beside the one that searches.
    blocks = spark.range(0, len(files), 1, len(files)).select(F.get(F.array(*map(F.lit, files)), F.col("id").cast("int")).alias("block"))
    held = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # With this hint a task has one partition of rows and one of the blocks, not all blocks at once.
    found = held.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(_search(k), f"q {qkind}, u bigint, id {kind}, score double")
    w = Window.partitionBy("q", "u").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _read_block(uri: str) -> pa.Table:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    with files.open_input_file(path) as f:
        return pq.ParquetFile(f).read()


def _vectors(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
        raise ValueError("the queries have vectors of several dimensions")
    flat = np.asarray(v.combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(v), -1) if len(v) else np.zeros((0, 0))


class _Block:
    """A block of queries with the k best rows of each so far."""

    def __init__(self, table: pa.Table, k: int):
        self.table, self.k, self.matrix = table.select(["q", "u"]), k, _vectors(table.column("v"))
        self.norms, self.tops = np.linalg.norm(self.matrix, axis=1), [None] * len(self.matrix)
        self.floor = np.full(len(self.matrix), -np.inf)  # the k-th best score, where there are k

    def meet(self, x: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        for first in range(0, len(self.matrix), PRODUCT_QUERIES):
            norms, floor = self.norms[first : first + PRODUCT_QUERIES], self.floor[first : first + PRODUCT_QUERIES]
            s = (self.matrix[first : first + PRODUCT_QUERIES] @ x.T) / length
            least = np.multiply(floor, norms, out=np.full(len(norms), -np.inf), where=norms > 0)
            if len(x) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, len(x) - self.k, axis=1)[:, len(x) - self.k])
            # The last bits of a matrix product depend on its shape: it only preselects, with room for them.
            near_all = s >= (least - 1e-9 * norms)[:, None]
            for i in (first + np.flatnonzero(near_all.any(axis=1))).tolist():
                near = np.flatnonzero(near_all[i - first])
                scores = (x[near] * self.matrix[i]).sum(axis=1) / (length[near] * self.norms[i]) if self.norms[i] > 0 else np.zeros(len(near))
                got = ids[near]
                if self.tops[i] is not None:
                    scores, got = np.concatenate([self.tops[i][0], scores]), np.concatenate([self.tops[i][1], got])
                at = _best(scores, got, self.k)
                self.tops[i] = (scores[at], got[at])
                if len(at) == self.k:
                    self.floor[i] = scores[at[-1]]

    def found(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.tops), PRODUCT_QUERIES):
            held = [(i, *self.tops[i]) for i in range(first, min(len(self.tops), first + PRODUCT_QUERIES)) if self.tops[i] is not None and len(self.tops[i][0])]
            if held:
                at = pa.array(np.repeat([i for i, _, _ in held], [len(s) for _, s, _ in held]))
                columns = self.table.take(at).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in columns.columns), pa.array([x for _, _, got in held for x in got.tolist()], kind), pa.array(np.concatenate([s for _, s, _ in held]))], names=["q", "u", "id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        kind = None
        for mixed in batches:
            kind = mixed.schema.field("id").type
            for uri in mixed.column("block").unique().to_pylist():
                if uri not in blocks:
                    blocks[uri] = _Block(_read_block(uri), k)
                block = blocks[uri]
                if not len(block.matrix):  # Spark writes a file for an empty first partition
                    continue
                every = mixed.filter(pc.equal(mixed.column("block"), uri))
                for first in range(0, every.num_rows, PRODUCT_ROWS):
                    batch = every.slice(first, PRODUCT_ROWS)
                    flat = np.asarray(batch.column("v").flatten(), dtype=np.float64)
                    if len(flat) != block.matrix.shape[1] * batch.num_rows:
                        raise ValueError("a vector has another dimension than the queries")
                    x = flat.reshape(-1, block.matrix.shape[1])
                    length = np.sqrt((x * x).sum(axis=1))
                    ok = length > 0
                    if ok.any():
                        ids = np.asarray(batch.column("id").to_pylist(), dtype=object if pa.types.is_string(kind) else None)[ok]
                        block.meet(x[ok], length[ok], ids)
        for block in blocks.values():
            yield from block.found(kind)

    return run


def fused_ranks(lists: DataFrame, *, query_id="qid", id_col="chunk_id", constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists stacked as rows (query, id, rank)."""
    return lists.groupBy(query_id, id_col).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("fused"))


def lsh_topk(queries: DataFrame, rows: DataFrame, k: int, *, query_id="qid", id_col="chunk_id", vec_col="embedding", bits: int = 3, tables: int = 16, seed: int = 11) -> DataFrame:
    """Approximate k nearest without an index: sign-of-projection buckets, then exact cosine of what meets.

    With the defaults, of vectors spread evenly over 64 dimensions 0.99 of the ten nearest were met, and
    nine tenths of all rows; more bits meet fewer of both. `ivf` is exact and meets far fewer.
    """
    first = rows.select(F.size(vec_col).alias("n")).where("n > 0").first()
    dim = first.n if first else 1
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((tables * bits, dim)).T

    def bucketed(df: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
                sign = (x @ planes > 0).reshape(-1, tables, bits)
                bucket = (sign * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(bucket.astype(np.int64)), pa.list_(pa.int64()))], names=["id", "v", "buckets"])

        kind = df.schema[key].dataType.simpleString()
        return df.where(F.col(vec_col).isNotNull()).select(F.col(key).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>, buckets array<bigint>")

    q = small(settle(bucketed(queries, query_id).select(F.col("id").alias("q"), F.col("v").alias("qv"), F.explode("buckets").alias("b"))), QUERY_BLOCK * tables)
    r = bucketed(rows, id_col).select("id", "v", F.explode("buckets").alias("b"))
    met = r.join(q, "b").groupBy("q", "id").agg(F.first("v").alias("v"), F.first("qv").alias("qv")).withColumn("score", cosine(F.col("v"), F.col("qv"))).where("score is not null")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
