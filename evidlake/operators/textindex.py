"""Ranked full-text search from a stored index: phrases, exclusions and cover density without reading a text.

The index is a Parquet table with a row for each term and block, block after block and by term within one; a
block is about BLOCK_CHUNKS chunks whose ids hash alike, or fewer if they are long. A row has how many chunks of the block hold the term, the most
positions that one of them has, and the postings (id, positions). The most positions bound what a chunk of
the block can score: covers end at different occurrences, a phrase has no more of them than the rarest of
its words, and a cover weighs as much as there are phrases at most. For the k best, the blocks with the highest bounds are judged first; their k-th best
score is a floor, and only blocks whose bound reaches it are decoded after that. Without k all blocks
that can match are. Scores and matches are those of `text.ranked`.

Chunks without id or words aren't found; ids are taken to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import settle, small
from .text import STOP, Search, _judge, gathered, read_search, spelling, words

BLOCK_CHUNKS = 1024
#: What the texts of a block have together, on average, at most.
BLOCK_BYTES = 16 << 20
#: Blocks that a task writes.
TASK_BLOCKS = 4
#: Blocks that are judged first, for a floor.
FIRST_BLOCKS = 32
BROADCAST_BLOCKS = 1_000_000
#: The term under which every chunk of a block is listed.
ALL = ""


def write_index(chunks: DataFrame, folder: str, *, id_col: str = "chunk_id", text_col: str = "content", stemmed: bool = True, stop: frozenset[str] = STOP, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Writes the index of all chunks and reads it back: (term, block, n, most, postings).

    Texts are shuffled once, to the task that writes their block; what is larger than they are, their words, is not.
    """
    listed = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_chunks), math.ceil(size / BLOCK_BYTES))
    placed = listed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(math.ceil(blocks / TASK_BLOCKS), "block").sortWithinPartitions("block", "id")
    kind, term_of = listed.schema["id"].dataType.simpleString(), spelling(stemmed, stop)

    def rows(block: pa.Table) -> pa.Table:
        ids = block.column("id").combine_chunks()
        owner, terms, positions = gathered(block.column("w").combine_chunks(), term_of)
        # First every chunk, without positions, under ALL.
        owner, ends = np.append(np.arange(len(ids)), owner), np.append(np.zeros(len(ids), np.int64), positions.offsets.to_numpy())
        terms = pa.concat_arrays([pa.array([ALL] * len(ids), pa.string()), terms]).dictionary_encode()
        starts = np.flatnonzero(np.diff(terms.indices.to_numpy(), prepend=-1))
        posted = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), positions.values)], names=["id", "positions"])
        each = [terms.dictionary, pa.array([block.column("block")[0].as_py()] * len(starts), pa.int64()), pa.array(np.diff(starts, append=len(owner)), pa.int64()), pa.array(np.maximum.reduceat(np.diff(ends), starts), pa.int32())]
        return pa.table([*each, pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)), pa.int32()), posted)], names=["term", "block", "n", "most", "postings"])

    made = placed.select("block", "id", words(F.col("text")).alias("w")).groupBy("block").applyInArrow(rows, f"term string, block bigint, n bigint, most int, postings array<struct<id:{kind},positions:array<int>>>")
    made.write.parquet(folder)
    return chunks.sparkSession.read.parquet(folder)


def _bound(search: Search) -> Column:
    """What a chunk of a block scores at most, from `most` by term; null where no way has all its terms in the block."""
    least = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    times = lambda phrase: least([F.col("most")[t] for t in sorted(set(phrase))])
    most = lambda way: sum((times(p) for p in way[1:]), times(way[0])) * len(way)
    held = lambda way: F.when(F.forall(F.array(*[F.lit(t) for p in way for t in p]), lambda t: F.col("most")[t].isNotNull()), most(way))
    ways = [held(way) for way in search.any_of]
    return F.greatest(*ways) if len(ways) > 1 else ways[0]


def _judged(index: DataFrame, blocks: DataFrame, search: Search, names: list[str]) -> DataFrame:
    """(id, text_score) of the matching chunks of some blocks."""
    kind = index.schema["postings"].dataType.elementType["id"].dataType.simpleString()
    rows = index.where(F.col("term").isin(names)).select("term", "block", "postings").join(small(blocks, BROADCAST_BLOCKS), "block", "left_semi")
    per = rows.groupBy("block").agg(F.collect_list(F.struct("term", "postings")).alias("terms"))  # the search's terms over a block's chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("terms").to_pylist():
                of = {t["term"]: {p["id"]: p["positions"] for p in t["postings"]} for t in block}
                ways = [set.intersection(*[set(of.get(t, ())) for p in way for t in p]) for way in search.any_of]
                ids = sorted(set().union(*ways) if search.any_of else of.get(ALL, ()))
                found = [(i, score) for i in ids for good, score in [_judge(search, {t: of[t][i] for t in of if t != ALL and i in of[t]})] if good]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], batch.schema.field("terms").type.value_type.field("postings").type.value_type.field("id").type), pa.array([s for _, s in found], pa.float64())], names=["id", "text_score"])

    return per.select("terms").mapInArrow(run, f"id {kind}, text_score double")


def search_index(index: DataFrame, query: str | Search, *, k: int | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(id, text_score) of chunks that match a web-style search; with k, the k best by score, ties by id."""
    search = read_search(query) if isinstance(query, str) else query
    kind = index.schema["postings"].dataType.elementType["id"].dataType.simpleString()
    if not search.any_of and not search.none_of:
        return index.sparkSession.createDataFrame([], f"{id_col} {kind}, text_score double")
    wanted = search.terms
    names = sorted({*wanted, *(t for p in search.none_of for t in p)}) + ([] if search.any_of else [ALL])
    if search.any_of:
        most = index.where(F.col("term").isin(wanted)).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("most"))
        blocks = most.select("block", _bound(search).alias("bound")).where("bound > 0")
    else:
        blocks = index.where(F.col("term") == ALL).select("block", F.lit(0).alias("bound"))
    best = lambda df: df.orderBy(F.desc("text_score"), "id").limit(k)
    if k is None or not search.any_of:
        found = _judged(index, blocks.select("block"), search, names)
        return (found if k is None else best(found)).withColumnRenamed("id", id_col)
    blocks = settle(blocks)
    first = settle(blocks.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS))
    head = settle(best(_judged(index, first.select("block"), search, names)))
    n, floor = head.agg(F.count("*"), F.min("text_score")).first()
    rest = blocks.join(first.select("block"), "block", "left_anti")
    rest = rest.where(F.col("bound") >= floor) if n == k else rest
    return best(head.unionByName(_judged(index, rest.select("block"), search, names))).withColumnRenamed("id", id_col)
