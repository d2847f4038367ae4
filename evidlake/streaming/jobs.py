"""Incremental jobs on Structured Streaming. Each is safe to repeat: a batch that ran twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import settle
from .state import VersionedTable, upserted

#: Fixed value: the order in which evidence is ingested.
INGEST_ORDER = ("release", "pull_request", "issue", "commit")
MOST_TRIES = 3


def ingest(stream: DataFrame, table: VersionedTable, key: list[str], order: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, report: Callable[[int], None] = lambda n: None) -> StreamingQuery:
    """Upserts a stream's rows into a table, the last of each key winning; the checkpoint holds the cursor.

    A batch is computed once, into the shared folder; report() is told the number of its rows.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = settle(prepare(batch))
        n = rows.count()
        if n:
            table.replace(upserted(table.read(), rows, key=key, order=order))
        report(n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_in_order(sources: dict[str, tuple[DataFrame, VersionedTable, list[str], list[str]]], checkpoints: str) -> dict[str, int]:
    """Ingests each type of evidence to its end, cheap ones first, and returns the rows of each.

    sources: by type, (stream, table, key, order). A run that stopped is run again: what its batches
    have written stays, and each type goes on from its own checkpoint.
    """
    unknown = sources.keys() - set(INGEST_ORDER)
    if unknown:
        raise ValueError(f"no such evidence: {sorted(unknown)}")
    totals: dict[str, int] = {}
    for kind in INGEST_ORDER:
        if kind in sources:
            stream, table, key, order = sources[kind]
            totals[kind] = 0

            def add(n: int, kind: str = kind) -> None:
                totals[kind] += n

            ingest(stream, table, key, order, f"{checkpoints}/{kind}", report=add).awaitTermination()
    return totals


def reindex(batch: DataFrame, index: VersionedTable, embed: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the index rows of the batch's artefacts with those that embed() makes of its chunks.

    New rows, and the artefact's rows that are no longer among them, change in one swap, so a reader
    sees either state, and a repeated event ends in the same rows.
    """
    fresh = embed(batch)
    touched = batch.select("artefact").distinct()
    index.replace(index.read().join(touched, "artefact", "left_anti").unionByName(fresh.dropDuplicates(["chunk_id"])))


def embed_or_fail(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(chunk_id, embedding, error): batches are embedded together, and one by one where a batch fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    found = [(v, None) for v in embed(part.content.tolist())]
                except Exception:  # some text of the batch is at fault: which one is found out singly
                    found = [_single(embed, t) for t in part.content]
                out += [(i, *f) for i, f in zip(part.chunk_id, found, strict=True)]
            yield pd.DataFrame(out, columns=["chunk_id", "embedding", "error"])

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id long, embedding array<float>, error string")


def _single(embed, text: str):
    try:
        return embed([text])[0], None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def minute_usage(events: DataFrame, *, at="ts", late: str = "10 minutes") -> DataFrame:
    """Usage per minute and caller of a stream, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w"), "caller").agg(F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("minute"), "caller", "tokens")


def tries_then_poison(failures: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """(message, tries, poisoned) for each failure of a stream of (message): state is one number per message."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        n = before + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"message": [key[0]], "tries": [n], "poisoned": [n >= most]})

    return failures.groupBy("message").applyInPandasWithState(count, "message string, tries long, poisoned boolean", "tries long", "update", GroupStateTimeout.NoTimeout)


def once_only(stream: DataFrame, keys: list[str], at="ts", late: str = "1 hour") -> DataFrame:
    """A stream without the repeats of an event within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
