"""Mutable state as tables: latest rows by key, dead letters, additive counters, atomic swaps."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import backoff_minutes

MOST_ATTEMPTS = 5


def latest(rows: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a partial maximum, so a busy key is summed up before it is shuffled."""
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return top.select("_r.*")


def upserted(current: DataFrame, batch: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """current with the batch's last row of each key instead of its own: the same however often a batch is applied."""
    new = latest(batch, key=key, order=order)
    return current.join(new.select(*key), key, "left_anti").unionByName(new.select(*current.columns))


def added(current: DataFrame, batch: DataFrame, *, key: list[str], sums: list[str]) -> DataFrame:
    """Counters by key, summed."""
    return current.select(*key, *sums).unionByName(batch.select(*key, *sums)).groupBy(*key).agg(*[F.sum(c).cast(current.schema[c].dataType).alias(c) for c in sums])


def due(letters: DataFrame, now: Column) -> DataFrame:
    """Dead letters to try again, earliest first: fewer than five attempts, and their time has come."""
    return letters.where((F.col("attempts") < MOST_ATTEMPTS) & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "chunk_id")


def failed(letters: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Letters (chunk_id, attempts, last_error, next_attempt_at) after failures (chunk_id, error)."""
    f = failures.groupBy("chunk_id").agg(F.max("error").alias("_e"))
    both = letters.join(f, "chunk_id", "full")
    tries = F.when(F.col("_e").isNull(), F.col("attempts")).otherwise(F.coalesce("attempts", F.lit(0)) + 1)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(tries), F.lit(0))
    when = F.when(F.col("_e").isNull(), F.col("next_attempt_at")).otherwise(now + wait)
    return both.select("chunk_id", tries.alias("attempts"), F.coalesce("_e", "last_error").alias("last_error"), when.alias("next_attempt_at"))


def succeeded(letters: DataFrame, done: DataFrame) -> DataFrame:
    return letters.join(done.select("chunk_id"), "chunk_id", "left_anti")


class VersionedTable:
    """A Parquet table that is replaced as a whole: each version is a folder, and a pointer file names the current one.

    One writer at a time; readers see the version that they opened.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        """The newest version: the pointer with the highest number."""
        if not self.fs.exists(self._path(self.folder)):
            return None
        marks = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        marks = sorted(m for m in marks if m.startswith("v-") and m.endswith(".ok"))
        return marks[-1].removesuffix(".ok") if marks else None

    def read(self) -> DataFrame:
        v = self.current()
        return self.spark.read.schema(self.schema).parquet(posixpath.join(self.folder, v)) if v else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> str:
        """Writes a new version and then points to it; a failed write leaves the old one current."""
        last = self.current()
        name = f"v-{int(last.split('-')[1]) + 1 if last else 1:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(posixpath.join(self.folder, name))
        self.fs.create(self._path(posixpath.join(self.folder, f"{name}.ok")), False).close()
        return name


def reset_checkpoints(checkpoints: DataFrame, requested: list[str]) -> tuple[DataFrame, DataFrame]:
    """(checkpoints without cursor and etag for the requested types, what was discarded). Evidence is not touched."""
    hit = F.col("entity_type").isin(*requested)
    gone = checkpoints.where(hit).select("tenant_id", "entity_type", F.col("cursor_value").alias("discarded_cursor"), F.col("etag").alias("discarded_etag"))
    blank = lambda c: F.when(~hit, F.col(c)).alias(c)
    return checkpoints.select(*[blank(c) if c in ("cursor_value", "etag") else F.col(c) for c in checkpoints.columns]), gone


def saved_checkpoint(checkpoints: DataFrame, batch: DataFrame) -> DataFrame:
    """Checkpoints after a batch (tenant_id, entity_type, cursor_value, etag, items): a missing cursor keeps the previous one, items add up."""
    key = ["tenant_id", "entity_type"]
    new = batch.select(*key, F.col("cursor_value").alias("_c"), F.col("etag").alias("_e"), F.col("items").alias("_n"))
    both = checkpoints.join(new, key, "full")
    return both.select(*key, F.coalesce("_c", "cursor_value").alias("cursor_value"), F.coalesce("_e", "etag").alias("etag"), (F.coalesce("items_seen", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("items_seen"))
