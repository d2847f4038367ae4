"""A table of rows by key that takes upserts and deletes at the cost of the batch.

Log-structured: each batch is a Parquet folder of its own, dealt by a hash of the key into buckets, with
a mark on rows that delete their key; a manifest file names the folders that are the table, in order. A
read merges them: of each key the row of the latest folder counts. Folders of one level are merged into
one of the next when there are FAN of them, so a row is rewritten as often as the logarithm of the table's
size; delete marks go when the oldest folder is part of the merge. A manifest is made visible by creating
a file that must not exist: of two writers one fails and can try again, and a batch that fails before
that leaves nothing that anyone reads. A batch whose name the table has seen is not applied again.

A row that can't be kept (null key, or longer than MOST_BYTES) is refused by itself, with a reason, and the
others are written. Of several rows of a key in one batch the last by `order` counts (the last by all
columns, on ties); an upsert counts after a delete of the same batch.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 4
BUCKETS = 64
#: Longest row, as text, that a batch may hold.
MOST_BYTES = 16 << 20


class Conflict(RuntimeError):
    """Another writer changed the table first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], order: list[str], *, buckets: int = BUCKETS, fan: int = FAN, most_bytes: int = MOST_BYTES):
        self.spark, self.folder, self.key, self.order = spark, folder, key, order
        self.schema = StructType.fromDDL(schema)
        self.buckets, self.fan, self.most_bytes = buckets, fan, most_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # The manifest: {"folders": [{"name", "level"}, oldest first], "batches": {batch: version}}

    def version(self) -> int:
        log = self._path(posixpath.join(self.folder, "log"))
        if not self.fs.exists(log):
            return 0
        return max((int(s.getPath().getName().removesuffix(".json")) for s in self.fs.listStatus(log) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"folders": [], "batches": {}}
        text = self.spark.read.option("wholetext", True).text(posixpath.join(self.folder, "log", f"{version:012d}.json")).first()[0]
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        """Makes a manifest the table's, if `version` is still the current one."""
        log = posixpath.join(self.folder, "log")
        draft, final = (self._path(posixpath.join(log, n)) for n in (f".{uuid.uuid4().hex}", f"{version + 1:012d}.json"))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {version + 1} was written by another")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, names: list[str]) -> DataFrame:
        """The rows of folders with the place of their folder."""
        kind = StructType.fromDDL(f"{self.schema.simpleString()[7:-1]}, _gone boolean, _bucket int") if names else None
        parts = [self.spark.read.schema(kind).parquet(posixpath.join(self.folder, "data", n)).withColumn("_at", F.lit(i)) for i, n in enumerate(names)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the latest folder; a partial maximum, so that nothing but one row a key and task is shuffled."""
        kept = [f.name for f in self.schema if f.name not in self.key]
        value = F.struct(*kept, "_gone") if kept else F.struct("_gone")
        top = rows.groupBy("_bucket", *self.key).agg(F.max_by(value, "_at").alias("_v"))
        return top.select(*[F.col(f"_v.{f.name}").alias(f.name) if f.name in kept else F.col(f.name) for f in self.schema], F.col("_v._gone").alias("_gone"), "_bucket")

    def read(self, version: int | None = None) -> DataFrame:
        names = [f["name"] for f in self.manifest(version)["folders"]]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self._rows(names)).where("not _gone").select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (a frame of the key columns); only the buckets that they fall in are read."""
        wanted = keys.select(*self.key).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most BUCKETS numbers
        names = [f["name"] for f in self.manifest()["folders"]]
        if not names or not buckets:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(names).where(F.col("_bucket").isin(buckets)).join(wanted, self.key, "left_semi")
        return self._merged(rows).where("not _gone").select(*self.schema.names)

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = f"{level}-{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(posixpath.join(self.folder, "data", name))
        return {"name": name, "level": level}

    def apply(self, batch: str, rows: DataFrame, deletes: DataFrame | None = None) -> bool:
        """Upserts rows and deletes keys as one batch; False if a batch of that name is in the table already."""
        version = self.version()
        before = self.manifest(version)
        if batch in before["batches"]:
            return False
        rows = rows.select(*self.schema.names)
        no_key = F.lit(False)
        for k in self.key:
            no_key = no_key | F.col(k).isNull()
        length = F.octet_length(F.to_json(F.struct(*self.schema.names)))
        checked = rows.withColumn("_why", F.when(no_key, F.lit("no key")).when(length > self.most_bytes, F.lit("too long")))
        refused = checked.where("_why is not null").select(*self.key, F.col("_why").alias("reason"), F.lit(batch).alias("batch"))
        good = checked.where("_why is null").drop("_why")
        place = F.struct(*self.order, *[c for c in self.schema.names if c not in self.order])
        last = good.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names), place).alias("_r")).select("_r.*")
        out = last.withColumn("_gone", F.lit(False))
        if deletes is not None:
            blank = [F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
            gone = deletes.select(*self.key).dropna().distinct().join(last.select(*self.key), self.key, "left_anti")
            out = out.unionByName(gone.select(*blank, F.lit(True).alias("_gone")))
        new = self._write(out.withColumn("_bucket", self._bucket()), 0)
        refused.write.parquet(posixpath.join(self.folder, "refused", new["name"]))
        self._commit(version, {"folders": [*before["folders"], new], "batches": before["batches"] | {batch: version + 1}})
        return True

    def refusals(self) -> DataFrame:
        """(key..., reason, batch) of every refused row of the batches that are in the table."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema if f.name in self.key)
        root = self._path(posixpath.join(self.folder, "refused"))
        seen = list(self.manifest()["batches"])
        if not seen or not self.fs.exists(root):
            return self.spark.createDataFrame([], f"{kinds}, reason string, batch string")
        return self.spark.read.schema(f"{kinds}, reason string, batch string").option("recursiveFileLookup", True).parquet(root.toString()).where(F.col("batch").isin(seen)).distinct()

    def compact(self) -> int:
        """Merges runs of folders of one level until no level has `fan` of them; returns how many merges that took."""
        done = 0
        while True:
            version = self.version()
            before = self.manifest(version)
            folders = before["folders"]
            run = next((folders[i : i + self.fan] for i in range(len(folders) - self.fan + 1) if len({f["level"] for f in folders[i : i + self.fan]}) == 1), None)
            if run is None:
                return done
            at = folders.index(run[0])
            merged = self._merged(self._rows([f["name"] for f in run]))
            new = self._write(merged.where("not _gone") if at == 0 else merged, run[0]["level"] + 1)
            self._commit(version, before | {"folders": [*folders[:at], new, *folders[at + len(run) :]]})
            done += 1

    def vacuum(self) -> int:
        """Deletes data folders that the current manifest doesn't name; for when no reader is at an older version and no writer is at work."""
        root = self._path(posixpath.join(self.folder, "data"))
        live = {f["name"] for f in self.manifest()["folders"]}
        old = [s.getPath() for s in self.fs.listStatus(root) if s.getPath().getName() not in live] if self.fs.exists(root) else []
        for p in old:
            self.fs.delete(p, True)
        return len(old)


def upserts(table: KeyedTable, query: str):
    """A foreachBatch function: each micro-batch is one batch of the table, once, however often it is replayed."""

    def run(batch: DataFrame, number: int) -> None:
        table.apply(f"{query}:{number}", batch)
        table.compact()

    return run
