"""Small helpers that several operators use: shared storage, lineage cuts, sizes, column tricks."""

from __future__ import annotations

import contextlib
import math
import posixpath
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Most rows of a batch that goes to Python.
BATCH_ROWS = 2000

#: Most rows of a pair of keys that are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Most bytes that strings among them may have.
BROADCAST_BYTES = 64 << 20


def check_local(master: str) -> None:
    """A folder of one machine will do only where driver and tasks are one process."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where a local session leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        check_local(spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="spark-evidlake-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name under the shared folder that no other run uses."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside goes to Python in batches of BATCH_ROWS rows at most: whole texts make large ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame once, into the shared folder, so that lost executors don't cost its lineage."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame written once as Parquet in the shared folder and reread, so that later passes read the columns they need."""
    folder = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(keys: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A settled frame of keys, for broadcast where its counted rows and the bytes of its strings and binaries are bounded, else as it is."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in keys.dtypes if kind in ("string", "binary")]
    size = sum(texts[1:], texts[0]) if texts else F.lit(0).cast("long")
    n, held = keys.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(keys) if n <= most and held <= most_bytes else keys


def plain(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The frame with columns c0, c1, ..., which no name of the caller's can clash with, and the new name of a column."""
    names = [f"c{i}" for i in range(len(df.columns))]

    def name(column: str) -> str:
        exact = [n for n, c in zip(names, df.columns, strict=True) if c == column]
        return (exact or [n for n, c in zip(names, df.columns, strict=True) if c.lower() == column.lower()])[0]

    return df.toDF(*names), name


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The columns asked for under new names, whatever other columns are called: no name of theirs can clash."""
    rows, name = plain(df)
    return rows.select(*[F.col(name(c)).alias(n) for n, c in columns.items()])


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, from the scan's statistics; at least 1."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(size, 1 << 62))


def pieces(df: DataFrame, each: int, least: int = 8, most: int = 1 << 16) -> int:
    """How many parts of about `each` input bytes a frame makes."""
    return max(least, min(most, math.ceil(input_bytes(df) / each)))


def let(value: Column, then) -> Column:
    """then(value), with value computed once: Catalyst can't copy it into a lambda that runs per element."""
    return F.transform(F.array(value), then)[0]


def memo(name: str, make):
    """An object that lives as long as a Python worker, made at first use (tokenizers, caches)."""
    store = sys.modules.setdefault("_evidlake_worker_memo", types.ModuleType("_evidlake_worker_memo"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def give_back() -> None:
    """Returns what Arrow has freed to the system: a Python worker outlives its tasks, and so would its peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def open_fs(uri: str):
    """(filesystem, path) for a URI in the shared folder; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
