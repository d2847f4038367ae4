"""Size-checked broadcasts, frames settled in shared storage, and assertions about physical plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def plan_text(df: DataFrame) -> str:
    """The physical plan as Spark prints it."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """The frame for broadcast if a counted bound holds, else as it is. Counts at most `most_rows` + 1 rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where a local session leaves it unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-evidlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame once, into the shared folder, for several uses of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], by: list[str] = (), name: str = "place") -> DataFrame:
    """Rows with their place from 1 in an order, within each group of `by`, without one task for all or for a hot group.

    Rows are dealt to ranges of (by, order) and settled; ranges are counted, and rows are numbered
    within their range. Rows that tie in the order get different places, in any order.
    """
    part = settle(df.repartitionByRange(*by, *order)).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = part.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    counts = counts.select(F.col("_part").alias("_p"), "_before", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)])
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return part.withColumn("_i", inside).join(counts, same).select(*df.columns, (F.col("_i") + F.col("_before")).alias(name))


def faults(df: DataFrame) -> list[str]:
    """What a plan at scale must not hold: cross joins of unbounded sides, windows or sorts of all rows in one task."""
    text = plan_text(df)
    found = [name for name in ("CartesianProduct", "BroadcastNestedLoopJoin") if name in text]
    if re.search(r"Window\b", text) and "SinglePartition" in text:
        found.append("a window over all rows in one task")
    return found
