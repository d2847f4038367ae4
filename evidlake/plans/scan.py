"""Ordered work along a key whose rows no single task holds.

Rows are cut into ranges of (key, order) and written once into the shared folder, so that a hot key is
many ranges. What a range hands on to the later ones of its key (a sum, a maximum, its last value) is one
row for each key and range; these are folded in order and joined back, and windows run within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import new_folder


class Ranges:
    """rows: the given ones with `_range`; rows that tie in (key, order) may lie in any order, but always in the same."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str]):
        spark, self.key, self.order = rows.sparkSession, key, order
        folder = new_folder(spark, "ranges")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
        self.rows = spark.read.parquet(folder)

    @property
    def inside(self):
        """The window of a key's rows within a range, in order."""
        return Window.partitionBy(*self.key, "_range").orderBy(*self.order)

    def place(self) -> Column:
        """A struct by which the rows of a range compare as in the order."""
        return F.struct(*[x for c in self.order for x in (F.col(c).isNotNull(), F.col(c))])

    def carried(self, rows: DataFrame, **what: tuple[Column, Column]) -> DataFrame:
        """rows with, for each name, a fold of what the earlier ranges of the key hand on; null in a key's first range.

        what: name -> (aggregate of a range's rows, fold of these, as a column over the name).
        """
        per = rows.groupBy(*self.key, "_range").agg(*[aggregate.alias(n) for n, (aggregate, _) in what.items()])
        earlier = Window.partitionBy(*self.key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
        before = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], F.col("_range").alias("_r"), *[fold.over(earlier).alias(n) for n, (_, fold) in what.items()])
        same = F.col("_range") == F.col("_r")
        for i, k in enumerate(self.key):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(before, same, "left").drop("_r", *[f"_k{i}" for i in range(len(self.key))])

    def lagged(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with `name`: a struct of the value of the row before (field v), across ranges; null for a key's first row."""
        rows = rows.withColumn("_v", F.struct(value.alias("v")))
        carried = self.carried(rows, _last=(F.max_by("_v", self.place()), F.last("_last", ignorenulls=True)))
        return carried.withColumn(name, F.coalesce(F.lag("_v").over(self.inside), F.col("_last"))).drop("_v", "_last")

    def summed(self, rows: DataFrame, value: str, name: str, *, before: bool = False) -> DataFrame:
        """rows with the running sum of a column, up to each row or (`before`) to the one before it."""
        upto = self.inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        carried = self.carried(rows, _sum=(F.sum(value), F.sum("_sum")))
        return carried.withColumn(name, F.coalesce(F.sum(value).over(upto), F.lit(0)) + F.coalesce("_sum", F.lit(0))).drop("_sum")

    def largest(self, rows: DataFrame, value: str, name: str, *, before: bool = False) -> DataFrame:
        """rows with the running maximum of a column."""
        upto = self.inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        carried = self.carried(rows, _most=(F.max(value), F.max("_most")))
        return carried.withColumn(name, F.greatest(F.max(value).over(upto), F.col("_most"))).drop("_most")
