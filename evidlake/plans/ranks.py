"""Values at given ranks of large groups, exactly, without sorting a group or holding its distinct values.

Each round counts a group's values in BUCKETS buckets between the smallest and the largest that can still
be the one, a partial sum in every task, and goes on with the bucket that holds the rank. Buckets keep the
order of values, so the result is exact; values crowded together only take more rounds. Null, NaN and
infinite values don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import settle, small

BUCKETS = 4096
MOST_ROUNDS = 200
#: Most groups and ranks whose bounds are sent to every executor.
BROADCAST_TARGETS = 100_000


def nearest(percent: int) -> Column:
    """The nearest rank of a whole percentage of n values, in whole numbers: ceil(percent n / 100), 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.expr(f"({percent} * n + 99) div 100"))


def middle() -> tuple[Column, Column]:
    """The two ranks whose mean is the median."""
    return F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")


def _double_bucket(x: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """A bucket of x between lo and hi that rises with x: by size while they are of several orders of magnitude, then evenly."""
    size = lambda c: F.when(c > 0, F.log2(c) + 1100).when(c < 0, -F.log2(-c) - 1100).otherwise(0.0)
    near = ((lo > 0) & (hi <= 4 * lo)) | ((hi < 0) & (lo >= 4 * hi))
    part = F.when(near, x / 2 - lo / 2).otherwise(size(x) - size(lo))
    span = F.when(near, hi / 2 - lo / 2).otherwise(size(hi) - size(lo))
    return F.when(span > 0, F.floor(F.try_divide(part, span) * (buckets - 1))).otherwise((x > lo).cast("long"))


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, Column], by: list[str] = (), *, buckets: int = BUCKETS) -> DataFrame:
    """(by..., n, a column for each name): the value at a rank from 1, an expression over the count n; groups without values have no row."""
    kind = rows.schema[value].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    by = list(by)
    keys = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    fine = F.col("_x").isNotNull() if whole else F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < F.lit(float("inf")))
    values = settle(rows.select(*keys, F.col(value).cast("long" if whole else "double").alias("_x")).where(fine))
    b = [f"_b{i}" for i in range(len(by))]
    sizes = values.groupBy(*b).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("r")) for name, r in ranks.items()]))
    targets = settle(sizes.where("n > 0").withColumn("_t", named).select(*b, "n", "lo", "hi", F.col("_t.name").alias("name"), F.col("_t.r").alias("r")).where("r between 1 and n"))
    if whole:
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        place = F.floor((wide("_x") - wide("lo")) * buckets / (wide("hi") - wide("lo") + 1))
    else:
        place = _double_bucket(F.col("_x"), F.col("lo"), F.col("hi"), buckets)
    upto = Window.partitionBy("_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS rows
    targets = settle(targets.withColumn("_id", F.xxhash64("name", *[F.struct(F.col(c).isNull(), c) for c in b])))
    for _ in range(MOST_ROUNDS):
        left = targets.where("lo < hi")
        if not left.limit(1).count():
            break
        asked = left.select(*[F.col(c).alias(f"_a{c}") for c in b], "_id", "lo", "hi")
        same = (F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))
        for c in b:
            same = same & F.col(c).eqNullSafe(F.col(f"_a{c}"))
        met = values.join(small(asked, BROADCAST_TARGETS), same)
        counted = met.groupBy("_id", place.cast("int").alias("bucket")).agg(F.count("*").alias("c"), F.min("_x").alias("new_lo"), F.max("_x").alias("new_hi"))
        held = left.select("_id", "r").join(counted.withColumn("cum", F.sum("c").over(upto)), "_id").where((F.col("cum") >= F.col("r")) & (F.col("cum") - F.col("c") < F.col("r")))
        found = held.select("_id", (F.col("r") - F.col("cum") + F.col("c")).alias("new_r"), "new_lo", "new_hi")
        after = left.join(found, "_id").select(*b, "n", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "name", F.col("new_r").alias("r"), "_id")
        targets = settle(targets.where("lo = hi").unionByName(after))
    else:
        raise RuntimeError("ranks did not settle")
    out = targets.groupBy(*b).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("lo"))).cast(kind).alias(name) for name in ranks])
    return out.withColumnsRenamed(dict(zip(b, by, strict=True)))


def percent_text(rows: DataFrame, value: str, percents: dict[str, int], by: list[str], groups: DataFrame) -> DataFrame:
    """(by..., a text for each name): percentiles of every group listed in `groups`, "n/a" for one without values."""
    found = at_ranks(rows, value, {name: nearest(p) for name, p in percents.items()}, by)
    return groups.select(*by).distinct().join(found, by, "left").select(*by, *[F.coalesce(F.col(name).cast("string"), F.lit("n/a")).alias(name) for name in percents])
