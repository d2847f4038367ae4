import random

import pytest
from pyspark.sql import functions as F

from evidlake.operators import runs, usage
from evidlake.plans.scan import Ranges


@pytest.fixture(scope="module")
def rows(spark):
    """A key with four fifths of all rows, a null key, ties in the order and nulls in the value."""
    rng = random.Random(2)
    out = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(300), i, rng.choice([1, 2, None])) for i in range(1000)]
    return out, spark.createDataFrame(out, "k string, at long, id long, x long").repartition(7)


def ordered(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1:3]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_running_values_cross_ranges(spark, rows):
    data, df = rows
    cut = Ranges(df, ["k"], ["at", "id"])
    assert cut.rows.where("k = 'hot'").select("_range").distinct().count() > 1
    out = cut.lagged(cut.summed(cut.largest(cut.rows, "x", "most", before=True), "x", "total"), F.col("x"), "prev")
    got = {r.id: (r.most, r.total, r.prev and (r.prev.v,)) for r in out.collect()}
    want = {}
    for group in ordered(data).values():
        total, most, prev = 0, None, None
        for r in group:
            total += r[3] or 0
            want[r[2]] = (most, total, prev)
            most, prev = max((x for x in (most, r[3]) if x is not None), default=None), (r[3],)
    assert got == want


def test_streaks_gaps_and_overlaps_of_a_hot_key(spark, rows):
    data, df = rows
    got = sorted(((r.k, r.x, r.length) for r in usage.streaks(df, key=["k"], order=["at", "id"], value="x").collect()), key=str)
    want = []
    for k, group in ordered(data).items():
        n = 0
        for a, b in zip(group, [*group[1:], None], strict=True):
            n += 1
            if b is None or b[3] != a[3]:
                want += [(k, a[3], n)] if a[3] is not None else []
                n = 0
    assert got == sorted(want, key=str)
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("at") * 10 + F.col("id") % 7))
    got = {r.k: (r.samples, r.least_gap) for r in usage.gaps(timed, key=["k"], at="ts", least_seconds=3).collect()}
    times = {k: sorted(r[1] * 10 + r[2] % 7 for r in g) for k, g in ordered(data).items()}
    assert got == {k: (len(t), min(b - a for a, b in zip(t, t[1:], strict=False))) for k, t in times.items()}
    spans = df.withColumn("end", F.col("at") + F.col("id") % 50)
    got = {r.k: (r.intervals, r.overlapping, r.monotone) for r in runs.overlaps(spans, key=["k"], start="at", end="end").collect()}
    want = {}
    for k, group in ordered(data).items():
        s, over, back, seen = sorted((r[1], r[1] + r[2] % 50) for r in group), 0, 0, None
        for a, b in s:
            over, back = over + (seen is not None and a < seen), back + (seen is not None and b < seen)
            seen = b if seen is None else max(seen, b)
        want[k] = (len(s), over, back == 0)
    assert got == want
