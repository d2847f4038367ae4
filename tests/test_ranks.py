import math
import random

from pyspark.sql import functions as F

from evidlake.plans.ranks import at_ranks, middle, nearest, percent_text


def test_ranks_of_odd_distributions(spark):
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(3000)], "crowded": [1e300, -1e300] + [1 + i * 2**-52 for i in range(500)], "one": [7.0], None: [0.0, -0.0, 5e-324, -5e-324] * 3,
        "steep": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)], "ties": [2.0] * 900 + [1.0] * 50 + [3.0] * 50,
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    lower, upper = middle()
    got = {r.g: tuple(r)[1:] for r in at_ranks(df, "x", {"lo": nearest(0), "p50": nearest(50), "p95": nearest(95), "hi": F.col("n"), "a": lower, "b": upper}, ["g"]).collect()}
    want = {}
    for g, xs in groups.items():
        s, n = sorted(xs), len(xs)
        at = lambda p: s[max(1, math.ceil(p * n / 100)) - 1]  # noqa: B023, E731
        want[g] = (n, s[0], at(50), at(95), s[-1], s[(n + 1) // 2 - 1], s[n // 2])
    assert got == want


def test_whole_numbers_and_texts(spark):
    big = [2**62 + i for i in range(300)] + [-(2**62)]
    df = spark.createDataFrame([("a", x) for x in big], "g string, x long")
    r = at_ranks(df, "x", {"p7": nearest(7), "p99": nearest(99)}).first()
    s = sorted(big)
    assert (r.n, r.p7, r.p99) == (301, s[math.ceil(301 * 7 / 100) - 1], s[math.ceil(301 * 99 / 100) - 1])
    assert at_ranks(df.where("g = 'z'"), "x", {"p7": nearest(7)}, ["g"]).collect() == []
    texts = percent_text(df, "x", {"p50": 50}, ["g"], spark.createDataFrame([("a",), ("b",)], "g string"))
    assert sorted(map(tuple, texts.collect())) == [("a", str(s[150])), ("b", "n/a")]
