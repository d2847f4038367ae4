from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidlake import queries
from evidlake.operators import acceptance, grams

START = datetime(2024, 1, 1)


def at(s):
    return START + timedelta(seconds=s)


def test_sweep_of_a_hot_key(spark):
    spans = [("hot", i, i + 3) for i in range(0, 900, 1)] + [("hot", 2000, 2010), ("b", 0, 5), ("b", 5, 9), ("b", 20, 21), ("b", 9, 3), (None, 1, 1)]
    df = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in spans] + [("b", None, at(1))], "k string, a timestamp, b timestamp").repartition(5)
    got = {r.k: tuple(r)[1:] for r in acceptance.sweep(df, key=["k"], start="a", end="b").collect()}
    assert got == {"hot": (901, 3, 2000.0 - 902), "b": (3, 1, 11.0), None: (1, 0, 0.0)}


def frames(spark, *, samples=((0, 5, ["1"]), (1, 15, ["1"])), tasks=(("build", "succeeded"), ("bad", "failed")), idle=((0, 100, [], 0), (1, 130, [], 0), (2, 160, [], 0)), times=(0, 5, 10, 50, 60), result="failed", expected="failed"):
    runs = spark.createDataFrame([(1, *map(at, times), result, expected), (2, *map(at, times), None, None)], "run long, queued timestamp, begun timestamp, started timestamp, finished timestamp, ended timestamp, result string, expected string")
    return (
        runs, spark.createDataFrame([(1, p, at(t), w) for p, t, w in samples], "run long, place int, at timestamp, workers array<string>"), spark.createDataFrame([(1, *t) for t in tasks], "run long, name string, result string"),
        spark.createDataFrame([(1, p, at(t), w, q) for p, t, w, q in idle], "run long, place int, at timestamp, workers array<string>, queued int"),
    )


@pytest.mark.parametrize(
    ("how", "flags"),
    [
        ({}, (True, True, True, True)), ({"samples": ((0, 5, ["1"]), (1, 4, ["1"]))}, (False, True, True, True)), ({"samples": ((0, 5, ["1", "2"]),)}, (False, True, True, True)), ({"samples": ((0, 1, ["1"]), (1, 7, []))}, (False, True, True, True)),
        ({"samples": ()}, (False, True, True, True)), ({"times": (0, 5, 4, 50, 60)}, (False, True, True, True)), ({"tasks": (("build", "succeeded"), ("build", "succeeded"), ("bad", "failed"))}, (True, False, False, True)),
        ({"result": "succeeded"}, (True, False, False, True)), ({"result": "succeeded", "expected": "succeeded"}, (True, True, False, True)), ({"idle": ((0, 100, [], 0), (1, 129, [], 0), (2, 160, [], 0))}, (True, True, True, False)),
        ({"idle": ((0, 100, [], 0), (1, 130, [], 1), (2, 160, [], 0))}, (True, True, True, False)), ({"idle": ((0, 100, [], 0), (1, 130, [], 0))}, (True, True, True, False)),
    ],
)
def test_a_run_is_graded_by_its_facts(spark, how, flags):
    got = {r.run: tuple(r)[1:] for r in acceptance.graded(*frames(spark, **how), required=["build"], negative="bad").collect()}
    assert got[1][:4] == flags and got[2][:4] == (False, False, False, False)
    assert got[1][6] == (50.0 if flags[3] else None)


def test_the_query_tells_runs_apart(spark):
    got = queries.run_acceptance(spark, "/root/testdata/sf0.01")
    assert all(0 < n for n in got.agg(*[F.count_if(c) for c in ("on_demand", "built", "refused", "idle_after")]).first())


@pytest.mark.parametrize("pattern", ["%the%", "%m_dd%", "The%", "%x", "a\\%b%", "%ab%", "%", "nothing at all%", "%ÜNÏ%", "%end of%line%", "___"])
def test_patterns_find_what_a_scan_finds(spark, tmp_path, pattern):
    texts = ["The middle", "in the muddle x", "a%b", "aXb", "", None, "ünï", "The end of the line", "abc", "xyz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the null")], "id long, t string")
    index = grams.write_grams(rows, f"{tmp_path}/i", id_col="id", text_col="t")
    scan = rows.where(F.col("t").ilike(pattern) & F.col("id").isNotNull())
    assert sorted(r.id for r in grams.ilike(rows.where("id is not null"), index, pattern, id_col="id", text_col="t").collect()) == sorted(r.id for r in scan.collect())
