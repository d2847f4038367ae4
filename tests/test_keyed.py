import random

import pytest
from pyspark.sql import functions as F

from evidlake.streaming.keyed import Conflict, KeyedTable, upserts

SCHEMA = "k long, part string, at long, text string"


def table(spark, folder, **how):
    return KeyedTable(spark, str(folder), SCHEMA, ["k", "part"], ["at"], buckets=4, **how)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rng, state, t = random.Random(1), {}, table(spark, tmp_path / "t", fan=3)
    for n in range(8):
        rows = [(rng.randrange(12), rng.choice("ab"), rng.randrange(1000), f"{n}-{i}") for i in range(6)]
        gone = [(rng.randrange(12), rng.choice("ab")) for _ in range(3)]
        for g in gone:
            state.pop(g, None)
        for r in sorted(rows, key=lambda r: (r[2], r[3])):
            state[r[:2]] = r
        assert t.apply(f"b{n}", frame(spark, rows), spark.createDataFrame(gone, "k long, part string"))
        if n % 3 == 2:
            t.compact()
        if n in (4, 7):
            assert {tuple(r) for r in t.read().collect()} == set(state.values())
    some = [(k, p) for k in range(4) for p in "ab"]
    found = t.lookup(spark.createDataFrame(some, "k long, part string"))
    assert {tuple(r) for r in found.collect()} == {r for k, r in state.items() if k in some}
    folders = t.manifest()["folders"]
    assert len(folders) < 8 and max(f["level"] for f in folders) >= 1
    assert t.vacuum() > 0 and {tuple(r) for r in t.read().collect()} == set(state.values())


def test_a_batch_costs_its_own_rows_and_counts_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.apply("large", frame(spark, [(i, "a", 0, "x") for i in range(5000)]))
    t.apply("small", frame(spark, [(7, "a", 1, "y"), (9999, "b", 1, "z")]))
    last = t.manifest()["folders"][-1]["name"]
    assert spark.read.parquet(f"{tmp_path}/t/data/{last}").count() == 2
    assert not t.apply("small", frame(spark, [(7, "a", 1, "again")]))
    assert t.read().where("k in (7, 9999)").select("text").orderBy("text").collect() == [("y",), ("z",)]
    assert t.read(1).count() == 5000 and t.read().count() == 5001


def test_refusals_leave_the_others(spark, tmp_path):
    t = table(spark, tmp_path / "t", most_bytes=200)
    t.apply("b", frame(spark, [(1, "a", 0, "x"), (None, "a", 0, "x"), (2, None, 0, "x"), (3, "a", 0, "y" * 500)]))
    assert sorted(((r.k, r.part, r.reason, r.batch) for r in t.refusals().collect()), key=str) == [(2, None, "no key", "b"), (3, "a", "too long", "b"), (None, "a", "no key", "b")]
    assert [r.k for r in t.read().collect()] == [1]
    assert table(spark, tmp_path / "none").refusals().collect() == [] and table(spark, tmp_path / "none").read().collect() == []


def test_one_of_two_writers_fails_and_a_failed_batch_leaves_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.apply("a", frame(spark, [(1, "a", 0, "x")]))
    seen = t.version()
    t.apply("b", frame(spark, [(2, "a", 0, "x")]))
    with pytest.raises(Conflict):
        t._commit(seen, {"folders": [], "batches": {}})
    bad = frame(spark, [(3, "a", 0, "x")]).withColumn("text", F.when(F.raise_error(F.lit("broken")).isNull(), F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        t.apply("c", bad)
    assert sorted(r.k for r in t.read().collect()) == [1, 2] and t.apply("c", frame(spark, [(3, "a", 0, "x")]))


def test_streamed_batches(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan=2)
    for i in range(3):
        frame(spark, [(j, "a", i, f"{i}") for j in range(i, i + 3)]).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(upserts(t, "s")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.text) for r in t.read().collect()} == {(0, "0"), (1, "1"), (2, "2"), (3, "2"), (4, "2")}
    assert len(t.manifest()["batches"]) == 3
