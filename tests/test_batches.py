import pytest
from pyspark.sql import functions as F

from evidlake.sources import batches


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(batches.BatchSink)


def save(df, folder, **options):
    df.write.format("capped_batches").options(**options).mode("append").save(str(folder))


def test_caps_hold_with_the_envelope():
    docs = [b"x" * n for n in (5, 5, 30, 1, 1, 1, 1, 20)]
    got = list(batches.batches(iter(docs), most_rows=3, most_bytes=45))
    assert [d for b in got for d in b] == docs
    sizes = [len(batches.HEAD + batches.BETWEEN.join(b) + batches.TAIL) for b in got]
    assert max(sizes) <= 45 and max(map(len, got)) <= 3 and [len(b) for b in got] == [2, 2, 3, 1]
    with pytest.raises(ValueError, match="fits no batch"):
        list(batches.batches(iter([b"x" * 40]), most_bytes=45))
    assert list(batches.batches(iter([]))) == []
    many = list(batches.batches(iter([b"y" * 100_000] * 1200)))
    assert max(map(len, many)) <= 500 and all(100_001 * len(b) < 12 << 20 for b in many) and sum(map(len, many)) == 1200


def test_rows_arrive_once_and_in_order(spark, tmp_path):
    df = spark.range(0, 1300, 1, 2).select("id", F.array(F.col("id") + 1.0, F.lit(2.0)).alias("v"), F.concat(F.lit("é"), F.col("id")).alias("text"))
    save(df, tmp_path / "t", id="id", vector="v")
    assert sorted((r.part, r.place, r.rows) for r in batches.sent(spark, str(tmp_path / "t")).collect()) == [(p, i, n) for p in (0, 1) for i, n in enumerate((500, 150))]
    got = batches.documents(spark, str(tmp_path / "t"), "id long, v array<double>, text string")
    assert {(r.id, tuple(r.v), r.text) for r in got.collect()} == {(i, (i + 1.0, 2.0), f"é{i}") for i in range(1300)} and got.count() == 1300
    first = [r.id for r in got.where(F.col("name").contains("-000000-")).orderBy("name").collect()]
    assert first == list(range(650))
    save(df.limit(3), tmp_path / "t", id="id", vector="v", rows="2")
    assert batches.sent(spark, str(tmp_path / "t")).count() == 6


@pytest.mark.parametrize("bad", ["vector", "twice", "null", "task"])
def test_a_failed_task_leaves_nothing_visible(spark, tmp_path, bad):
    df = spark.range(0, 40, 1, 4).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    wrong = {
        "vector": df.withColumn("v", F.when(F.col("id") == 33, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("v"))), "twice": df.withColumn("id", F.when(F.col("id") == 34, 33).otherwise(F.col("id"))),
        "null": df.withColumn("id", F.when(F.col("id") != 39, F.col("id"))), "task": df.withColumn("id", F.when(F.col("id") < 39, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long"))),
    }[bad]
    with pytest.raises(Exception, match="can't be searched|sent twice|without id|lost"):
        save(wrong, tmp_path / "t", id="id", vector="v", rows="3")
    assert batches.sent(spark, str(tmp_path / "t")).collect() == []
    save(df, tmp_path / "t", id="id", vector="v", rows="3")  # what an aborted job may have left doesn't count later either
    assert batches.documents(spark, str(tmp_path / "t"), "id long, v array<double>").count() == 40
