from datetime import UTC, datetime, timedelta

import pytest

from evidlake.streaming import timers

START = datetime(2024, 1, 1, tzinfo=UTC)


def replay(spark, folder, schema, batches, apply):
    """Runs a stream over files, one micro-batch each, and returns all rows that it gave."""
    for i, rows in enumerate(batches):
        timed = [(*r[:-1], START + timedelta(seconds=r[-1])) for r in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.parquet(f"{folder}/part/{i}")
        (next((folder / "part" / str(i)).glob("*.parquet"))).rename(folder / f"{i:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out_{abs(hash(str(folder)))}"
    q = apply(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    seconds = lambda t: round((t.replace(tzinfo=UTC) - START).total_seconds())
    return [(*tuple(r)[:-1], seconds(r["at"])) for r in spark.table(name).collect()]


@pytest.fixture()
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


def test_failures_come_back_after_a_while_and_the_third_poisons(spark, inbox):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    tick = lambda t: ("tick", True, t)
    batches = [[("a", False, 0), ("b", True, 1), ("c", False, 2)], [tick(20)], [tick(40)], [("a", False, 45), ("c", True, 46)], [tick(100)], [("a", False, 110), ("a", False, 111)], [tick(200)], [tick(300)]]
    got = replay(spark, inbox, "message string, ok boolean, ts timestamp", batches, timers.redelivered)
    assert sorted(r for r in got if r[0] != "tick") == [("a", "poisoned", 3, 110), ("a", "visible", 1, 30), ("a", "visible", 2, 75), ("b", "done", 1, 1), ("c", "done", 2, 46), ("c", "visible", 1, 32)]


def test_uploads_are_judged_at_their_deadline(spark, inbox):
    tick = lambda t: ("tick", "missing", t)
    batches = [
        [("seen", "upload", 0), ("slow", "upload", 0), ("gone", "upload", 1), ("blind", "upload", 2), ("early", "seen", 3)], [("seen", "missing", 10), ("blind", "unread", 12), ("early", "upload", 3)], [("seen", "seen", 50), ("gone", "missing", 60), ("blind", "unread", 70)],
        [tick(115)], [("slow", "seen", 121)], [tick(200)], [tick(400)], [tick(800)],
    ]
    got = replay(spark, inbox, "key string, kind string, ts timestamp", batches, timers.watched)
    assert sorted(r for r in got if r[0] != "tick") == [("blind", "unjudged", 122), ("early", "in time", 3), ("gone", "late", 121), ("seen", "in time", 50), ("slow", "late", 120)]
