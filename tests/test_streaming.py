import json

import pytest
import os
from datetime import datetime

from pyspark.sql import functions as F

from evidlake.sources import paged
from evidlake.streaming import jobs, state

SCHEMA = "k string, at int, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA)
    new = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, "q")], SCHEMA)
    once = state.upserted(old, new, key=["k"], order=["at"])
    assert rows(once) == [("a", 1, "x"), ("b", 3, "w"), ("c", 1, "q")] == rows(state.upserted(once, new, key=["k"], order=["at"]))
    total = state.added(spark.createDataFrame([("a", 1)], "k string, n long"), spark.createDataFrame([("a", 2), ("b", 5)], "k string, n long"), key=["k"], sums=["n"])
    assert rows(total) == [("a", 3), ("b", 5)]


def test_dead_letters_back_off_and_end(spark):
    now = lambda m: F.lit(datetime(2026, 1, 1, 0, m))
    letters = spark.createDataFrame([], "chunk_id long, attempts int, last_error string, next_attempt_at timestamp")
    one = spark.createDataFrame([(7, "boom")], "chunk_id long, error string")
    minutes = []
    for _ in range(5):
        letters = state.failed(letters, one, now(0))
        minutes.append(letters.first().next_attempt_at.minute)
    assert minutes == [0, 1, 2, 4, 8]
    assert state.due(letters, now(59)).count() == 0
    third = state.failed(state.failed(spark.createDataFrame([], letters.schema), one, now(0)), one, now(0))
    assert (state.due(third, now(0)).count(), state.due(third, now(1)).count()) == (0, 1)
    assert state.succeeded(third, one).count() == 0


def test_versions_swap_as_a_whole(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.current() is None and t.read().count() == 0
    t.replace(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    seen = t.read()
    t.replace(state.upserted(t.read(), spark.createDataFrame([("a", 2, "y")], SCHEMA), key=["k"], order=["at"]))
    assert rows(t.read()) == [("a", 2, "y")] and rows(seen) == [("a", 1, "x")]
    spark.createDataFrame([("z", 9, "lost")], SCHEMA).write.parquet(f"{tmp_path}/t/v-000000000009-dead")  # a write without its mark
    assert rows(t.read()) == [("a", 2, "y")]


def test_ingest_resumes_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(paged.ReplaySource)
    (tmp_path / "p" / "release").mkdir(parents=True)
    put = lambda n, *tags: (tmp_path / "p" / "release" / f"page-{n:05d}.jsonl").write_text("".join(json.dumps({"tag_name": t, "name": f"{t} on {n}"}) + "\n" for t in tags))
    put(0, "v1", "v2")
    table = state.VersionedTable(spark, f"file://{tmp_path}/t", "tenant_id string, tag string, name string, body string, published_at timestamp, target_commitish string, url string")

    def run():
        stream = spark.readStream.format("evidence_replay").option("path", f"{tmp_path}/p").option("kind", "release").load()
        jobs.ingest(stream, table, ["tenant_id", "tag"], ["name"], f"{tmp_path}/c", lambda df: paged.records(df, "release", "t")).awaitTermination()

    run()
    version = table.current()
    assert {r.tag: r.name for r in table.read().collect()} == {"v1": "v1 on 0", "v2": "v2 on 0"}
    run()
    assert table.current() == version
    put(1, "v2", "v3")
    run()
    assert {r.tag: r.name for r in table.read().collect()} == {"v1": "v1 on 0", "v2": "v2 on 1", "v3": "v3 on 1"}


def test_reindex_replaces_an_artefact(spark, tmp_path):
    index = state.VersionedTable(spark, f"file://{tmp_path}/i", "chunk_id string, artefact string, content string")
    make = lambda n: lambda batch: batch.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "artefact").select(F.concat_ws("-", "artefact", F.col("i").cast("string")).alias("chunk_id"), "artefact", F.lit("c").alias("content"))
    a, b = (spark.createDataFrame([(x,)], "artefact string") for x in "ab")
    jobs.reindex(a, index, make(3))
    jobs.reindex(b, index, make(1))
    jobs.reindex(a, index, make(2))
    jobs.reindex(a, index, make(2))
    assert sorted(r.chunk_id for r in index.read().collect()) == ["a-0", "a-1", "b-0"]


def test_bad_texts_are_found_one_by_one(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(40)], "chunk_id long, content string")
    got = {r.chunk_id: (r.embedding, r.error) for r in jobs.embed_or_fail(chunks, embed, 8).collect()}
    assert got[5] == (None, "ValueError: no") and all(got[i] == ([float(i)], None) for i in range(40) if i != 5)


def _stream(spark, tmp_path, schema, batches):
    (tmp_path / "in").mkdir()
    for i, b in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps(x) + "\n" for x in b))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in")


def _run(spark, df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_minutes_are_summed_until_the_watermark(spark, tmp_path):
    e = lambda t, n: {"ts": f"2026-01-01T{t}", "caller": "x", "tokens": n}
    s = _stream(spark, tmp_path, "ts timestamp, caller string, tokens long", [[e("00:00:10", 1), e("00:00:50", 2)], [e("00:00:30", 4), e("00:30:00", 8)], [e("00:30:01", 1)], [e("00:00:40", 100), e("01:00:00", 16)]])
    got = {r.minute.minute: r.tokens for r in _run(spark, jobs.minute_usage(s), "minutes", "append", tmp_path)}
    assert got == {0: 7, 30: 9}


def test_three_failures_poison(spark, tmp_path):
    s = _stream(spark, tmp_path, "message string", [[{"message": "a"}, {"message": "b"}], [{"message": "a"}], [{"message": "a"}]])
    got = [(r.message, r.tries, r.poisoned) for r in _run(spark, jobs.tries_then_poison(s), "tries", "update", tmp_path)]
    assert sorted(got) == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, False)]


def test_repeated_events_count_once(spark, tmp_path):
    s = _stream(spark, tmp_path, "id string, ts timestamp", [[{"id": "a", "ts": "2026-01-01T00:00:00"}], [{"id": "a", "ts": "2026-01-01T00:00:01"}, {"id": "b", "ts": "2026-01-01T00:00:02"}]])
    assert sorted(r.id for r in _run(spark, jobs.once_only(s, ["id"]), "once", "append", tmp_path)) == ["a", "b"]


def test_evidence_is_ingested_in_order_with_totals(spark, tmp_path):
    seen, sources = [], {}
    for kind, n in (("commit", 3), ("release", 2)):
        spark.range(n).selectExpr("id as k", "1 as v").write.parquet(f"{tmp_path}/in/{kind}")
        table = state.VersionedTable(spark, f"file://{tmp_path}/{kind}", "k long, v int")
        put = table.replace
        table.replace = lambda df, kind=kind, put=put: (seen.append(kind), put(df))
        sources[kind] = (spark.readStream.schema("k long, v int").parquet(f"{tmp_path}/in/{kind}"), table, ["k"], ["v"])
    assert jobs.ingest_in_order(sources, f"{tmp_path}/c") == {"release": 2, "commit": 3}
    assert seen == sorted(seen, key=jobs.INGEST_ORDER.index) and set(seen) == {"release", "commit"}
    assert jobs.ingest_in_order(sources, f"{tmp_path}/c") == {"release": 0, "commit": 0}
    with pytest.raises(ValueError, match="tag"):
        jobs.ingest_in_order({"tag": sources["commit"]}, f"{tmp_path}/c")
