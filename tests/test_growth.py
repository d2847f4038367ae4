"""What a step holds or sends grows no faster than its input."""

import random
import tracemalloc
from datetime import datetime, timedelta

import compare
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake import oracles, plans, queries
from evidlake.operators import acceptance, evaluation, lookup, text, textindex, vector


def test_draws_are_not_sent_through_the_driver(spark):
    deltas = spark.range(3000).select(F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("metric"), "id", (F.col("id") % 11 / 10).alias("delta"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", 34_000_000)  # a page of a table that is sent, and not much more
    try:
        got = evaluation.bootstrap_hashed(deltas, by=["metric"], order="id").collect()
        whole = evaluation.bootstrap_hashed(deltas, order="id").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert {r.metric: r.n for r in got} == {"m0": 1500, "m1": 1500} and whole[0].n == 3000
    assert all(r.ci_low < r["mean"] < r.ci_high for r in [*got, *whole])


def test_starts_at_one_moment_have_one_order(spark):
    # 1 lasts from 0 to 5; 2 has no length and starts with 1; 3 is later. SQL takes 0 as what is open after both starts.
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    spans = [(day(0), day(5)), (day(0), day(0)), (day(9), day(10))]
    for rows in (spans, spans[::-1], [spans[1], spans[0], spans[2]]):
        df = spark.createDataFrame([("k", *r) for r in rows], "k string, a timestamp, b timestamp").coalesce(1)
        idle = [acceptance.sweep(df, key=["k"], start="a", end="b", highest_first=h).first().idle_seconds / 86_400 for h in (False, True)]
        assert idle == [4.0, 9.0]


def test_overlaps_are_those_of_the_sql(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    orders = [(88, 1, day(0)), (200, 1, day(0)), (9, 1, day(300)), (400, 2, day(0)), (7, 2, day(0)), (600, 2, day(3)), (4, 2, day(3)), (200, 3, day(1)), (1, 3, day(1)), (2, 3, day(1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert compare.compare(spark, con, queries.run_overlap, oracles.oracle_sql()["run_overlap"], tmp_path) == []


def test_words_are_not_shuffled_for_an_index(spark, tmp_path):
    texts = [(1, "b a b the"), (2, None), (None, "a"), (3, ""), (4, "Ünï a"), (4, "a c")]
    df = spark.createDataFrame(texts, "chunk_id long, content string")
    index = text.postings(df, stemmed=False, stop=frozenset({"the"}))
    assert "Exchange" not in plans.plan_text(index)
    assert sorted((r.chunk_id or 0, r.term, r.positions) for r in index.collect()) == [(0, "a", [1]), (1, "a", [2]), (1, "b", [1, 3]), (4, "a", [1]), (4, "a", [2]), (4, "c", [2]), (4, "ünï", [1])]
    assert [(r.chunk_id, r.text_score) for r in text.search_postings(index, ["a", "c"], stemmed=False).collect()] == [(4, 3)]


def test_texts_are_shuffled_once_for_the_stored_index(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(300))) for i in range(400)]
    df = spark.createDataFrame(texts, "chunk_id long, content string").repartition(3)
    df.write.parquet(f"{tmp_path}/texts")
    shuffled = lambda: sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = shuffled()
    index = textindex.write_index(spark.read.parquet(f"{tmp_path}/texts"), f"{tmp_path}/index", stemmed=False, stop=frozenset(), block_chunks=50)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < shuffled() - before < 1.1 * sum(len(t) for _, t in texts)
    got = {(p.id, r.term): p.positions for r in index.collect() for p in r.postings if r.term}
    want: dict = {}
    for i, t in texts:
        for at, w in enumerate(t.split(), 1):
            want.setdefault((i, w), []).append(at)
    assert got == want
    assert all((r.n, r.most) == (len(r.postings), max(len(p.positions) for p in r.postings)) and [p.id for p in r.postings] == sorted(p.id for p in r.postings) for r in index.collect())
    assert sum(r.n for r in index.where("term = ''").collect()) == 400


def test_a_task_of_the_vector_search_holds_a_bounded_product(tmp_path):
    rng = np.random.default_rng(4)
    queries_, rows = rng.integers(-3, 4, (4096, 64)).astype(float), rng.integers(-3, 4, (10_000, 64)).astype(float)
    queries_[7], rows[5], rows[9_000:9_040] = 0, 0, queries_[3]  # a query and a row without direction, and many ties over slices
    pq.write_table(pa.table({"q": range(4096), "u": range(4096), "v": list(queries_)}), f"{tmp_path}/q.parquet")
    batch = pa.RecordBatch.from_pydict({"id": np.arange(10_000)[::-1], "v": list(rows), "block": [f"{tmp_path}/q.parquet"] * 10_000})
    tracemalloc.start()
    found = list(vector._search(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
    got: dict = {}
    for r in (r for b in found for r in b.to_pylist()):
        got.setdefault(r["q"], []).append((-r["score"], r["id"]))
    norms = np.linalg.norm(rows, axis=1)
    fine, ids = norms > 0, np.arange(10_000)[::-1]
    for i in (0, 3, 7, 4095):
        s = (rows[fine] * queries_[i]).sum(axis=1) / (norms[fine] * np.linalg.norm(queries_[i])) if i != 7 else np.zeros(fine.sum())
        want = np.lexsort((ids[fine], -s))[:5]
        assert [k for _, k in sorted(got[i])] == ids[fine][want].tolist() and np.allclose([-x for x, _ in sorted(got[i])], s[want])


@pytest.mark.parametrize("sent", [10, 1000])
def test_tasks_of_a_lookup_are_as_many_as_its_rows_call_for(spark, monkeypatch, sent):
    monkeypatch.setattr(lookup, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", sent)
    commits = spark.range(400).select(F.col("id").alias("sha"), F.lit("m").alias("message"))
    files = spark.range(1200).where("id % 400 <> 6").select((F.col("id") % 400).alias("sha"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("A").alias("status"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"))
    keys = spark.range(300).select((F.col("id") * 3).alias("key"))
    out = lookup.commits_with_files(commits, files, keys.unionByName(keys))
    got = {r.key: (r.found, r.files and [f.path for f in r.files]) for r in out.collect()}
    assert got == {k: (k < 400, None if k >= 400 else [] if k == 6 else sorted(f"p{k + 400 * i}" for i in range(3))) for k in range(0, 900, 3)}
    if sent == 10:
        assert out.rdd.getNumPartitions() >= 24
