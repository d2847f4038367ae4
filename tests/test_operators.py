import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidlake import plans, queries, schemas
from evidlake.operators import evaluation, evidence, hybrid, runs, usage, vector, windows
from evidlake.operators import text as search
from evidlake.scope import TenantScope

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bounds():
    assert windows.parse_bound(None) is None and windows.parse_bound("") is None
    assert windows.parse_bound("2024-12-31", upper=True).value == datetime(2025, 1, 1)
    assert windows.parse_bound("2024-12-31").value == datetime(2024, 12, 31)
    assert windows.parse_bound("2024-12-31T10:00:00+02:00", upper=True).value == datetime(2024, 12, 31, 8)
    with pytest.raises(ValueError):
        windows.parse_bound("last week")
    said = windows.describe("merged_at", windows.parse_bound("2024-01-01"), windows.parse_bound("2024-12-31", upper=True))
    assert said == 'merged_at >= 2024-01-01T00:00:00Z and merged_at < 2025-01-01T00:00:00Z (until="2024-12-31" was read as the whole of that day)'


def test_release_diff_counts_and_labels(spark):
    commits = spark.createDataFrame([("sha_early", "2026-01-15"), ("sha_w1", "2026-02-05"), ("sha_w2", "2026-02-12"), ("sha_w3", "2026-02-20"), ("sha_late", "2026-04-15")], "sha string, d string").select("sha", F.to_timestamp("d").alias("committed_at"))
    releases = spark.createDataFrame([("v1.0", "2026-01-01"), ("java-0.2.8-alpha", "2026-02-01"), ("java-0.2.9-alpha", "2026-02-10"), ("v2.0", "2026-03-01"), ("java_x", None)], "tag string, d string").select("tag", F.to_timestamp("d").alias("published_at"))
    assert evidence.commits_between(commits, evidence.release_window(releases, "v1.0", "v2.0")).count() == 4
    assert [r.tag for r in evidence.release_page(evidence.releases(releases, "java-")).collect()] == ["java-0.2.9-alpha", "java-0.2.8-alpha"]
    assert [r.tag for r in evidence.release_page(evidence.releases(releases)).collect()][-1] == "java_x"
    issues = spark.createDataFrame([(4211, ["bug", "regression"], "2026-03-10"), (4212, ["documentation"], "2026-03-11"), (4213, ["Build"], "2026-03-12"), (4214, ["Bug"], "2026-03-13")], "number int, labels array<string>, d string").withColumn("created_at", F.to_timestamp("d"))
    n = lambda *a: evidence.count(issues, "created_at", None, None, *a).first().n
    assert (n(["bug"]), n(["build"]), n()) == (2, 1, 4)
    with pytest.raises(ValueError):
        evidence.count(commits, "committed_at", labels=["x"])
    with pytest.raises(ValueError):
        evidence.date_column("commit", "merged")
    assert (evidence.clamp(None, 50, 300), evidence.clamp(0, 50, 300), evidence.clamp(999, 50, 300)) == (50, 1, 300)


def test_fixes_skip_prefixes_and_earlier_merges(spark):
    t = lambda c: F.to_timestamp(c)
    pulls = spark.createDataFrame([(901, "x", "about #42110", "2026-03-12"), (900, "Fixes #4211.", "", "2026-03-15"), (902, "#4211", "", None), (6138, "#11222", "", "2025-05-07"), (7400, "", "see #11222, #11222", "2026-04-02")], "number int, title string, body string, d string").select("number", "title", "body", t("d").alias("merged_at"))
    issues = spark.createDataFrame([(4211, "2026-03-10"), (11222, "2026-03-26"), (5, "2026-01-01")], "number int, d string").select("number", t("d").alias("created_at"))
    assert {r.number: r.fixed_by for r in evidence.fixed_by(issues, pulls).collect()} == {4211: 900, 11222: 7400, 5: None}


def test_as_of_by_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(4), rng.randrange(50)) for i in range(60)]
    right = [(100 + i, rng.randrange(5), rng.randrange(50)) for i in range(60)]
    left += [(900, None, 3), (901, 2, None)]
    right += [(800, None, 9), (801, 2, None), (None, 3, 0)]
    for width in (1, 7, 1000):
        got = evidence.next_after(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "v int, k int, u int"), ["k"], "t", "u", "v", bucket=lambda t, w=width: F.floor(t / w))
        want = [(i, k, t, min(((u, v) for v, x, u in right if None not in (v, x, u, k, t) and x == k and u >= t), default=(0, None))[1]) for i, k, t in left]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_next_after_of_one_hot_key(spark):
    n = 200_000
    left = spark.range(n).selectExpr("id as i", "1 as k", "timestamp_seconds(id * 10) as t")
    right = spark.range(n).selectExpr("id as v", "1 as k", "timestamp_seconds(id * 10 + 5) as u")
    got = evidence.next_after(left, right, ["k"], "t", "u", "v")
    assert got.where("v is distinct from i").count() == 0 and got.count() == n
    assert "unboundedfollowing" not in plans.plan_text(got).lower().replace(" ", "").replace("_", "")


def test_scopes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, chunk_id int")
    scope = lambda t: TenantScope(t, lambda name: df)
    assert rows(scope("a").table("x")) == [("a", 1)] and rows(scope(None).table("x")) == []
    assert scope("a").check_write(df.where("chunk_id = 1")).count() == 1
    with pytest.raises(Exception, match="another tenant"):
        scope("a").check_write(df).collect()
    with pytest.raises(Exception, match="no parent"):
        scope("b").check_write(df.where("chunk_id = 2"), parent=df.where("chunk_id = 1")).collect()


def test_vector_search_by_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((200, 8))
    m[7] = m[3]
    m[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "chunk_id long, embedding array<float>")
    m = m.astype(np.float32).astype(float)
    for q in (3, 9, 50):
        cos = [(-(m[i] @ m[q]) / (np.linalg.norm(m[i]) * np.linalg.norm(m[q])) if i != 9 and q != 9 else 0.0, i) for i in range(200) if i != 9]
        want = [i for _, i in sorted((round(c, 12), i) for c, i in cos)][:5]
        if q != 9:
            assert [r.chunk_id for r in vector.exact_topk(df, m[q].tolist(), 5).collect()] == want
        got = vector.batch_topk(df.where(F.col("chunk_id") == q).select(F.col("chunk_id").alias("qid"), "embedding"), df, 5)
        assert [r.chunk_id for r in got.orderBy("rank").collect()] == want
    several = df.where("chunk_id % 20 = 3").select(F.col("chunk_id").alias("qid"), "embedding")
    assert rows(vector.batch_topk(several, df, 4, block=3)) == rows(vector.batch_topk(several, df.repartition(5), 4))
    near = vector.lsh_topk(several, df, 4, bits=3, tables=16)
    exact = {(r.qid, r.chunk_id) for r in vector.batch_topk(several, df, 4).collect()}
    assert len(exact & {(r.qid, r.chunk_id) for r in near.collect()}) >= 0.9 * len(exact)
    for k, v in ((0, [1.0] * 8), (-1, [1.0] * 8), (3, [1.0] * 7)):
        with pytest.raises(ValueError):
            vector.check_request(k, v, 8)


def test_vector_search_with_repeated_and_null_query_ids(spark):
    m = np.random.default_rng(2).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id long, embedding array<double>")
    asked = [(None, 0), (None, 1), (None, 2), (None, 3), (5, 4), (5, 5), (5, 6), (5, 6), (6, 7), (6, 7), (7, 8)]
    queries = spark.createDataFrame([(q, [float(x) for x in m[i]]) for q, i in asked] + [(8, None)], "qid long, embedding array<double>")
    want = []
    for q, i in set(asked):
        cos = m @ m[i] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[i])
        want += [(q, int(c), n + 1) for n, c in enumerate(np.argsort(-cos)[:4])]
    for block in (1, 2, 3, 4096):
        got = [(r.qid, r.chunk_id, r.rank) for r in vector.batch_topk(queries, df.repartition(3), 4, block=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert vector.batch_topk(queries.where("qid = 8"), df, 4).collect() == vector.batch_topk(queries, df.limit(0), 4).collect() == []


def test_a_hot_key_of_the_cursor_is_spread_over_tasks(spark):
    rng = np.random.default_rng(3)
    data = [(["a", "a", "a", None][i % 4], int(i), None if i % 7 == 0 else float(x)) for i, x in enumerate(rng.standard_normal(400))]
    got = usage.running_max(spark.createDataFrame(data, "k string, i long, v double").repartition(3), key=["k"], order=["i"], value="v")
    want, most = {}, {}
    for k, i, v in data:
        most[k] = max((x for x in (most.get(k), v) if x is not None), default=None)
        want[i] = most[k]
    assert got.columns == ["k", "i", "v", "cursor"] and {r.i: r.cursor for r in got.collect()} == want
    ranges = got.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()})
    assert ranges.where("k = 'a'").select("_range").distinct().count() > 1


def test_web_search_syntax():
    s = search.read_search('planner "null reference" or crash -test -"slow path" the')
    assert s.any_of == [[("planner",), ("null", "refer")], [("crash",)]] and s.none_of == [("test",), ("slow", "path")]
    assert search.read_search('"unclosed or - ""').any_of and search.read_search("").any_of == []


def test_cover_density():
    assert search.cover_density([[1], [2]]) == 1.0
    assert search.cover_density([[1], [4]]) == pytest.approx((2 / 4) / 3)
    assert search.cover_density([[1, 10], [3]]) == pytest.approx((2 / 3) / 2 + (2 / 8) / 7) and search.cover_density([[1, 10], [2, 9]]) == 2.0
    assert search.cover_density([[1], []]) == 0.0 and search.cover_density([[3, 8]]) == 2.0


def test_ranked_search_and_index(spark):
    c = spark.createDataFrame([(1, "The planner crashed with a null reference"), (2, "null pointers; the reference planner"), (3, "macOS installation steps"), (4, "Planners crash. crash in test"), (5, None)], "chunk_id long, content string")
    ids = lambda q: {r.chunk_id for r in search.ranked(c, q).collect()}
    assert ids("planner null reference") == {1, 2} and ids('planner "null reference"') == {1} and ids("crash -test") == {1} and ids("installation or crash") == {1, 3, 4} and ids("-planner") == {3, 5} and ids("") == set()
    score = {r.chunk_id: r.text_score for r in search.ranked(c, "null reference").collect()}
    assert score[1] > score[2] > 0
    index = search.postings(c)
    assert {r.term: r.positions for r in index.where("chunk_id = 4").collect()}["crash"] == [2, 3]
    assert {r.chunk_id for r in search.search_postings(index, ["crashed", "planning"]).collect()} == set()
    assert {r.chunk_id: r.text_score for r in search.search_postings(index, ["crashes", "planner"]).collect()} == {1: 2, 4: 3}


@pytest.mark.parametrize("n", [5, 60])
def test_text_matches_are_counted_beyond_the_pool(spark, n):
    c = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("issue").alias("entity_type"), F.lit("k").alias("entity_key"), F.lit("rare term here").alias("content"))
    e = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    r = hybrid.Request("rare term", [1.0, 0.0], k=8)
    out = hybrid.retrieve(c, e, r).collect()
    assert len(out) == min(n, 8) and all(x.text_match_count == n and x.blended == pytest.approx(0.4) for x in out)
    said = hybrid.notes(len(out), n, r)
    assert (len(said) == 1) and ("cut before blending" in said[0]) == (n > r.pool)


def test_hybrid_cover_density_query(spark):
    got = queries.hybrid_topk_cd(spark, SF).collect()
    assert len(got) == 15 and got[0].text_match_count > 0 and [r.blended for r in got] == sorted((r.blended for r in got), reverse=True)


def test_scores_of_a_question(spark):
    hit = "array<struct<artefact:string,score:double>>"
    hits = [("issue:7", 0.9), ("commit:abc", 0.8), ("issue:7", 0.85), ("pull_request:3", 0.7), ("commit:abc", 0.95)]
    results = spark.createDataFrame([("q1", "A", hits, 5.0, None), ("q1", "B", [], 7.0, None), ("q1", "C", hits, 1.0, ""), ("q2", "A", [("commit:m", 0.5)] * 60 + [("issue:9", 0.1)], 5.0, None)], f"qid string, arm string, hits {hit}, ms double, error string")
    questions = spark.createDataFrame([("q1", "commit:abc", "x"), ("q2", "pull_request:1", "x")], "qid string, target string, entity_type string")
    links = spark.createDataFrame([("pull_request:1", ["commit:m"])], "artefact string, linked array<string>")
    got = {(r.qid, r.arm): (r.top1, r.rr, r.lenient_top1, r.margin) for r in evaluation.score_results(results, questions, links).collect()}
    assert got == {("q1", "A"): (0, 0.5, 0, None), ("q1", "B"): (0, 0.0, 0, None), ("q1", "C"): (None, None, None, None), ("q2", "A"): (0, 0.0, 1, None)}
    best = evaluation.score_results(results, spark.createDataFrame([("q1", "issue:7")], "qid string, target string")).where("arm = 'A'").first()
    assert (best.top1, best.margin) == (1, pytest.approx(0.1))
    with pytest.raises(Exception, match="did not answer"):
        evaluation.determinism(results.where("arm = 'B'"), results.where("arm = 'A'")).collect()


def test_exact_bootstrap(spark):
    deltas = [random.Random(9).choice([-1.0, 0.0, 0.0, 1.0]) for _ in range(40)]
    df = spark.createDataFrame([("c", f"q{i:03}", d) for i, d in enumerate(deltas)] + [("k", "q1", 0.1), ("k", "q2", 0.1)], "comparison string, qid string, delta double").repartition(3)
    got = {r.comparison: r for r in evaluation.bootstrap_exact(df, resamples=500, seed=3).collect()}
    rng = random.Random(3)
    means = sorted(math.fsum(rng.choices(deltas, k=40)) / 40 for _ in range(500))
    assert (got["c"].ci_low, got["c"].ci_high, got["c"].n) == (round(means[12], 12), round(means[487], 12), 40)
    assert (got["k"].mean, got["k"].ci_low, got["k"].ci_high) == (0.1, 0.1, 0.1)


def test_samples_and_assembly(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, n long")
    assert rows(evaluation.largest_remainder(counts, 4)) == [("a", 1, 2), ("b", 1, 1), ("c", 1, 1)]
    want = ["a", "b", "c", "d"]
    random.Random(5).shuffle(want)
    assert evaluation.seeded_order(["d", "b", "a", "c"], 5) == want
    c = spark.createDataFrame([("x", 0, 800, "one"), ("x", 1, 800, "two"), ("x", 2, 10, "three"), ("y", 0, 3000, "abcdefgh"), ("y", 1, 1, "z")], "artefact string, chunk_index int, token_count long, content string")
    assert rows(evaluation.assemble(c)) == [("x", "one", 1610), ("y", "abcd", 3001)]


def test_gate_and_failover_boundaries(spark):
    hit = "array<struct<artefact:string,score:double>>"
    questions = spark.createDataFrame([(f"q{i}", "t") for i in range(6)], "qid string, target string")
    good = [(f"q{i}", "S2", [("t", 1.0)], 1.0, None) for i in range(6)]
    grade = lambda r, least: evaluation.gate(spark.createDataFrame(r, f"qid string, arm string, hits {hit}, ms double, error string"), questions, least=least).first()
    assert grade(good, 6).passed and not grade(good, 7).passed
    bad = grade([*good[:3], good[3], good[3], ("q4", "E1", [], 1.0, None), ("zz", "S2", [], 1.0, None)], 1)
    assert (bad.evaluated, bad.errors, bad.missing, bad.passed) == (3, 3, 1, False)
    runs = lambda f, s, z: spark.createDataFrame([("before", 500, "p")] * f + [("before", None, "p")] * 0 + [("after", 200, "primary")] * (s - z) + [("after", 200, "secondary")] * z + [("after", 429, "secondary")], "phase string, status int, region string")
    outcome = lambda *a: usage.failover(runs(*a)).first().outcome
    assert [outcome(13, 43, 1), outcome(14, 43, 1), outcome(14, 42, 1), outcome(14, 43, 0)] == ["inconclusive", "held", "did not hold", "did not hold"]


def test_reconcile_and_batches(spark):
    a = spark.createDataFrame([("x", 1000), ("y", 1000), ("z", 5)], "label string, total long")
    b = spark.createDataFrame([("x", 1019), ("y", 1021), ("w", 5)], "label string, total long")
    assert {r.label: r.within for r in usage.reconcile(a, b).collect()} == {"x": True, "y": False, "z": False, "w": False}
    df = spark.createDataFrame([(i, "a" * (i % 9)) for i in range(200)], "i int, t string")
    got = usage.batches_by_size(df, order="i", size=F.length("t"), most_rows=7, most_bytes=20).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.part, r.batch), []).append(r)
    assert len(got) == 200 and all(len(g) <= 7 and sum(len(r.t) for r in g) <= 20 for g in groups.values())


def test_costs_per_thousand(spark):
    r = spark.createDataFrame([("E2", 10, None), ("E2", 20, "x"), ("S2", 30, None), ("S2", 0, "no query vector"), ("S3", 30, None)], "arm string, query_tokens int, error string")
    rates = spark.createDataFrame([("E2", 0.02, 0.0), ("S3", 0.02, 0.001)], "arm string, per_million_tokens double, per_request double")
    got = {x.arm: x.cost_per_1000 for x in evaluation.cost_per_1000(r, rates).collect()}
    assert got["E2"] == pytest.approx(1000 * 30 * 0.02 / 1e6 / 2) and got["S2"] == 0 and got["S3"] == pytest.approx(1000 * (30 * 0.02 / 1e6 + 0.001))


def test_schemas():
    assert schemas.pending([]) == [n for n, _ in schemas.VERSIONS] and schemas.pending(["001_tenancy"])[0] == "002_evidence"
    with pytest.raises(ValueError):
        schemas.pending(["002_evidence"])
    with pytest.raises(KeyError):
        schemas.table_schema("nothing")


def test_conform(spark):
    df = spark.createDataFrame([("t", 1, "commit", "a", 0, "x", 3)], "tenant_id string, chunk_id int, entity_type string, entity_key string, chunk_index int, content string, token_count int")
    assert schemas.conform(df, "evidence_chunks").dtypes[1] == ("chunk_id", "bigint")
    with pytest.raises(ValueError, match="token_count"):
        schemas.conform(df.drop("token_count"), "evidence_chunks")


@pytest.mark.parametrize("name", ["count_with_coverage", "find_regressions", "issue_fixes", "text_topk_tf", "exact_vector_topk", "upsert_latest", "deadline_seen", "minute_usage", "paired_deltas", "link_adjacency"])
def test_plans_hold_at_scale(spark, name):
    assert plans.faults(queries.queries()[name](spark, SF)) == []


def test_plans_push_down_and_prune(spark):
    plan = plans.plan_text(queries.deadline_seen(spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan and "props" not in plan
    assert "TakeOrderedAndProject" in plans.plan_text(queries.text_topk_tf(spark, SF))
    assert "LeftSemi" in plans.plan_text(queries.hybrid_filtered(spark, SF))
    assert plans.planned_bytes(spark.range(10)) > 0


@pytest.mark.parametrize("n", [1, 16])
def test_results_hold_for_any_number_of_partitions(spark, n):
    names = ["hybrid_topk", "find_regressions", "bootstrap_ci_hash", "mrr_by_type", "largest_remainder"]
    want = {x: sorted(map(str, queries.queries()[x](spark, SF).collect())) for x in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        assert {x: sorted(map(str, queries.queries()[x](spark, SF).collect())) for x in names} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_places_in_an_order_of_any_size(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101, i) for i in range(100)] + [(None, 5, 1), (None, 4, 1)], "g int, o int, x int").repartition(5)
    got = plans.numbered(df, ["o"], ["g"]).collect()
    want = {(g, o): n for g in (None, 0, 1, 2) for n, o in enumerate(sorted(r.o for r in got if r.g == g), 1)}
    assert len(got) == 102 and all(want[r.g, r.o] == r.place for r in got)
    assert sorted(r.place for r in plans.numbered(df, ["o", "x"]).collect()) == list(range(1, 103))
    assert plans.numbered(df.where("o > 999"), ["o"]).collect() == []


def test_runs_are_refused_and_questions_drawn(spark):
    faults = runs.incomplete(spark.createDataFrame([("E1", 1), ("E1", 1), ("E1", 9)], "arm string, qid int"), spark.createDataFrame([(1,), (2,)], "qid int"), ["E1"])
    assert rows(faults) == [("E1", 1, "repeated"), ("E1", 2, "missing"), ("E1", 9, "unknown")]
    with pytest.raises(ValueError, match="the run: .*fault="):
        runs.refuse(faults, "the run")
    runs.refuse(faults.where("qid > 99"), "the run")
    hits = "array<struct<chunk_id:int,artefact:string>>"
    out = spark.createDataFrame([(0, 1, "E1", [(1, "a")], "x"), (1, 2, "E1", None, "y")], f"place int, qid int, arm string, hits {hits}, error string")
    frozen, corpus = spark.createDataFrame([(0, 1), (1, 2)], "place int, qid int"), spark.createDataFrame([(1, "a")], "chunk_id int, artefact string")
    assert [tuple(r) for r in runs.worker_faults(out, "E1", frozen, corpus).collect()] == [("all errors", None)]
    assert runs.worker_faults(out.where("qid > 9"), "E1", frozen.limit(0), corpus).collect() == []
    kinds = spark.createDataFrame([("commit", "c1", 39, "t"), ("commit", "c2", 40, "Bump x from 1 to 2"), ("commit", "c3", 40, "Mend"), ("issue", "i1", 50, "Bump")], "entity_type string, artefact string, token_count int, text string")
    assert rows(runs.draw(kinds, {"commit": 1, "issue": 1}, 3)) == [("commit", "c3", 1), ("issue", "i1", 1)]
    with pytest.raises(LookupError, match="commit"):
        runs.draw(kinds, {"commit": 2}, 3)
    assert sorted(runs.schedule({"a": 2, "b": 1}, 4)) == ["a", "a", "b"] and runs.schedule({"a": 2, "b": 1}, 4) == runs.schedule({"a": 2, "b": 1}, 4)


def test_words_are_counted_as_if_texts_were_split(spark):
    texts = ["the cat, The-the thethe 7the the7 \u00e9the the", "", None, "cat", "the\u0301 the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id int, content string")
    split = df.select("chunk_id", F.expr(r"size(filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+', 0), x -> x = 'the'))").cast("long").alias("n")).where("n > 0")
    assert rows(search.matching(df, ["the"]).select("chunk_id", "text_score")) == rows(split)
    assert rows(search.matching(df, ["the", "c++"])) == [] and rows(search.matching(df, ["the", "cat"]).select("chunk_id", "text_score")) == [(0, 5)]


def test_cover_density_search_of_the_whole_table(spark):
    """The registered query against words split, stemmed and judged one by one."""
    import pyarrow.parquet as pq

    from evidlake.functions.stem import stem

    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    wanted = search.read_search('ing or "en er" or tion er -xyzzy')
    score = {}
    for i, text in zip(t["doc_id"], t["text"], strict=True):
        index, at, word = {}, 0, ""
        for ch in (text or "").lower() + " ":
            if ch.isalpha() or ch.isnumeric():
                word += ch
            elif word:
                at += 1
                if word not in search.STOP:
                    index.setdefault(stem(word), []).append(at)
                word = ""
        found = lambda p, index=index: [x for x in index.get(p[0], []) if all(x + n in index.get(w, []) for n, w in enumerate(p))]
        ways = [c for c in wanted.any_of if all(found(p) for p in c)]
        if ways and not any(found(p) for p in wanted.none_of):
            score[i] = max(search.cover_density([found(p) for p in c]) for c in ways)
    got = queries.hybrid_topk_cd(spark, SF).collect()
    assert score and {r.text_match_count for r in got} == {len(score)}
    pool = sorted(score, key=lambda i: (-score[i], i))[:60]
    assert all(abs(r.text_score - (score[r.chunk_id] if r.chunk_id in pool else 0.0)) < 1e-9 for r in got)
