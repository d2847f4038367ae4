from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidlake import schemas
from evidlake.operators import evaluation, usage
from evidlake.scope import TenantScope
from evidlake.streaming import state
from evidlake.tools import registry

D = datetime


@pytest.fixture(scope="module")
def scope(spark):
    rows = {
        "commits": [("t", f"s{i}", f"message {i}", "n", None, D(2026, 2, i + 1), D(2026, 2, i + 1), "u", []) for i in range(5)] + [("other", "x", "m", None, None, D(2026, 2, 2), D(2026, 2, 2), "u", [])],
        "releases": [("t", "v1.0", None, "", D(2026, 1, 1), None, "u"), ("t", "v2.0", None, "", D(2026, 2, 3), None, "u"), ("t", "draft", None, "", None, None, "u")],
        "issues": [("t", 1, "Crash", "body", "open", ["bug"], None, D(2026, 1, 5), None, "u"), ("t", 2, "Docs", "", "closed", ["Docs"], None, D(2026, 1, 6), None, "u")],
        "pull_requests": [("t", 9, "Fixes #1", "", "closed", D(2026, 1, 7), "s1", "main", "f", None, D(2026, 1, 6), "u")],
        "files_changed": [("t", "s1", "src/Planner.cs", "modified", 1, 1)],
        "evidence_chunks": [("t", 10 + i, "commit", f"s{i}", 0, f"the planner failed {'badly' * (i == 1)}", 5) for i in range(5)],
        "embeddings": [("t", 10 + i, "m", 2, [1.0, i * 0.1]) for i in range(5)],
    }
    frames = {n: spark.createDataFrame(r, schemas.table_schema(n)) for n, r in rows.items()}
    return TenantScope("t", frames.__getitem__)


def test_tools(scope):
    t = registry(lambda q: [1.0, 0.0])
    got = t["count_evidence"](scope, {"entity_type": "issue", "date_field": "created", "until": "2026-01-05", "labels": "BUG"})
    assert got.matched == 1 and "whole of that day" in got.notes[0] and got.coverage["complete_for_window"]
    assert t["count_evidence"](scope, {"entity_type": "pull_request", "date_field": "merged"}).matched == 1
    got = t["list_releases"](scope, {"limit": 1})
    assert (got.matched, len(got.rows), got.truncated, got.rows[0]["tag"]) == (3, 1, True, "v2.0")
    got = t["diff_between_releases"](scope, {"from_tag": "v1.0", "to_tag": "v2.0"})
    assert got.matched == 3 and [r["sha"] for r in got.rows] == ["s0", "s1", "s2"] and not got.truncated
    assert t["find_regressions"](scope, {"area": "crash"}).rows[0]["fixed_by"] == 9
    assert t["get_issue"](scope, {"number": 2}).rows[0]["title"] == "Docs"
    got = t["search_commits"](scope, {"query": "planner failure", "limit": 3})
    assert (len(got.rows), got.matched) == (3, None) and {r["sha"] if "sha" in r else r["entity_key"] for r in got.rows} <= {f"s{i}" for i in range(5)}
    got = t["search_commits"](scope, {"query": "planner", "path": "planner.CS", "since": "2026-02-02", "until": "2026-02-02"})
    assert [r["entity_key"] for r in got.rows] == ["s1"] and got.matched == 1


@pytest.mark.parametrize(
    ("tool", "args"),
    [("count_evidence", {"entity_type": "commit", "date_field": "merged"}), ("count_evidence", {"entity_type": "issue", "labels": []}), ("count_evidence", {"entity_type": "release", "date_field": "published", "labels": ["x"]}), ("count_evidence", {"entity_type": "issue", "since": "soon"}), ("diff_between_releases", {"from_tag": "v1.0", "to_tag": "draft"}), ("get_issue", {"number": "2"}), ("get_issue", {"number": 77}), ("search_commits", {"query": " "}), ("list_releases", {"limit": 1.5})],
)
def test_bad_arguments_are_results(scope, tool, args):
    got = registry(lambda q: [1.0, 0.0])[tool](scope, args)
    assert got.error and not got.rows


def test_a_tenant_sees_only_its_own(scope):
    assert registry(lambda q: [1.0, 0.0])["count_evidence"](TenantScope(None, scope.open_table), {"entity_type": "commit", "date_field": "committed"}).matched == 0
    assert registry(lambda q: [1.0, 0.0])["count_evidence"](scope, {"entity_type": "commit", "date_field": "committed"}).matched == 5


def test_checkpoints(spark):
    c = spark.createDataFrame([("t", "commit", "c1", "e1", 5), ("t", "issue", "c2", None, 3)], "tenant_id string, entity_type string, cursor_value string, etag string, items_seen long")
    b = spark.createDataFrame([("t", "commit", None, "e2", 2), ("t", "release", "r", None, 1)], "tenant_id string, entity_type string, cursor_value string, etag string, items long")
    got = {r.entity_type: tuple(r)[2:] for r in state.saved_checkpoint(c, b).collect()}
    assert got == {"commit": ("c1", "e2", 7), "issue": ("c2", None, 3), "release": ("r", None, 1)}
    kept, gone = state.reset_checkpoints(c, ["commit"])
    assert {r.entity_type: (r.cursor_value, r.etag, r.items_seen) for r in kept.collect()} == {"commit": (None, None, 5), "issue": ("c2", None, 3)}
    assert tuple(gone.first()) == ("t", "commit", "c1", "e1")


def test_usage_checks(spark):
    r = spark.createDataFrame([("a", i, 200, 10_000) for i in range(5)] + [("a", 6, 403, 0), ("b", 1, 403, 0)], "caller string, seq int, status int, tokens int")
    assert {x.caller: (x.used, x.enough) for x in usage.first_denied(r, key=["caller"], order="seq").collect()} == {"a": (50_000, True), "b": (0, False)}
    rec = spark.createDataFrame([("a", 1, 2), ("a", 3, 4)], "caller string, prompt_tokens int, completion_tokens int")
    entered = spark.createDataFrame([("z", 5)], "label string, total long")
    assert {x.label: x.total for x in usage.client_totals(rec, entered).collect()} == {"a": 10, "z": 5}
    with pytest.raises(Exception, match="both recorded"):
        usage.client_totals(rec, spark.createDataFrame([("a", 5)], "label string, total long")).collect()
    s = spark.createDataFrame([("A", 0.5, None), ("A", 1.5, None), ("B", 1.0, "x")], "arm string, cost_usd double, error string")
    assert {x.arm: x.price for x in usage.price_run(s, 10).collect()} == {"A": 10.0, "B": None}
    m = spark.createDataFrame([(D(2026, 1, 1, 0, 1), "tok", {"Caller": "a"}, 1.0), (D(2026, 1, 1, 0, 2), "tok", {}, 2.0), (D(2026, 1, 1, 0, 2), "no", {"Caller": "a"}, 4.0), (D(2026, 1, 1, 1), "tok", {"Caller": "a"}, 8.0)], "timestamp timestamp, name string, dimensions map<string,string>, value double")
    assert {x.caller: x.total for x in usage.metric_totals(m, D(2026, 1, 1), D(2026, 1, 1, 1), name="tok", dimension="Caller").collect()} == {"a": 1.0, "": 2.0}
    o = spark.createDataFrame([("a", D(2026, 1, 1, 0, 1), 3.0), ("a", D(2026, 1, 1, 0, 1), float("nan")), ("a", D(2026, 1, 1, 0, 1), float("inf")), ("b", D(2026, 1, 1, 0, 1), 1.0)], "caller string, timestamp timestamp, total double")
    assert usage.owner_rows(o, "a", D(2026, 1, 1), D(2026, 1, 1, 0, 10)).count() == 1
    with pytest.raises(ValueError):
        usage.owner_rows(o, "a", D(2026, 1, 1), D(2026, 1, 2))
    u = spark.createDataFrame([(D(2026, 1, 1), D(2026, 1, 1, 0, 0, 11)), (D(2026, 1, 1), D(2026, 1, 1, 0, 0, 5)), (D(2026, 1, 1), None)], "uploaded_at timestamp, seen_at timestamp")
    assert tuple(usage.latency_summary(u).first()) == (2, 8.0, 11.0)


def test_outcome_rules(spark):
    o = spark.createDataFrame([(1, "A", ["p"], False, None, None), (2, "A", ["q"], False, None, None), (3, "A", ["p", "p"], False, None, None), (4, "A", [], False, "input", None), (5, "A", ["p"], True, None, None), (6, "A", ["q"], False, None, "boom")], "i int, arm string, providers array<string>, degraded boolean, filtered_stage string, error string")
    assert {r.i: r.error for r in evaluation.admissible(o, {"A": "p"}).collect()} == {1: None, 2: "answered by another provider", 3: "answered by another provider", 4: None, 5: "degraded", 6: "boom"}
    j = spark.createDataFrame([(i, t) for i, t in enumerate(['{"score": 0.5}', '{"score": 2}', '{"score": "NaN"}', "no", '{"score": 1}'])], "i int, t string")
    assert [r.s for r in j.select("i", evaluation.judge_score(F.col("t")).alias("s")).orderBy("i").collect()] == [0.5, None, None, None, 1.0]
    q = lambda *ids: spark.createDataFrame([(i,) for i in ids], "qid string")
    assert evaluation.audit(q("a", "b"), q("a", "b"), 2).first().sound and tuple(evaluation.audit(q("a", "b"), q("b", "c"), 1).first()) == (2, 1, 1, False)
    lists = lambda *xs: spark.createDataFrame(list(xs), "qid string, items array<string>")
    assert {r.qid: r.same for r in evaluation.same_order(lists(("a", ["x", "y"]), ("b", ["x"]), ("c", ["z"])), lists(("a", ["x", "y"]), ("b", ["y"])), key="qid", items="items").collect()} == {"a": True, "b": False, "c": False}
    hits = spark.createDataFrame([("q", "A", [(1, "a"), (2, "b")])], "qid string, arm string, hits array<struct<chunk_id:int,artefact:string>>")
    assert [r.chunk_id for r in evaluation.foreign_hits(hits, spark.createDataFrame([(1, "a"), (2, "c")], "chunk_id int, artefact string")).collect()] == [2]
    a = spark.createDataFrame([(1, "see [E2] and [E9] and [E2]")], "id int, answer string")
    e = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 2, "z")], "id int, position int, artefact string")
    assert [tuple(r) for r in evaluation.resolve_markers(a, e, key=["id"]).collect()] == [(1, 2, "y")]
    faults = spark.createDataFrame([("why does it fail so often here", 0.6, True), ("short one", None, False), ("w " * 41, 0.1, False)], "q string, c double, l boolean").select(evaluation.question_faults(F.col("q"), F.col("c"), F.col("l")).alias("reasons"))
    assert {r.reason: r.n for r in evaluation.rejection_counts(faults).collect()} == {"copies its target": 1, "contains the target's key": 1, "too short": 1, "too long": 1}
    qids = [f"q{i}" for i in range(20)]
    import random

    sample = random.Random(4).sample(sorted(qids), 5)
    assert evaluation.spot_check(dict.fromkeys(sample, "fine"), qids, size=5, seed=3, round_=1) == {"fine": 5, "not_fine": 0, "passes": True}
    with pytest.raises(ValueError):
        evaluation.spot_check({"q1": "fine"}, qids, size=5, seed=3, round_=1)
