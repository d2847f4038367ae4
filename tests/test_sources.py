import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from evidlake.sources import artefacts, files, paged


def commit(sha, at):
    return {"sha": sha, "html_url": "u", "commit": {"message": "m " + sha, "author": {"name": "n", "email": "e", "date": at}, "committer": {"date": at}}, "files": [{"filename": "f", "status": "added", "additions": 1, "deletions": 0}]}


@pytest.fixture
def pages(tmp_path):
    (tmp_path / "commit").mkdir()
    for n, batch in enumerate([[("c3", "2026-03-03T00:00:00Z"), ("c2", "2026-03-02T00:00:00Z")], [("c1", "2026-03-01T00:00:00Z")]]):
        (tmp_path / "commit" / f"page-{n:05d}.jsonl").write_text("\n".join(json.dumps(commit(*c)) for c in batch) + "\n")
    return str(tmp_path)


def test_replay_reads_pages_and_maps_records(spark, pages):
    spark.dataSource.register(paged.ReplaySource)
    raw = spark.read.format("evidence_replay").option("path", pages).option("kind", "commit").load()
    assert sorted(r.page for r in raw.collect()) == [0, 0, 1]
    got = {r.sha: r for r in paged.records(raw, "commit", "t").collect()}
    assert got["c2"].message == "m c2" and got["c2"].files[0].path == "f" and got["c2"].tenant_id == "t"
    none = spark.read.format("evidence_replay").option("path", pages).option("kind", "issue").load()
    assert none.collect() == []


def test_stream_cursor_never_goes_back(pages):
    r = paged._ReplayStream(pages, "commit")
    rows, one = r.read(r.initialOffset())
    assert len(list(rows)) == 2 and one == {"page": 1, "cursor": "2026-03-03T00:00:00Z"}
    rows, two = r.read(one)
    assert len(list(rows)) == 1 and two == {"page": 2, "cursor": "2026-03-03T00:00:00Z"}
    rows, end = r.read(two)
    assert list(rows) == [] and end == two
    assert len(list(r.readBetweenOffsets(r.initialOffset(), two))) == 3


def test_records_of_the_other_types(spark):
    of = lambda kind, *ps: paged.records(spark.createDataFrame([(json.dumps(p),) for p in ps], "payload string"), kind, "t").collect()
    issues = of("issue", {"number": 1, "title": "a", "body": None, "state": "open", "labels": [{"name": "bug"}], "user": {"login": "me"}, "created_at": "2026-01-01T00:00:00Z"}, {"number": 2, "pull_request": {"url": "x"}})
    assert [(r.number, r.body, r.labels, r.author) for r in issues] == [(1, "", ["bug"], "me")]
    assert of("pull_request", {"number": 3, "title": "p"})[0].base_ref == "main"
    assert of("release", {"tag_name": "v1"})[0].tag == "v1"
    assert of("commit", {"sha": "s"})[0].committed_at.year == 1970


def test_pages_are_followed_by_links():
    answers = {"a": (200, {"link": '<b>; rel="next", <z>; rel="last"', "etag": "E"}, [1]), "b": (200, {}, [2])}
    asked = []

    def fetch(url, etag):
        asked.append((url, etag))
        return answers[url]

    assert list(paged.follow(fetch, "a", "old")) == [([1], "E"), ([2], None)] and asked == [("a", "old"), ("b", None)]
    assert list(paged.follow(lambda *_: (304, {}, []), "a", "E")) == []
    with pytest.raises(OSError):
        list(paged.follow(lambda *_: (500, {}, []), "a"))


def test_rate_gate():
    clock = [0.0]
    gate = paged.RateGate(3600, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(100):
        gate.acquire()
    assert clock[0] == 0
    gate.acquire()
    assert clock[0] == pytest.approx(1.0)
    gate.observe(0, 50.0)
    gate.acquire()
    assert clock[0] >= 50
    with pytest.raises(ValueError):
        paged.RateGate(0)


def test_artefacts_are_read_strictly(spark):
    good = {"entityType": "release", "tenantId": "t", "tag": "v1", "name": None, "body": "b", "publishedAt": "2026-01-01T00:00:00Z", "targetCommitish": None, "url": "u"}
    bad = [{**good, "entityType": "commit"}, {k: v for k, v in good.items() if k != "name"}, {**good, "tag": None}, {**good, "publishedAt": "soon"}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([good, *bad])] + [(9, "[1]"), (10, "{"), (11, None)], "i int, json string")
    got = {r.i: (r.fault, r.record) for r in artefacts.read_artefacts(rows, "release").collect()}
    assert got[0][0] is None and got[0][1].tag == "v1"
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["not a release", "lacks name", "null in tag", "a field has another type"]
    assert all(got[i][0] and got[i][1] is None for i in (9, 10, 11))


def test_export_hides_addresses_and_reads_back(spark):
    spark.dataSource.register(paged.ReplaySource)
    df = paged.records(spark.createDataFrame([(json.dumps(commit("c1", "2026-03-01T00:00:00Z")),)], "payload string"), "commit", "t")
    out = df.select(artefacts.write_json("commit").alias("json"))
    parsed = json.loads(out.first().json)
    assert list(parsed)[0] == "entityType" and parsed["authorEmail"] is None and parsed["committedAt"] == "2026-03-01T00:00:00Z"
    assert artefacts.read_artefacts(out, "commit").first().fault is None
    chunks = spark.createDataFrame([("commit", "c1"), ("commit", "c1"), ("issue", "4")], "entity_type string, entity_key string")
    assert {r.file: r.chunks for r in artefacts.manifest(chunks).collect()} == {base64.urlsafe_b64encode(b"commit:c1").decode().rstrip("=") + ".json": 2, base64.urlsafe_b64encode(b"issue:4").decode().rstrip("=") + ".json": 1}
    asked = artefacts.requested(spark.createDataFrame([("commit:c1",), ("issue:9",)], "artefact string"), spark.createDataFrame([("commit:c1", "{}")], "artefact string, json string"))
    assert {r.artefact: r.json for r in asked.collect()} == {"commit:c1": "{}", "issue:9": None}


def test_queue_events(spark):
    event = {"eventType": artefacts.CREATED, "subject": "/blobServices/default/containers/artefacts-in/blobs/x.json"}
    text = json.dumps(event)
    rows = [text, json.dumps([event]), base64.b64encode(text.encode()).decode(), json.dumps([event, event]), json.dumps({**event, "eventType": "other"}), json.dumps({**event, "subject": "/elsewhere/x"}), json.dumps({**event, "subject": event["subject"][: -len("x.json")]}), "!!", "", "{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, m string").select("i", artefacts.blob_of(F.col("m")).alias("b"))
    got = [(r.b.blob, r.b.fault) for r in df.orderBy("i").collect()]
    assert [b for b, _ in got] == ["x.json"] * 3 + [None] * 7 and all(f for _, f in got[3:])


def test_json_lines_frozen_sets_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}") for i in random.Random(1).sample(range(300), 300)], "chunkId int, content string")
    files.write_json_lines(df, f"{tmp_path}/out", ["chunkId"])
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert [json.loads(x)["chunkId"] for x in lines] == list(range(300))
    assert [r.chunkId for r in files.in_order(df, ["chunkId"])][:3] == [0, 1, 2]
    path = f"{tmp_path}/q.jsonl"
    files.freeze([{"qid": "q1", "question": "é?"}], {"seed": 1}, path)
    assert files.read_frozen(spark, path, "qid string, question string").first().question == "é?"
    with open(path, "a") as f:
        f.write(" ")
    with pytest.raises(ValueError, match="frozen"):
        files.read_frozen(spark, path, "qid string")
    texts = ["ID 01234567-89AB-cdef-0123-456789abcdef", "to a.b@example.org", "the SECRET", "at Node-1.internal.example", None, "fine", "0123-internal.examples"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    what = {"hosts": ("internal.example",), "forbidden": ("secret", "")}
    got = files.identifiers(rows, ["text", "n"], **what)
    assert sorted(map(tuple, got.collect())) == [("text", "address", 1), ("text", "forbidden", 1), ("text", "guid", 1), ("text", "host", 1)]
    with pytest.raises(ValueError, match="text holds guid in 1 rows") as e:
        files.write_published(rows, f"{tmp_path}/r", ["text"], **what)
    assert "0123" not in str(e.value)
    files.write_published(rows.where("n > 3"), f"{tmp_path}/r", ["text"], **what)
    assert spark.read.json(f"{tmp_path}/r").count() == 3
    files.write_junit([("a", None), ("b", "x<y")], f"{tmp_path}/j.xml", "gate")
    assert 'failures="1"' in (tmp_path / "j.xml").read_text()
    with pytest.raises(FileExistsError):
        files.write_junit([], f"{tmp_path}/j.xml", "gate")


def test_bundles_reports_and_questions(spark, tmp_path):
    import hashlib

    (tmp_path / "b").mkdir()
    for n, t in (("a.json", "1"), ("b.json", "2"), ("c.json", "3")):
        (tmp_path / "b" / n).write_text(t)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = files.changed_files(spark, f"{tmp_path}/b", {"a.json": digest("1"), "b.json": digest("x")}, {"a.json", "b.json", "d.json"})
    assert {r.name: r.fault for r in got.collect()} == {"b.json": "changed", "c.json": "surplus", "d.json": "missing"}
    (tmp_path / "t.trx").write_text('<TestRun><Results><UnitTestResult executionId="1" testName="a" outcome="Passed"/><UnitTestResult executionId="2" testName="b" outcome="Failed"/></Results></TestRun>')
    results = files.read_test_results(spark, f"{tmp_path}/t.trx")
    assert results.count() == 2 and not files.test_results_sound(results, 2).first().sound
    assert files.test_results_sound(results.where("outcome = 'Passed'"), 1).first().sound
    (tmp_path / "g.yaml").write_text("- id: q1\n  question: why\n  category: factual\n  expected_citations: [commit:a]\n")
    assert files.read_golden(spark, f"{tmp_path}/g.yaml").first().expected_citations == ["commit:a"]
    (tmp_path / "links.jsonl").write_text('{"pullRequest":"P2","commit":"b"}\n{"pullRequest":"P1","commit":"a"}\n{"pullRequest":"P3","commit":"b"}\n')
    assert {r.artefact: r.linked for r in files.read_links(spark, f"{tmp_path}/links.jsonl").collect()}["b"] == ["P2", "P3"]


def test_indexes_are_checked_before_they_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "chunk_id string, vector array<float>")
    files.write_index(docs, f"{tmp_path}/i", 2)
    assert spark.read.parquet(f"{tmp_path}/i").count() == 2
    for bad in (docs.union(docs), docs.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0))), docs.withColumn("vector", F.array(F.lit(1.0)))):
        with pytest.raises(ValueError):
            files.write_index(bad, f"{tmp_path}/no", 2)
