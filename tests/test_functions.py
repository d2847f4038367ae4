import base64
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidlake.functions import chunks, numbers, stem, text, vector


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in (k.rsplit("__", 1) for k in values)))
    return df.select(column.alias("x")).first().x


def each(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalise(spark):
    pairs = {
        "a\r\nb": "a\nb", "a\n\n\n\n\nb": "a\n\nb", "<!-- x -->visible": "visible", "a   \nb\t": "a\nb", None: "", " \n ": "", "a\rb": "a\nb",
        "### One\n\ntext\n\n## Two\nmore": "One\ntext\nTwo\nmore", "x\n```\n# not a heading   \n\n\n\n<!-- kept -->\n```\n# y": "x\n```\n# not a heading   \n\n\n\n<!-- kept -->\n```y",
        "``` open\n# stays  ": "``` open\n# stays", "a <!-- two\nlines --> b": "a  b", "#no heading": "#no heading", "a\n\n# h": "a\nh",
    }
    assert dict(zip(pairs, each(spark, text.normalise, list(pairs)), strict=True)) == pairs


def test_keys(spark):
    got = each(spark, text.parse_key, ["issue:12", "issue:012", "issue:0", "pull_request:2147483648", "commit:abc:d", "release:", ":x", "thing:1", None, "release:v1_0"])
    assert [tuple(x) if x else None for x in got] == [("issue", "12"), None, None, None, ("commit", "abc:d"), None, None, None, None, ("release", "v1_0")]
    names = ["release:lib/é_1", "commit:" + "a" * 90, "x"]
    assert each(spark, text.base64url, names) == [base64.urlsafe_b64encode(n.encode()).decode().rstrip("=") for n in names]
    assert each(spark, lambda c: text.from_base64url(text.base64url(c)), names) == names
    assert each(spark, text.artefact_type, ["commit:a", "none", ":a"]) == ["commit", "unknown", "unknown"]


def test_markers(spark):
    answer = "a [E1] b [E7] c [E99999999999] d [E7] [e1] [E0]"
    assert one(spark, text.markers(F.col("a")), a__string=answer) == ["1", "7", "99999999999", "7", "0"]
    assert one(spark, text.unresolved_markers(F.col("a"), F.lit(3)), a__string=answer) == ["E7", "E99999999999", "E0"]


def test_declines_and_contents(spark):
    said = ["The evidence does not contain it.", "There is no evidence, but 40 % did.", "It is 7; cannot determine more.", "Yes."]
    assert each(spark, text.declines, said) == [True, False, False, False]
    assert each(spark, text.content_words, ["The planner's null-step, with Ünïcode 123 steps steps"]) == [["planner", "null", "step", "ünïcode", "steps"]]


def test_bumps_and_leaks(spark):
    rows = [("commit", "[commit a] Bump x\nauthor: me", True), ("issue", "Bump x", False), ("pull_request", "[p] Update foo from 1 to 2\nz", True), ("pull_request", "[p] Update docs\nbody bump", False), ("commit", "[c] fix\nauthor: dependabot | x", True)]
    df = spark.createDataFrame(rows, "k string, t string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", text.routine_bump(F.col("k"), F.col("t"))).collect())
    leaks = [
        ("about 52207.", "issue", "52207", True), ("1.52207 and 522070", "issue", "52207", False), ("#52207?", "issue", "52207", True), ("what abcdef1 did", "commit", "abcdef1234", True), ("what abcdef did", "commit", "abcdef1234", False),
        ("in v3.14.2 of it", "release", "core-3.14.2-beta.4", True), ("in 3.14.21", "release", "tool-3.14.2-beta.4", False), ("look at pull/9x", "issue", "9", False), ("look at pull/9", "issue", "9", True), ("a.c", "release", "abc", False),
    ]
    df = spark.createDataFrame(leaks, "q string, k string, key string, want boolean")
    assert [(r.q, r.got) for r in df.withColumn("got", text.key_leaks(F.col("q"), F.col("k"), F.col("key"))).collect()] == [(q, w) for q, _, _, w in leaks]


def test_small_parsers(spark):
    assert one(spark, text.retry_after_seconds(F.col("m"), F.col("s")), m__string="1500", s__string="9") == 1.5
    assert one(spark, text.retry_after_seconds(F.col("m"), F.col("s")), m__string="-1", s__string="9") == 9.0
    token = "x." + base64.urlsafe_b64encode(json.dumps({"aud": "me"}).encode()).decode().rstrip("=") + ".y"
    assert each(spark, text.token_claims, [token, "nonsense"])[0] == {"aud": "me"}
    assert one(spark, text.billed_input(F.col("p"), F.col("c")), p__int=5, c__int=9) == 0
    assert each(spark, text.estimate_tokens, ["a" * 36, "🤖a", ""]) == [10, 1, 0]


def test_vectors(spark):
    assert abs(one(spark, vector.cosine(F.col("a"), F.col("b")), **{"a__array<float>": [3.0, 4.0], "b__array<float>": [4.0, 3.0]}) - 0.96) < 1e-12
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), **{"a__array<float>": [0.0], "b__array<float>": [1.0]}) is None
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), **{"a__array<float>": [1.0], "b__array<float>": [1.0, 2.0]}) is None
    assert one(spark, vector.unit(F.col("a")), **{"a__array<double>": [3.0, 4.0]}) == [0.6, 0.8]
    with pytest.raises(Exception, match="no direction"):
        one(spark, vector.strict_unit(F.col("a")), **{"a__array<double>": [0.0, 0.0]})


def test_numbers(spark):
    assert each(spark, numbers.settled, [0.09999999999999999, -2.8e-18, 2.5], "double") == [0.1, 0.0, 2.5]
    assert [str(x) for x in each(spark, numbers.settled, [-1e-18], "double")] == ["0.0"]
    assert each(spark, numbers.backoff_minutes, [0, 1, 2, 3, 4, 5], "int") == [0, 0, 1, 2, 4, 8]
    cases = [([], [], 1.0, 1.0), ([], ["a"], 1.0, 1.0), (["a"], [], 0.0, 0.0), (["a", "a", "b"], ["a"], 2 / 3, 1.0), (["a"], ["a", "x", "a"], 1.0, 2 / 3)]
    df = spark.createDataFrame(cases, "e array<string>, a array<string>, r double, p double")
    for r in df.select("r", "p", numbers.citation_recall(F.col("e"), F.col("a")).alias("gr"), numbers.citation_precision(F.col("e"), F.col("a")).alias("gp")).collect():
        assert (r.gr, r.gp) == (r.r, r.p)
    v = [(0.1, 0.01, 0.2, "difference"), (0.1, 0.0, 0.2, "inconclusive"), (0.09, 0.01, 0.2, "inconclusive"), (-0.3, -0.4, -0.1, "difference"), (None, None, None, "no data")]
    df = spark.createDataFrame(v, "m double, l double, h double, want string")
    assert all(r.want == r.v for r in df.withColumn("v", numbers.verdict(F.col("m"), F.col("l"), F.col("h"))).collect())


def test_chunks_cover_the_text_within_their_size():
    rng = random.Random(4)
    for shift in range(10):
        body = "x" * shift + "🤖" + "".join(rng.choice(["word ", "end. ", "line\n", "para\n\n", "🤖"]) for _ in range(900))
        got = chunks.chunk_text("[h] title", body)
        assert len(got) > 2 and all(c.startswith("[h] title\n") and "�" not in c for c in got)
        assert all(len(c.encode("utf-16-le")) // 2 <= chunks.MAX_CHARS for c in got)
        parts = [c.removeprefix("[h] title\n") for c in got]
        squeeze = lambda t: re.sub(r"\s+", "", t)
        at, whole = 0, squeeze(body)
        for p in map(squeeze, parts):
            found = whole.find(p, max(0, at - 400))
            assert 0 <= found <= at
            at = found + len(p)
        assert at == len(whole)
    assert chunks.chunk_text("[h]", "") == ["[h]"] and chunks.chunk_text("[h]", "short") == ["[h]\nshort"]
    assert len(chunks.chunk_text("t" * 1100, "b " * 900)) < 10


def test_chunk_headers_of_each_type(spark):
    c = spark.sql("SELECT 't' AS tenant_id, 'abcdef123456' AS sha, 'Fix it\n\nlong # tale' AS message, null AS author_name, timestamp'2026-01-15' AS committed_at, array(named_struct('path', 'a.cs', 'status', 'modified', 'additions', 4, 'deletions', 1)) AS files")
    r = chunks.chunk(chunks.sources(c, "commit")).first()
    assert r.content == "[commit abcdef1] Fix it\nauthor: unknown | committed: 2026-01-15\nlong # tale\nfiles changed:\n  a.cs (modified +4 -1)" and (r.entity_key, r.chunk_index) == ("abcdef123456", 0)
    assert r.approx_tokens == math.ceil(len(r.content) / 3.6)
    i = spark.sql("SELECT 't' AS tenant_id, 7 AS number, 'Broken' AS title, '### x\n\ny' AS body, 'closed' AS state, array('bug', 'a') AS labels, 'me' AS author, timestamp'2026-01-15' AS created_at, timestamp'2026-01-16' AS closed_at")
    assert chunks.chunk(chunks.sources(i, "issue")).first().content == "[issue #7 closed] Broken\nlabels: bug, a\nopened by me on 2026-01-15, closed 2026-01-16\nx\ny"
    p = spark.sql("SELECT 't' AS tenant_id, 8 AS number, 'Do' AS title, '' AS body, 'closed' AS state, timestamp'2026-01-17' AS merged_at, 'abcdef123' AS merge_commit_sha, 'main' AS base_ref, 'f' AS head_ref, null AS author, timestamp'2026-01-15' AS created_at")
    assert chunks.chunk(chunks.sources(p, "pull_request")).first().content == "[pull request #8 merged] Do\nf -> main | opened by unknown on 2026-01-15, merged 2026-01-17 as abcdef1"
    s = spark.sql("SELECT 't' AS tenant_id, 'v1' AS tag, null AS name, 'notes' AS body, null AS published_at")
    assert chunks.chunk(chunks.sources(s.withColumn("published_at", F.lit(None).cast("timestamp")), "release")).first().content == "[release v1] v1\nnotes"


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "adjustment": "adjust", "controll": "control", "rate": "rate", "été": "été"}
    assert {w: stem.stem(w) for w in want} == want
    usual = "usability nobility filing sized hopping activation ovation happiness flies dying tied agreement generously conditional vietnamization sensibilities rationalism cried apologies".split()
    assert all(w.startswith(stem.stem(w)[:-1]) for w in [*want, *usual])


def test_content_words_overlap_by_brute_force(spark):
    from evidlake import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4 and w not in text.STOP_WORDS}
    for r in queries.content_words_overlap(spark, sf).collect():
        q = words(items[r.doc_id])
        assert r.copied == (round(len(q & words(docs[r.doc_id])) / len(q), 9) if q else None)


def test_document_chunks_by_hand(spark):
    from evidlake import queries

    got = Counter(r.entity_key for r in queries.chunk_documents(spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", text.normalise(F.col("text")).alias("t")).collect()
    assert got == Counter({str(r.doc_id): len(chunks.chunk_text(f"[document {r.doc_id}] {r.source}", r.t)) for r in docs})
