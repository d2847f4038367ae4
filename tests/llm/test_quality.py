import math
import random
from collections import Counter

import pyarrow.parquet as pq

from evidlake.llm import quality, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words, word = [], ""
    for ch in text + " ":
        if ch in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    rep = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(words) < 20 or 100 * len(rep) > 30 * len(words))


def test_counts_of_the_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    want = {i: brute(x) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)}
    got = {r[0]: tuple(r[1:7]) for r in queries.op9_quality_rules(spark, SF).collect()}
    assert got == want


def test_edge_texts(spark):
    texts = [None, "", " \n\t ", "a", "é x y z\x1cw", "a b c d e f g h " * 3, "x\nx\n \n \nx", "#" * 50 + " <|>", "ß" * 90_000 + " " + "w " * 60_000]
    df = spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)] + [(None, "a b", "en", 7)], "doc_id long, text string, lang string, c int")
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df, labels).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} | {None: brute("a b")}
    assert quality.judge(df.where("doc_id > 99"), labels.limit(0)).collect() == []


def test_binomial_bound():
    exact = sum(math.comb(300, k) * 0.01**k * 0.99 ** (300 - k) for k in range(3))
    assert abs(quality.binomial_at_most(2, 300, 0.01) - exact) < 1e-12
    assert quality.binomial_at_most(0, 0, 0.01) == 1.0 and quality.binomial_at_most(5, 5, 0.01) == 1.0
    for x in (0, 1, 3, 7, 40, 299):
        exact = sum(math.comb(300, k) * 0.01**k * 0.99 ** (300 - k) for k in range(x + 1))
        assert abs(quality.binomial_at_most(x, 300, 0.01) - exact) < 1e-10
    assert 0.4 < quality.binomial_at_most(1_000_000, 100_000_000, 0.01) < 0.6


def test_labels_needed():
    for strata in (1, 4, 100):
        n = quality.labels_needed(strata)
        level = quality.JOINT_SHARE * quality.DELTA / strata
        assert quality.binomial_at_most(0, n, quality.ALPHA) <= level < quality.binomial_at_most(0, n - 1, quality.ALPHA)


def test_paths_tighten_one_rule_a_step_and_share_the_error():
    assert abs(sum(quality.SHARES) - 1) < 1e-12 and len(quality.SHARES) == len(quality.PATHS)
    for path in quality.PATHS:
        for before, now in zip([(0,) * 5, *path], path, strict=False):
            assert sorted(b - a for a, b in zip(before, now, strict=True)) == [0, 0, 0, 0, 1]
    assert quality.PATHS[0][-1] == tuple(map(len, quality.RULES.values()))


def test_repeats_of_a_labelled_document_prove_nothing(spark):
    clean, junk = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}##" for i in range(30))
    df = spark.createDataFrame([(1, clean, "en")] * 2000 + [(2, junk, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.judge(df, labels).collect()} == {1: True, 2: True}


def test_a_rule_that_loses_good_documents_does_not_hold_back_the_others(spark):
    """Good documents are full of symbols: all rules together stop there, the path without that rule goes on."""
    rows = [(i, " ".join(f"w{j}" + "#" * (3 * (i % 2)) for j in range(30)) + f" {i}", "en") for i in range(3000)]
    rows += [(9000 + i, " ".join(x for j in range(15) for x in (f"v{j}", f"v{j}")) + f" {i}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(df, spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].kept for i in range(3000))
    assert all(got[9000 + i].rejected_by == ["stuttered_words"] for i in range(40))


CLASHING = ("kept", "base_failed", "rejected_by", "_counted", "counted", "_stratum", "_cutoffs", "stratum", "c0", "c")


def test_columns_of_any_name_come_back_unchanged(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(30 * (i % 2))), "en") for i in range(20)]
    df = spark.createDataFrame([(*r, *range(100, 100 + len(CLASHING))) for r in rows], ["doc_id", "text", "lang", *CLASHING])
    kept = quality.keep_good(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(*r, *range(100, 100 + len(CLASHING))) for r in rows if r[0] % 2]


def test_cutoffs_are_the_strictest_safe_ones(spark):
    clean = " ".join(f"w{i}" for i in range(30))
    junk = " ".join(f"w{i}##" for i in range(30))
    rows = [(i, f"{clean} {i}", "en") for i in range(2000)] + [(5000 + i, f"{junk} {i}", "en") for i in range(50)] + [(9000, junk, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)] + [(5000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert all(got[i].kept for i in range(2000))
    assert not any(got[5000 + i].kept for i in range(50)) and got[5000].rejected_by == ["symbols_per_word"]
    assert got[9000].kept  # a stratum without labels keeps everything
    # the fewest clean holdouts with which any cutoff can be proven, and one fewer
    need = quality.labels_needed(1)
    for n, proven in ((need, True), (need - 1, False)):
        cut = quality.thresholds(df.where(f"doc_id < {n}").selectExpr("doc_id", "lang as stratum", "text").withColumn("c", quality.counts("text")), labels)
        assert bool(cut.count()) == proven
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 2001


def test_sql_agrees_where_cutoffs_are_chosen(spark, tmp_path):
    import duckdb

    from evidlake.llm import oracles

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgXY") for _ in range(4))
    rows = []
    for i in range(7200):
        w = [word() for _ in range(rng.randrange(20, 40))]
        if i % 90 == 7 or i == 11:
            w = [x + "#" * (j % 2) for j, x in enumerate(w)]
        if i % 200 == 9:
            w = [x for x in w[:20] for _ in range(3)]
        if rng.random() < 0.003:
            w = w[:30] + ["\n"] + w[:7] + ["\n"] + w[:7]
        rows.append((i, " ".join(w), "fr" if i % 9 == 4 else None, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 90 != 7 and i % 200 != 9), 0) for i in range(7000)] + [(None, 1, 0), (99_999, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(oracles.quality_sql()).fetchall())
    got = sorted(tuple(r) for r in queries.op9_quality_rules(spark, str(tmp_path)).collect())
    assert got == want and len({r[-1] for r in got}) > 2
