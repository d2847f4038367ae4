import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from evidlake.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(rows, span):
    words = [(i, t.encode().split() if t else []) for i, t in rows]
    seen = Counter(tuple(w[j : j + span]) for _, w in words for j in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - span + 1):
            if seen[tuple(w[j : j + span])] > 1:
                gone.update(range(j, j + span))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_whole_table_against_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    want = [(i, n, r, hashlib.sha256(x.encode()).hexdigest()) for i, n, r, x in brute(rows, 35)]
    got = sorted((tuple(r) for r in queries.op7_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == want
    assert any(r for _, _, r, _ in want)


@pytest.mark.parametrize("groups", [1, 3, 16])
def test_small_texts(spark, groups):
    run = " ".join(f"w{i}" for i in range(9))
    rows = [
        (1, f"a b {run} c d"), (2, f"{run}"), (3, f"x {run} y {run} z"), (4, None), (5, ""), (6, "a b"),
        (7, "t " * 40), (8, "u v " * 20), (9, "ä b c d e f g h i j k"), (None, f"q {run}"), (9, "ä b c d e f g h i j k"),
    ]
    df = spark.createDataFrame([(i, t, "junk", 1) for i, t in rows], "doc_id long, text string, g string, v int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.cut_repeats(df, span=5, groups=groups).collect()), key=str)
    assert got == brute(rows, 5)


def test_spans_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "z a b c d e")], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substrings.cut_repeats(df, span=5, groups=2).collect()}
    assert spans == {1: [(0, 5)], 2: [(1, 6)]}
    assert substrings.cut_repeats(df.where("doc_id > 9"), span=5, groups=2).collect() == []


def test_pairs_of_hashes_are_compared_whole():
    p = np.array([(7, 2), (5, 4), (7, 4), (7, 2), (5, 4), (9, 0)], dtype=substrings.PAIR)
    first, place = substrings._groups(p)
    assert [tuple(x) for x in p[first].tolist()] == [(5, 4), (7, 2), (7, 4), (9, 0)] and place.tolist() == [1, 0, 2, 1, 0, 3]
    known = np.array([(7, 4), (7, 6), (5, 4)], dtype=substrings.PAIR)
    assert substrings._among(p, known).tolist() == [False, True, True, False, True, False]
    assert substrings._among(p[:0], known).tolist() == [] and not substrings._among(p, known[:0]).any()
    assert substrings._groups(p[:0])[0].tolist() == []


def test_very_many_equal_rows_are_spread(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(0, 20_000, 1, 8).selectExpr("7L as doc_id", f"'{text}' as text")
    got = substrings.cut_repeats(df, groups=16).groupBy("doc_id", "n_words", "n_removed", "text").count().collect()
    assert [tuple(r) for r in got] == [(7, 40, 40, "", 20_000)]
