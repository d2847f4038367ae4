import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from evidlake.llm import decontam, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] by looking up every window."""
    where = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if n and i is not None else ():
            where.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(g) for g in where}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if ids := where.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows_of(sf, name, *cols):
    t = pq.read_table(f"{sf}/{name}.parquet")
    return list(zip(*[t.column(c).to_pylist() for c in cols], strict=True))


def test_whole_table_against_brute_force(spark):
    got = sorted((tuple(r) for r in queries.op5_decontaminate(spark, SF).collect()), key=str)
    assert got == brute(rows_of(SF, "documents", "doc_id", "text"), rows_of(SF, "benchmark", "item_id", "text"))
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("bound", [None, 3])
def test_edges_and_the_way_beyond_the_bounds(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(decontam, "INLINE_PRINTS", bound)
        monkeypatch.setattr(decontam, "INLINE_PAIRS", bound)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 13, 14, 12, 3, 1, 0, 200])]
    items += [(5, items[0][1]), (None, "null item of no use"), (77, None), (78, "..."), (79, "same " * 30), (80, "É TWELVE words. Are not enough: for, a whole? window! x")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    docs += [(200 + (i or 0), "lead " * rng.randrange(9) + t + " tail" * rng.randrange(400)) for i, t in items if t]
    docs += [(400, None), (401, ""), (402, "?!"), (403, "same " * 12), (404, "same " * 13), (405, "SAME-" * 500), (None, items[0][1]), (200, docs[0][1]), (406, items[1][1].upper()), (407, "é twelve words are not enough for a whole window x")]
    docs += [(408, "pad " * 60_000 + items[0][1] + " pad" * 60_000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, hash int, item string")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, least int")
    got = sorted((tuple(r) for r in decontam.contaminate(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in got if not r[-1]), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contaminate(docs, none).collect()] == brute([(1, "a b c")], [])
    assert decontam.contaminate(docs.limit(0), none).collect() == []


CLASHING = ('_hash', '_id', '_bad', 'bad_id', 'bad_mark', 'mark', '_row', 'hash', 'c0')


def test_columns_of_any_name_come_back_unchanged(spark):
    bad = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(i, bad if i == 3 else "clean text", *range(100, 100 + len(CLASHING))) for i in range(5)], ["doc_id", "text", *CLASHING])
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in df.collect() if r.doc_id != 3)
