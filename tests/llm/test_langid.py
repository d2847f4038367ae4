import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from evidlake.llm import langid, queries

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    truth = dict(zip(t.column("doc_id").to_pylist(), zip(t.column("lang").to_pylist(), t.column("text").to_pylist(), strict=True), strict=True))
    got = queries.op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and any(c.isalpha() for c in truth[r.doc_id][1] or "")]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) >= 0.95


def test_vectors_are_plain_gram_counts():
    texts = ["Aé b!!c", "", "  12 ", "xyz" * 40]
    got, has = langid.vectors(texts)
    assert has.tolist() == [True, False, False, True]
    for t, row in zip(texts, got, strict=True):
        clean, last = "", False
        for i, ch in enumerate(f" {t.lower()} "):
            if ch.isalpha():
                clean, last = clean + ch, True
            elif last or i == 0:
                clean, last = clean + " ", False
        want = Counter()
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                if n == 1 and clean[i] == " ":
                    continue
                g = 0
                for ch in clean[i : i + n]:
                    g = (g * 0x100000001B3 + ord(ch)) % (1 << 64)
                want[((g + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52] += 1
        assert {i: int(x) for i, x in enumerate(row) if x} == dict(want)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "123 !!", "de", 1), (None, "the dog and", None, 1), (5, "", None, 1), (5, "the " * 50_000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(df).collect()), key=str)
    assert got == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (5, "und"), (5, "en")], key=str)
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    assert langid.identify(df.where("doc_id > 99")).collect() == []


def test_far_texts_are_rejected():
    v = langid.weighted(langid.vectors(["the cat and the dog ran"] * 3 + ["the dog and a cat sat"] * 3)[0], np.ones(langid.DIMENSIONS, np.float32))
    c = langid.cluster(v, 2)
    m = langid.Model(["en", "en"], c, np.ones(langid.DIMENSIONS, np.float32), np.array([0.9, 0.9]))
    assert m.classify(["the cat and the dog ran", "zzz qqq"])[0][2] is False
    assert m.classify(["zzz qqq"])[0][2] is True


def test_the_query_against_a_plain_fit(spark):
    """The same steps over the whole table with numpy alone."""
    t = pq.read_table(f"{SF}/documents.parquet")
    ids, texts, langs = (t.column(c).to_pylist() for c in ("doc_id", "text", "lang"))
    train: dict = {}
    for i, x, g in zip(ids, texts, langs, strict=True):
        if zlib.crc32(str(i).encode()) % 4 != 2 and x is not None and g is not None:
            train.setdefault(g, []).append(x)
    assert all(len(x) <= langid.SAMPLE for x in train.values())  # so that every row is in the sample
    counts = {g: langid.vectors(sorted(x))[0] for g, x in train.items()}
    n, df = sum(map(len, counts.values())), sum((c > 0).sum(axis=0) for c in counts.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    centroids, names, least = [], [], []
    for g in sorted(counts):
        c, low = langid.centroids_of(langid.weighted(counts[g], idf), langid.CENTROIDS)
        centroids, names, least = [*centroids, *c], names + [g] * len(c), least + low
    model, got = np.array(centroids), {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    for i, x in zip(ids, texts, strict=True):
        own, has = langid.vectors([x or ""])
        cosine = (langid.weighted(own, idf) @ model.T)[0]
        best = int(cosine.argmax())
        want = (names[best], float(cosine[best])) if has[0] else ("und", 0.0)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-4
        assert not has[0] or abs(want[1] - least[best]) < 1e-4 or got[i].rejected == (want[1] < least[best])


def test_texts_of_a_language_that_was_not_learned_are_rejected(spark):
    rng = np.random.default_rng(4)
    make = lambda letters, k: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(k))
    rows = [(4 * i, make("abcdefgh", 60), "a") for i in range(200)] + [(4 * i + 1, make("klmnopqr", 60), "b") for i in range(200)] + [(4 * i + 2, make("stuvwxyz", 60), None) for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    rejected = lambda part: np.mean([r.rejected for r in got if r.doc_id % 4 == part])
    # A dozen texts a centroid are left out here; beyond the farthest of n lies one of n + 1.
    assert rejected(2) == 1.0 and rejected(0) < 0.15 and rejected(1) < 0.15
