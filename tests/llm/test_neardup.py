import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake.llm import neardup, queries
from evidlake.llm.components import components

SF = "/root/testdata/sf0.001"


def sets(rows, n=5):
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        out.append((i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, threshold=0.8):
    """[(doc_id, class_id, n_links)] by comparing all pairs."""
    s = sets(rows)
    root, links = list(range(len(s))), [0] * len(s)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(s)):
        if s[i][0] is not None:
            least[find(i)] = min(s[i][0], least.get(find(i), s[i][0]))
    return sorted(((s[i][0], least.get(find(i)), links[i]) for i in range(len(s))), key=str)


def test_whole_table_against_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    got = sorted((tuple(r)[:3] for r in queries.op10_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert any(n for _, _, n in got)


@pytest.mark.parametrize("block_nodes", [4, 512])
def test_large_groups_and_edge_rows(spark, block_nodes):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.006 else f"x{rng.random()}" for w in base)) for i in range(60)]
    rows += [(100 + i, "same text of some words here") for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "a b"), (205, "a b c"), (None, "a b"), (None, None), (100, "same text of some words here")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, class string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_classes(df, block_nodes=block_nodes).collect()), key=str)
    assert got == brute(rows)
    kept = neardup.one_of_each(df, block_nodes=block_nodes)
    assert kept.columns == df.columns
    classes = {c for d, c, _ in got if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(classes)


def test_bands_reach_the_recall():
    bands, rows = neardup.choose_bands()
    assert bands * rows <= neardup.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        neardup.choose_bands(0.2, 0.9999, 4)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {(x, r) for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.jaccard_classes(df).collect() == [] and neardup.one_of_each(df).collect() == []


CLASHING = ("_row", "row", "node", "keeper", "class_id", "c0", "times", "text_")


def test_columns_of_any_name_come_back_unchanged(spark):
    text = [" ".join(f"w{i}" for i in range(40)), "some other words that stand alone here"]
    df = spark.createDataFrame([(i, text[i == 4], *range(100, 100 + len(CLASHING))) for i in range(5)], ["doc_id", "text", *CLASHING])
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in df.collect() if r.doc_id in (0, 4))


def test_very_many_equal_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.range(0, 100_000, 1, 8).selectExpr("7L as doc_id", f"'{words}' as text").union(spark.createDataFrame([(9, words + " x"), (3, "a b")], "doc_id long, text string"))
    got = neardup.jaccard_classes(df).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted(map(tuple, got)) == [(3, 3, 0, 1), (7, 7, 100_000, 100_000), (9, 7, 100_000, 1)]
    assert sorted(r.doc_id for r in neardup.one_of_each(df).collect()) == [3, 7]


def test_a_long_chain_is_verified_band_by_band(spark):
    """Every text shares nine tenths with the next one and nothing with those far away."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    line = [word() for _ in range(200 + 8 * 500)]
    rows = [(i, " ".join(line[8 * i : 8 * i + 200])) for i in range(500)] + [(i, "") for i in range(1000, 1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[1:4] for r in neardup.jaccard_classes(df, block_nodes=4).collect()), key=str)
    assert got == brute(rows) and {c for d, c, _ in got if d < 500} == {0}
    bands, per_band = neardup.choose_bands()
    nodes = neardup.sketches(df, "doc_id", "text", 5, bands, per_band).where("node is not null").withColumn("root", F.lit(1).cast("long"))
    comps = nodes.groupBy("root").agg(F.count("*").alias("nodes"))
    by_band, bands_of = neardup.cheaper_by_band(nodes, comps, 4)
    assert [r.root for r in by_band.collect()] == [1] and 1 < bands_of.agg(F.max("nodes")).first()[0] < 30
    whole, _ = neardup.cheaper_by_band(nodes.withColumn("bands", F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))), comps, 4)
    assert whole.collect() == []


def test_first_met():
    bands = np.array([[1, 5, 9], [1, 5, 8], [2, 5, 9], [3, 6, 9], [4, 7, 0]])
    left, right = np.array([0, 0, 1, 2, 0, 1, 3]), np.array([1, 2, 2, 3, 3, 3, 4])
    assert neardup.first_met(bands, left, right).tolist() == [0, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("recall", [0.9, 0.999])
def test_links_do_not_depend_on_how_a_piece_is_verified(spark, recall):
    """Near copies around the threshold in one piece; at a recall of 0.9 some pairs above it never meet."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        text = list(base)
        for j in rng.sample(range(120), rng.choice([1, 1, 2, 3])):
            text[j] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(tuple(r)[1:5] for r in neardup.jaccard_classes(df, recall=recall, block_nodes=n).collect()) for n in (16, 64, 512)]
    assert got[0] == got[1] == got[2]
    true = {i: n for i, _, n in brute(rows)}
    met, all_ = sum(n for _, _, n, _ in got[0]), sum(true.values())
    assert recall * all_ * 0.98 <= met <= all_ and all(n <= true[i] for i, _, n, _ in got[0])
