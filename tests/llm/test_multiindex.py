import math
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from evidlake.llm import multiindex, oracles, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")


def brute(rows, asked, k):
    """{query id: [(distance, id)]} of {id: vector}, over all pairs."""
    return {q: sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(asked[q], v, strict=True))), i) for i, v in rows.items() if i != q)[:k] for q in asked}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.id))
    return out


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    return dict(zip(t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), dtype=np.float32).astype(float), strict=True))


@pytest.fixture(scope="module")
def true(table):
    ids, x = np.array(list(table)), np.array(list(table.values()))
    return {q: sorted((math.sqrt(d), int(i)) for d, i in zip(((x - table[q]) ** 2).sum(axis=1), ids, strict=True) if i != q)[:10] for q in ids[ids % 50 == 0].tolist()}


def test_measured_effort_reaches_the_recall_without_meeting_all_rows(spark, table, true):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = listed(multiindex.search(df, df.where("vec_id % 50 = 0"), 10, least=0, cell_rows=4))
    assert set(got) == set(true)
    caught = sum(len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in true) / sum(map(len, true.values()))
    assert 0.9 <= caught < 1
    rows = multiindex.usable(df, "vec_id", "embedding")
    index = multiindex.build(rows, 10, cell_rows=4)
    assert index.cells.counts.sum() == len(table) == index.rows.count()
    effort = multiindex.calibrated(index, rows.where("id % 50 = 0"), 10, least=0)
    assert 0 < effort < 0.9 * len(table)


def test_exact_search_misses_nothing(spark, true):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = listed(multiindex.search(df, df.where("vec_id % 50 = 0"), 10, recall=0.3, least=0, exact=True))
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in true.items()}
    assert all(abs(a - b) < 1e-12 for q in true for (a, _), (b, _) in zip(got[q], true[q], strict=True))


def test_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = {i: [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [float(x) for x in rng.integers(1, 4, 4)] for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(5)
    asked = {i: v for i, v in rows.items() if i % 20 == 0}
    for options in ({"exact": True, "least": 0, "recall": 0.2}, {"least": 600}):
        assert listed(multiindex.search(df, df.where("vec_id % 20 = 0"), 7, cell_rows=16, **options)) == brute(rows, asked, 7)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, VEC_ID string, id int, q int, v int"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 5.0]), (7, [1.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], kind)
    got = listed(multiindex.search(df, df, 3))
    assert got == {0: [(1.0, 1), (3.0, 7)], 1: [(1.0, 0), (math.sqrt(10), 7)], 7: [(3.0, 0), (math.sqrt(10), 1)]}
    assert multiindex.search(df, df.where("q = 1"), 3).collect() == []
    assert multiindex.search(df.where("q = 1"), df, 3).collect() == []
    assert multiindex.search(one := spark.createDataFrame([(1, [2.0, 0.0])], "vec_id long, embedding array<float>"), one, 3).collect() == []
    with pytest.raises(ValueError):
        multiindex.search(df, df, 0)
    with pytest.raises(Exception, match="length"):
        multiindex.search(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>"), df, 3).collect()


def test_walk_is_in_order_and_meets_every_pair_once():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20):
        a, b = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        met = list(multiindex.walk(a, b))
        assert sorted(met) == [(i, j) for i in range(n) for j in range(n)]
        assert [a[i] + b[j] for i, j in met] == sorted(a[i] + b[j] for i, j in met)


def test_query_agrees_with_sql(spark):
    assert compare(spark, connect(SF), queries.op13_nearest_neighbours, oracles.oracle_sql()["op13_nearest_neighbours"], SF) == []
