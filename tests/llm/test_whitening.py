from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from evidlake.llm import queries, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def exact_covariance(x):
    """Centred before multiplying, in fractions."""
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    y = [[r[i] - mean[i] for i in range(d)] for r in x]
    return np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])


def test_query_against_a_plain_computation(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x = (np.floor(1024 * np.array(t["embedding"].to_pylist())) + 100000).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = dict(zip(t["vec_id"].to_pylist(), ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True))
    projected = dict(zip(t["vec_id"].to_pylist(), (y @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :8], strict=True))
    out = queries.op12_embedding_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.collect()
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, k) for i in deviation for k in range(1, 9))
    signs = {}
    for r in rows:
        want = projected[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want) * np.sign(r.whitened))
        assert abs(sign * r.whitened - want) < 1e-8
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    got = np.array([[r.whitened for r in rows if r.component == k] for k in range(1, 9)])
    assert np.abs(np.cov(got, bias=True) - np.eye(8)).max() == pytest.approx(rows[0].identity_error, abs=1e-12)


@pytest.mark.parametrize("tile", [1, 2, 3, 7])
def test_any_tile_and_any_partitions_give_the_exact_covariance(spark, tile):
    rng = np.random.default_rng(tile)
    c = rng.normal(1000, 0.02, (50, 5)) + np.array([0, 0, 5, -500000, 900000])
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(c)], "id long, v array<double>").repartition(tile)
    w = whitening.fit(table, tile)
    x = (np.floor(1024 * c) + 100000).astype(np.int64)
    want = exact_covariance(x.tolist())
    assert np.abs(w.covariance - want).max() <= 4e-16 * np.abs(want).max()
    assert w.sums == x.sum(axis=0).tolist()


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 26, (1 << 30) - 1):
        a, b = (rng.integers(-top, top + 1, (300, 4)) for _ in range(2))
        total = sum(p.astype(object) for p in whitening.exact_products(a, b))
        assert (total == a.T.astype(object) @ b.astype(object)).all()
    z = rng.integers(-1000, 1000, (20, 3))
    for n, rest in ((20, [7, -9, 0]), (10**12, [3 * 10**11, 5, -7])):
        y = n * z.astype(object) - np.array(rest, dtype=object)
        assert [int(x.as_py()) for x in whitening.deviations(z, n, rest)] == (y * y).sum(axis=1).tolist()
    assert whitening.deviations(z + 5000, 10**18, [1, 2, 3])[0].as_py() is None


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, VEC_ID string, id int"
    rows = [(1, [0.5, 0.25, 3.0], "a", 1), (None, [0.25, 0.25, 3.0], "b", 1), (1, [0.5, 0.75, 3.0], "c", None), (2, None, "d", 1), (3, [None, 1.0, 1.0], "e", 1), (4, [NAN, 1.0, 1.0], "f", 1), (5, [0.0, -INF, 1.0], "g", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.id is None, r.id or 0, r.component) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 1, 3), (False, 1, 3), (True, 0, 1), (True, 0, 2), (True, 0, 3)]
    assert all((r.whitened is None) == (r.component == 3) and r.n == 3 for r in got)  # the third dimension is constant
    assert got[0].identity_error < 1e-9 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    one = whitening.whiten(spark.createDataFrame(rows[:1], kind)).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(None, None, None, 0)] * 3
    assert whitening.whiten(spark.createDataFrame(rows[3:], kind)).collect() == []
    with pytest.raises(Exception, match="another length"):
        whitening.whiten(spark.createDataFrame([rows[0], (9, [1.0], "z", 1)], kind).coalesce(1)).collect()
    with pytest.raises(ValueError, match="component"):
        whitening.whiten(spark.createDataFrame(rows, kind), components=0)
