import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake.operators import ivf, vector
from evidlake.plans import faults

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def clustered(spark):
    """Ten thousand vectors around two hundred centres, a third of them around one."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 24))
    at = np.where(rng.random(10_000) < 1 / 3, 7, rng.integers(0, 200, 10_000))
    x = centres[at] + 0.25 * rng.standard_normal((10_000, 24))
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")


def rows_of(df):
    return sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_exact_and_probed_search(spark, clustered, tmp_path):
    q = clustered.where("chunk_id % 500 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    want = rows_of(vector.batch_topk(q, clustered, 10))
    index = ivf.build(clustered, f"{tmp_path}/index")
    assert index.cells.counts.sum() == 10_000 and len(index.cells.counts) == 100
    got = ivf.topk(index, q, 10)
    assert rows_of(got) == want and faults(got) == []
    again = ivf.load(spark, f"{tmp_path}/index")
    near = {(a, c) for a, _, c, _ in rows_of(ivf.topk(again, q, 10, probes=15))}
    assert len(near & {(a, c) for a, _, c, _ in want}) >= 0.95 * len(want)


def test_codes_bound_the_cosine_and_leave_few_rows(spark, tmp_path):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x = np.array(t["embedding"].to_pylist(), dtype=np.float64)
    index = ivf.build(spark.read.parquet(f"{SF}/embeddings.parquet"), f"{tmp_path}/index", id_col="vec_id")
    rows = index.rows.select("id", "code", "step", "error", "cell").toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = unit[rows["id"].to_numpy()] @ unit[::50].T
    code = np.stack([np.frombuffer(c, np.int8) for c in rows["code"]]) * rows["step"].to_numpy()[:, None]
    near = code @ unit[::50].T
    error = rows["error"].to_numpy()[:, None]
    assert (np.abs(near - true) <= error + 1e-9).all()
    bound = index.cells.bounds(unit[::50])
    assert (true <= bound.T[rows["cell"].to_numpy()] + 1e-9).all()
    kth = np.sort(near - error, axis=0)[-5]
    assert (near + error >= kth).mean() < 0.02  # rows whose vectors must be read


def test_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [0.0, 1.0])], "qid long, embedding array<float>")
    index = ivf.build(df, f"{tmp_path}/a", cells=2)
    got = sorted(((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in ivf.topk(index, q, 2).collect()), key=str)
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (None, 1, 7, 1.0), (None, 2, 1, 0.0)]
    assert ivf.topk(index, q.where("qid = 3"), 2).collect() == []
    assert ivf.topk(ivf.build(df.where("chunk_id = 4"), f"{tmp_path}/b"), q, 2).collect() == []
    with pytest.raises(ValueError):
        ivf.topk(index, q, 0)
