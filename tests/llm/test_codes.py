import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake.llm import codes, oracles, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def lloyd(x, parts, entries, rounds):
    """Codes, errors and codebooks by evaluating every entry in every round, in Python's integers."""
    books = [[list(map(int, row[p])) for row in x[:entries]] for p in (slice(i * x.shape[1] // parts, (i + 1) * x.shape[1] // parts) for i in range(parts))]
    for n in range(rounds + 1):
        code, error = [], []
        for row in x:
            best = []
            for p, book in enumerate(books):
                own = list(map(int, row[p * len(row) // parts : (p + 1) * len(row) // parts]))
                best.append(min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), i) for i, e in enumerate(book)))
            code.append([i for _, i in best])
            error.append(sum(d for d, _ in best))
        if n < rounds:
            for p, book in enumerate(books):
                for i in range(len(book)):
                    own = [list(map(int, row[p * len(row) // parts : (p + 1) * len(row) // parts])) for row, c in zip(x, code, strict=True) if c[p] == i]
                    if own:
                        book[i] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return code, error, books


def test_codes_are_those_of_plain_rounds(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").slice(0, 120)  # vec_id 0 to 119
    x = np.floor(1024 * np.array(t["embedding"].to_pylist())).astype(np.int64)
    out = codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 120"), entries=16, rounds=3)
    want_code, want_error, want_books = lloyd(x, 4, 16, 3)
    rows = sorted(out.codes.collect(), key=lambda r: r.id)
    assert [list(r.code) for r in rows] == want_code
    assert [r.error for r in rows] == want_error
    assert [b.tolist() for b in out.books] == want_books
    assert sum(r.evaluated for r in rows) < 4 * 16 * 4 * len(rows)
    restored = codes.restore(np.array(want_code), out.books)
    assert ((restored - x) ** 2).sum(axis=1).tolist() == want_error


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_bounds_never_leave_out_a_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (400, 3))  # small integers: many ties and equal entries
    book = x[:30].copy()
    at, u, low, _ = codes.assign_first(x, codes.Book.of(book))
    for _ in range(6):
        new = np.array([x[at == i].sum(axis=0) // max(1, (at == i).sum()) if (at == i).any() else book[i] for i in range(30)])
        ready, book = codes.Book.of(new, book), new
        at, u, low, count = codes.assign_again(x, ready, at, u, low)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all()
        true = np.sqrt(d)
        assert (u >= true[np.arange(400), at]).all() and (low <= true).all()
    assert count.sum() < 400 * 30


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, VEC_ID string, label int, x string"
    rows = [(3, [0.5, 0.25], "a", None, "x"), (None, [0.5, 0.25], "b", None, None), (1, [0.0, -0.001], None, 7, "y"), (1, [0.0, -0.001], None, 7, "y"), (2, None, "c", 7, "z"), (5, [None, 1.0], "d", 7, "z"), (6, [NAN, 1.0], "e", 7, "z"), (7, [INF, 1.0], "f", 7, "z"), (4, [1.0, 1.0], "g", 7, "z")]
    out = codes.compress(spark.createDataFrame(rows, kind), parts=2, entries=3, rounds=1)
    got = sorted((r.id is None, r.id or 0, r.label, r.code.hex(), r.error) for r in out.codes.collect())
    # entries are the parts of ids 1, 1 and 3; of equal entries the lower index has all, the other stays
    assert [g[1] for g in got] == [1, 1, 3, 4, 0]
    assert got[0][3] == got[1][3] == "0000" and got[0][4] == 0
    assert got[2][3:] == got[4][3:] and got[2][2] is None
    assert out.books[0].tolist() == [[0], [0], [(512 + 512 + 1024) // 3]] and out.books[1].tolist() == [[(-2 - 2) // 2], [-2], [(256 + 256 + 1024) // 3]]
    empty = codes.compress(spark.createDataFrame(rows, kind).where("label = 9"))
    assert empty.codes.collect() == [] and empty.books == []
    assert codes.compress(spark.createDataFrame(rows[:1], kind), parts=2).codes.first().error == 0
    with pytest.raises(ValueError, match="divide"):
        codes.compress(spark.createDataFrame(rows[:1], kind), parts=3)
    for bad in ([1.0, 2.0, 3.0], [1e9, 0.0]):
        with pytest.raises(Exception, match="another length|exact distances"):
            codes.compress(spark.createDataFrame([*rows, (9, bad, "h", 1, "z")], kind), parts=2, entries=1).codes.collect()


def test_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (codes.compress(d, entries=64) for d in (df.repartition(7), df.repartition(3, F.col("label"))))
    assert a.digest() == b.digest()
    assert sorted(map(tuple, a.codes.select("id", "code", "error", "evaluated").collect())) == sorted(map(tuple, b.codes.select("id", "code", "error", "evaluated").collect()))


def test_query_agrees_with_sql(spark):
    assert compare(spark, connect(SF), queries.op11_vector_codes, oracles.oracle_sql()["op11_vector_codes"], SF) == []
