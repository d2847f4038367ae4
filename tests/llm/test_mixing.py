import hashlib
import math
import re

import duckdb
import pyarrow.parquet as pq

from evidlake.llm import mixing, oracles, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def uniform(doc_id):
    digest = hashlib.md5(f"17|{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return (int(digest[:12], 16) + 0.5) / (1 << 48)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, capped, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        for s in over or free:
            out[s] = float(most * sizes[s]) if over else w[s] * level
        left -= sum(out[s] for s in over)
        free -= over or free
    return out


def brute(rows, weights):
    """[(doc_id, size, source_size, target, copies)] of (doc_id, text, source) rows; weights: by doc_id."""
    rows = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, out = targets(sizes), []
    for s, total in sizes.items():
        own = sorted((-math.log(uniform(i)) / weights.get(i, 1.0), (i is not None, i or 0), n) for i, n, x in rows if x == s)
        epochs, before = min(3, int(target[s] // total)) if total else 0, 0
        for _, (known, i), n in own:
            more = epochs < 3 and 2 * before + n <= 2 * (target[s] - epochs * total)
            out.append((i if known else None, n, total, target[s], (epochs + more) if n else 0))
            before += n
    return out


def tidy(rows):
    return sorted(((i, n, t, round(x, 4), c) for i, n, t, x, c in rows), key=str)


def test_whole_table_against_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    weights = {i: {1: 2.0, 0: 0.5}[q] for i, q in zip(labels["doc_id"], labels["quality"], strict=True)}
    got = queries.op3_source_mix(spark, SF).collect()
    assert tidy((r.doc_id, r.size, r.source_size, r.target, r.copies) for r in got) == tidy(brute(zip(t["doc_id"], t["text"], t["source"], strict=True), weights))
    assert all(r.taken == r.copies * r.size for r in got)


def test_sql_agrees(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(oracles.MIX).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in queries.op3_source_mix(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[i][:2] == want[i][:2] and got[i][3:] == want[i][3:] for i in got)


def test_nulls_ties_caps_and_clashing_columns(spark):
    rows = [(i, "a b " * (i % 7), ["s1", "s2", None][i % 3]) for i in range(60)] + [(None, "x y", "s1"), (3, None, "s1"), (3, "q", "s1"), (3, "q", "s1"), (99, "", "only blank")]
    rows += [(1000 + i, "w " * 400, "s0") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    got = mixing.mix(df).collect()
    assert tidy((r.doc_id, r.size, r.source_size, r.target, r.copies) for r in got) == tidy(brute(rows, {}))
    assert max(r.copies for r in got) <= 3
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixing.mixed(df)
    assert whole.columns == df.columns
    assert whole.count() == sum(r.copies for r in got)


def test_taken_words_come_near_the_target(spark):
    taken, target = {}, {}
    for r in queries.op3_source_mix(spark, "/root/testdata/sf0.01").collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 3000) for s in target)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.mixed(df).collect() == []


def test_equal_rows_at_the_place_are_split(spark):
    rows = [(5, "a b c", "s")] * 3000 + [(6, "d", "t"), (7, "e f", "t")] + [(None, "x y z", "u")] * 500 + [(8, "q " * 40, "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _key int").repartition(13)
    got = mixing.mix(df, max_epochs=2, weights=(3, 1, 1)).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert len({r.copies for r in got if r.source == "u"}) == 2
    whole = mixing.mixed(df, max_epochs=2, weights=(3, 1, 1))
    assert whole.columns == df.columns and whole.count() == sum(r.copies for r in got)


CLASHING = ("size", "target", "copies", "_key", "_range", "_s", "_copy", "c0", "_q_id", "weight")


def test_columns_of_any_name_come_back_unchanged(spark):
    df = spark.createDataFrame([(i, "a b", "s", *range(100, 100 + len(CLASHING))) for i in range(9)], ["doc_id", "text", "source", *CLASHING])
    whole = mixing.mixed(df, quality=spark.createDataFrame([(1, 2.0)], "doc_id long, weight double"))
    assert whole.columns == df.columns and sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    assert len(mixing.mix(df).collect()) == 9
