"""Runs a query and its DuckDB SQL on the same files and compares columns, types and rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME = {"int64": "bigint", "int32": "int", "object": "string", "float64": "double", "bool": "boolean"}
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NS": "timestamp_ntz", "DATE": "date", "DECIMAL(18,9)": "decimal(18,9)"}


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def compare(spark, con, query, sql, sf):
    """A list of what differs; empty where nothing does."""
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in res.description}
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    a, b = plain(got, [df.columns.index(c) for c in order]), plain(want, [names.index(c) for c in order])
    out = [f"{c}: {t} and {kinds[c]}" for c, t in df.dtypes if t != kinds[c] and {t, kinds[c]} != {"timestamp", "timestamp_ntz"}]
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if diff:
        out.append(f"{len(diff)} rows differ, as {order}: {diff[0]}")
    return out
