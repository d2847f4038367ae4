import re
from pathlib import Path

import __spark_entry__ as entry
from evidlake import oracles, queries

ROOT = Path(__file__).resolve().parent.parent


def test_names(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.queries()) <= set(q) and set(oracles.oracle_sql()) <= set(sql) and set(sql) <= set(q)
    df = entry.entry(spark)
    assert df.columns[0] == "chunk_id" and df.count() == 15


def test_nothing_else_imports_the_training_data_operators():
    for path in ROOT.glob("evidlake/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_bench_names():
    import bench

    assert {n for n in bench.HEADLINE if not n.startswith("op")} <= set(queries.queries())
