"""File sinks and readers: JSON lines, frozen sets, guarded text, XML reports, validated index uploads."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, as they must be: what an identifier and an address look like in a published text.
GUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
EMAIL = r"[A-Za-z0-9.!#$%&\x27*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def write_json_lines(df: DataFrame, folder: str, order: list[str]) -> None:
    """JSON lines in order over as many files as there are ranges; file order is row order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(folder)


def in_order(df: DataFrame, order: list[str]):
    """Rows one by one in order, a partition at a time in the driver: for exports, not for counts."""
    return df.orderBy(*order).toLocalIterator(prefetchPartitions=True)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(artefact, linked) from JSON lines of pull requests and their commits."""
    from ..operators.evidence import adjacency

    return adjacency(spark.read.schema("pullRequest string, commit string").json(path), "pullRequest", "commit")


def freeze(rows: list[dict], manifest: dict, path: str) -> str:
    """Writes a question set and, beside it, a manifest with its SHA-256, which it returns. For sets of report size."""
    data = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode()
    digest = hashlib.sha256(data).hexdigest()
    Path(path).write_bytes(data)
    Path(path).with_suffix(".manifest.json").write_text(json.dumps({**manifest, "sha256": digest}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8", newline="\n")
    return digest


def read_frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frozen set, refused if a byte of it changed."""
    want = json.loads(Path(path).with_suffix(".manifest.json").read_text(encoding="utf-8"))["sha256"]
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h
    if got != want:
        raise ValueError(f"{path} has SHA-256 {got}, but {want} was frozen")
    return spark.read.schema(schema).json(path)


def changed_files(spark: SparkSession, folder: str, digests: dict[str, str], required: set[str], most_bytes: int = 1 << 30) -> DataFrame:
    """(name, fault) of files of a bundle that are missing, surplus, too large or not as their manifest says."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    want = spark.createDataFrame([(n, digests.get(n)) for n in sorted(required | set(digests))], "name string, want string")
    both = found.join(F.broadcast(want.withColumn("known", F.lit(True))), "name", "full")
    fault = F.when(F.col("digest").isNull(), "missing").when(F.col("known").isNull(), "surplus").when(F.col("length") > most_bytes, "too large").when(~F.col("digest").eqNullSafe(F.col("want")), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")


def identifiers(rows: DataFrame, columns: list[str], *, hosts: tuple[str, ...] = (), forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, rows): which kinds of identifiers the text columns of rows that are to be published hold, and in how many rows.

    Kinds: guid, address, host (a name under one of the domains), forbidden (any of the strings, whatever their
    case). What was found isn't part of the result. One pass over the rows; null texts hold nothing.
    """
    lower = [x.lower() for x in forbidden if x]
    under = "|".join(r"[a-z0-9-]+\." + re.escape(h.lower().lstrip(".")) + r"(?![a-z0-9-])" for h in hosts)

    def kinds(c: str) -> dict:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        said = F.lit(False)
        for x in lower:
            said = said | F.lower(text).contains(x)
        return {"guid": F.lower(text).rlike(GUID), "address": text.rlike(EMAIL), "host": F.lower(text).rlike(under) if under else F.lit(False), "forbidden": said}

    found = rows.agg(*[F.count_if(hit).alias(f"{i}_{kind}") for i, c in enumerate(columns) for kind, hit in kinds(c).items()])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"{i}_{kind}").alias("rows")) for i, c in enumerate(columns) for kind in ("guid", "address", "host", "forbidden")])
    return found.select(F.explode(listed).alias("f")).select("f.*").where("rows > 0")


def write_published(rows: DataFrame, path: str, columns: list[str], **what) -> None:
    """Writes rows as JSON lines unless their texts hold an identifier; the error names columns and kinds only."""
    found = identifiers(rows, columns, **what).orderBy("column", "kind").collect()  # at most four rows a column
    if found:
        raise ValueError(f"{path} was not written: " + ", ".join(f"{r['column']} holds {r['kind']} in {r['rows']} rows" for r in found))
    rows.write.json(path)


def read_test_results(spark: SparkSession, path: str) -> DataFrame:
    """(executionId, testName, outcome) of a test-result XML file."""
    return spark.read.format("xml").option("rowTag", "UnitTestResult").schema("_executionId string, _testName string, _outcome string").load(path).select(F.col("_executionId").alias("execution_id"), F.col("_testName").alias("test"), F.col("_outcome").alias("outcome"))


def test_results_sound(results: DataFrame, total: int) -> DataFrame:
    """One row (n, sound): as many results as declared, all passed, each once."""
    n, d, p = F.count("*"), F.count_distinct("execution_id"), F.count_if(F.col("outcome") == "Passed")
    return results.agg(n.alias("n"), ((n == total) & (d == total) & (p == total) & F.lit(total > 0)).alias("sound"))


def write_junit(cases: list[tuple[str, str | None]], path: str, suite: str) -> None:
    """A JUnit report of (name, fault or None) cases; an existing file is never replaced."""
    bad = sum(f is not None for _, f in cases)
    body = "".join(f"<testcase name={quoteattr(n)}/>" if f is None else f"<testcase name={quoteattr(n)}><failure message={quoteattr(f)}/></testcase>" for n, f in cases)
    with open(path, "x", encoding="utf-8", newline="\n") as out:
        out.write(f'<?xml version="1.0" encoding="utf-8"?><testsuite name={quoteattr(suite)} tests="{len(cases)}" failures="{bad}">{body}</testsuite>\n')


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A hand-written YAML list of questions."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)
    lists = ("expected_citations", "must_contain", "must_not_contain")
    return spark.createDataFrame([(r["id"], r["question"], r["category"], *[list(r.get(c) or []) for c in lists], r.get("notes")) for r in rows], "id string, question string, category string, " + ", ".join(f"{c} array<string>" for c in lists) + ", notes string")


def index_faults(docs: DataFrame, dim: int, *, key="chunk_id", vector="vector") -> DataFrame:
    """One row (n, distinct_keys, wrong_dim, zero): what must be n, n, 0, 0 before an upload."""
    return docs.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dim).alias("wrong_dim"), F.count_if(~F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))).alias("zero"))


def write_index(docs: DataFrame, folder: str, dim: int) -> None:
    """Writes an index after checking it."""
    f = index_faults(docs, dim).first()
    if f.n != f.distinct_keys or f.wrong_dim or f.zero:
        raise ValueError(f"the index is not sound: {f.asDict()}")
    docs.write.parquet(folder)
