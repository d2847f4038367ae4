"""A stored index of three-letter runs, for searches with ILIKE patterns.

A row for each text and run of three characters (lower case), in files sorted by run. A pattern is cut at
its wild cards; the runs within its pieces must all be in a text that matches. Texts that hold them all
are candidates, and the pattern decides about these alone. A pattern without a whole run of three needs all
texts. The rows of the rarest runs are read only: `most_runs` of them leave few candidates already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import small

MOST_RUNS = 4
BROADCAST_ROWS = 1_000_000


def write_grams(rows: DataFrame, folder: str, *, id_col: str, text_col: str) -> DataFrame:
    """Writes the index of all texts and reads it back: (gram, id). Null ids and texts are not in it."""
    low = F.lower(text_col)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))
    each = rows.where(F.col(id_col).isNotNull() & (F.length(text_col) >= 3)).select(F.explode(runs).alias("gram"), F.col(id_col).alias("id")).distinct()
    each.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def pattern_grams(pattern: str, escape: str = "\\") -> list[str]:
    """The runs of three that every text that matches must hold."""
    pieces, piece, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            piece, i = piece + pattern[i + 1], i + 1
        elif c in "%_":
            pieces, piece = [*pieces, piece], ""
        else:
            piece += c
        i += 1
    lower = [p.lower() for p in [*pieces, piece]]
    return sorted({p[i : i + 3] for p in lower for i in range(len(p) - 2)})


def ilike(rows: DataFrame, index: DataFrame, pattern: str, *, id_col: str, text_col: str, most_runs: int = MOST_RUNS) -> DataFrame:
    """The rows whose text is like a pattern, whatever the case; only candidates' texts are compared."""
    wanted = pattern_grams(pattern)
    if not wanted:
        return rows.where(F.col(text_col).ilike(pattern))
    counted = {r.gram: r.n for r in index.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # as many as the pattern has
    if len(counted) < len(wanted):
        return rows.limit(0)
    rare = sorted(wanted, key=lambda g: (counted[g], g))[:most_runs]
    ids = index.where(F.col("gram").isin(rare)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(F.col("id").alias("_id"))
    sent = small(ids, BROADCAST_ROWS) if counted[rare[0]] <= BROADCAST_ROWS else ids
    return rows.join(sent, F.col(id_col) == F.col("_id"), "left_semi").where(F.col(text_col).ilike(pattern))
