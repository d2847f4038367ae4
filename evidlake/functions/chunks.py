"""Texts cut into overlapping chunks, each under its header.

Lengths are UTF-16 units, as in the stored corpora; a cut never parts the halves of a pair. Cuts are
sought at the last blank line, sentence end or line end in the last two thirds of the room, else made
where it ends.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import estimate_tokens, first_line, normalise, remainder

MAX_CHARS = 1152
OVERLAP_CHARS = 172


def _units(text: str) -> str:
    """One character per UTF-16 unit."""
    return text if text.isascii() or max(text) < "\U00010000" else "".join(map(chr, array("H", text.encode("utf-16-le", "surrogatepass"))))


def _joined(units: str) -> str:
    return units if units.isascii() else units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _inside_pair(units: str, at: int) -> bool:
    return 0 < at < len(units) and "\udc00" <= units[at] <= "\udfff"


def cut_points(units: str, room: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each piece; the pieces overlap and together cover the text."""
    start = 0
    while len(units) - start > room:
        places = (units.rfind(mark, start, start + room) - start for mark in ("\n\n", ". ", "\n"))
        size = next((p for p in places if p >= room // 3), room)
        size -= _inside_pair(units, start + size)
        yield start, start + size
        start += max(1, size - overlap)
        start += _inside_pair(units, start)
    if start < len(units):
        yield start, len(units)


def chunk_text(header: str, body: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """The chunks of a body, each after the header's line; an empty body gives one of the header alone."""
    head, text = _units(header) + "\n", _units((body or "").strip())
    if max_chars - len(head) < 2 * overlap:  # the header leaves no room: half of the chunk is its part
        at = min(len(head), max_chars // 2)
        head = head[: at - _inside_pair(head, at)] + "\n"
    pieces = [text[a:b].strip() if b < len(text) else text[a:b] for a, b in cut_points(text, max_chars - len(head), overlap)]
    return [_joined((head + p).rstrip()) for p in pieces or [""]]


def sources(df: DataFrame, kind: str) -> DataFrame:
    """(tenant_id, entity_type, entity_key, header, body) of commits, issues, pull requests or releases."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    who = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    blank = F.lit("")
    if kind == "commit":
        files = F.transform("files", lambda f: F.concat(F.lit("  "), f["path"], F.lit(" ("), f["status"], F.lit(" +"), f["additions"].cast("string"), F.lit(" -"), f["deletions"].cast("string"), F.lit(")\n")))
        rest = remainder(F.col("message"))
        key = F.col("sha")
        header = F.concat(F.lit("[commit "), F.left("sha", F.lit(7)), F.lit("] "), first_line(F.col("message")))
        body = F.concat(F.lit("author: "), who("author_name"), F.lit(" | committed: "), day("committed_at"), F.lit("\n"), F.when(rest != "", F.concat(normalise(rest), F.lit("\n"))).otherwise(blank), F.when(F.size("files") > 0, F.concat(F.lit("files changed:\n"), F.array_join(files, ""))).otherwise(blank))
    elif kind == "issue":
        key = F.col("number").cast("string")
        header = F.concat(F.lit("[issue #"), key, F.lit(" "), "state", F.lit("] "), "title")
        closed = F.coalesce(F.concat(F.lit(", closed "), day("closed_at")), blank)
        labels = F.when(F.size("labels") > 0, F.concat(F.lit("labels: "), F.array_join("labels", ", "), F.lit("\n"))).otherwise(blank)
        body = F.concat(labels, F.lit("opened by "), who("author"), F.lit(" on "), day("created_at"), closed, F.lit("\n"), normalise(F.col("body")))
    elif kind == "pull_request":
        key = F.col("number").cast("string")
        header = F.concat(F.lit("[pull request #"), key, F.lit(" "), F.when(F.col("merged_at").isNull(), F.col("state")).otherwise("merged"), F.lit("] "), "title")
        as_sha = F.when(F.length("merge_commit_sha") >= 7, F.concat(F.lit(" as "), F.left("merge_commit_sha", F.lit(7)))).otherwise(blank)
        merged = F.coalesce(F.concat(F.lit(", merged "), day("merged_at"), as_sha), blank)
        body = F.concat("head_ref", F.lit(" -> "), "base_ref", F.lit(" | opened by "), who("author"), F.lit(" on "), day("created_at"), merged, F.lit("\n"), normalise(F.col("body")))
    elif kind == "release":
        key = F.col("tag")
        header = F.concat(F.lit("[release "), "tag", F.lit("] "), F.coalesce("name", "tag"))
        body = F.concat(F.coalesce(F.concat(F.lit("published "), day("published_at"), F.lit("\n")), blank), normalise(F.col("body")))
    else:
        raise ValueError(f"{kind!r} is not an entity type")
    return df.select("tenant_id", F.lit(kind).alias("entity_type"), key.alias("entity_key"), header.alias("header"), body.alias("body"))


def chunks_of(header: Column, body: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """array<string> of chunks, Arrow batches in and out."""

    @F.pandas_udf("array<string>")
    def cut(head: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(h or "", t or "", max_chars, overlap) for h, t in zip(head, text, strict=True)])

    return cut(header, body)


def chunk(rows: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per chunk of (tenant_id, entity_type, entity_key, header, body) rows, in order from 0."""
    cut = rows.select("tenant_id", "entity_type", "entity_key", F.posexplode(chunks_of(F.col("header"), F.col("body"), max_chars, overlap)).alias("chunk_index", "content"))
    return cut.withColumn("approx_tokens", estimate_tokens(F.col("content")))
