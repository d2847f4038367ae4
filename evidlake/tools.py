"""The six questions that callers ask, as functions of a tenant's scope and JSON-like arguments.

A tool answers with rows, the exact total behind a capped page, and what the corpus covers. Bad
arguments are an error result, never an exception, so that a caller can correct them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import evidence, hybrid, ivf, textindex, vector, windows
from .scope import TenantScope

#: Passages that a search of the stored corpus returns, by default and at most, and characters of each.
PASSAGES, MOST_PASSAGES, EXCERPT = 5, 10, 500
#: Chunks that each ranking hands to the fusion.
POOL = 50


@dataclass
class Result:
    rows: list[dict] = field(default_factory=list)
    matched: int | None = None
    coverage: dict | None = None
    notes: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def truncated(self) -> bool:
        return self.matched is not None and len(self.rows) < self.matched


@dataclass
class Corpus:
    """A stored corpus: its chunks, and the two indexes over them."""

    chunks: DataFrame
    vectors: ivf.InvertedFile
    terms: DataFrame


class BadArgument(ValueError):
    pass


def text(args: dict, name: str, default: str | None = None) -> str | None:
    value = args.get(name)
    if value is None:
        return default
    if not isinstance(value, str):
        raise BadArgument(f"'{name}' must be a string")
    return value


def whole(args: dict, name: str) -> int | None:
    value = args.get(name)
    if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
        raise BadArgument(f"'{name}' must be a whole number")
    return value


def texts(args: dict, name: str) -> list[str] | None:
    """A list of strings; a single string counts as a list of one, an empty list is an error."""
    value = args.get(name)
    if value is None:
        return None
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, list) or not value or not all(isinstance(x, str) for x in value):
        raise BadArgument(f"'{name}' must be a list of at least one string")
    return value


def _window(args: dict) -> tuple[windows.Bound | None, windows.Bound | None]:
    try:
        return windows.parse_bound(text(args, "since")), windows.parse_bound(text(args, "until"), upper=True)
    except ValueError as e:
        raise BadArgument(str(e)) from None


def _dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


TABLES = {"commit": "commits", "issue": "issues", "pull_request": "pull_requests", "release": "releases"}


def count_evidence(scope: TenantScope, args: dict) -> Result:
    kind, labels = text(args, "entity_type", ""), texts(args, "labels")
    try:
        column = evidence.date_column(kind, text(args, "date_field", "created"))
    except ValueError as e:
        raise BadArgument(str(e)) from None
    if labels and kind != "issue":
        raise BadArgument("only issues carry labels")
    since, until = _window(args)
    row = evidence.count_with_coverage(scope.table(TABLES[kind]), column, since, until, labels).first()
    return Result(matched=row.n, rows=[{"count": row.n}], coverage=row.asDict(), notes=[windows.describe(column, since, until)])


def list_releases(scope: TenantScope, args: dict) -> Result:
    matching = evidence.releases(scope.table("releases"), text(args, "tag_prefix"), *_window(args))
    page = evidence.release_page(matching, whole(args, "limit"))
    return Result(rows=_dicts(page.select("tag", "name", "published_at", "url")), matched=matching.count(), coverage=evidence.coverage(scope.table("releases"), "published_at").first().asDict())


def diff_between_releases(scope: TenantScope, args: dict) -> Result:
    tags = [text(args, "from_tag"), text(args, "to_tag")]
    if None in tags:
        raise BadArgument("'from_tag' and 'to_tag' are needed")
    window = evidence.release_window(scope.table("releases"), *tags)
    ends = window.first()
    for tag, at in zip(tags, ends, strict=True):
        if at is None:
            raise BadArgument(f"no published release {tag!r}")
    matching = evidence.commits_between(scope.table("commits"), window)
    return Result(rows=_dicts(evidence.commit_page(matching, whole(args, "limit")).select("sha", "message", "author_name", "committed_at", "url")), matched=matching.count(), notes=["a window of dates, not a walk of the history"])


def find_regressions(scope: TenantScope, args: dict) -> Result:
    since, _ = _window(args)
    matching = evidence.regressions(scope.table("issues"), text(args, "area", ""), since)
    page = matching.orderBy(F.desc("created_at"), "number").limit(evidence.clamp(whole(args, "limit"), 20, 50))
    fixed = evidence.fixed_by(page, scope.table("pull_requests")).orderBy(F.desc("created_at"), "number")
    return Result(rows=_dicts(fixed.select("number", "title", "state", "labels", "created_at", "url", "fixed_by")), matched=matching.count())


def get_issue(scope: TenantScope, args: dict) -> Result:
    number = whole(args, "number")
    if number is None or number <= 0:
        raise BadArgument("'number' must be a positive whole number")
    rows = _dicts(scope.table("issues").where(F.col("number") == number).limit(2))
    return Result(rows=rows) if rows else Result(error=f"no issue {number}")


def search_commits(scope: TenantScope, args: dict, embed: Callable[[str], list[float]]) -> Result:
    query = text(args, "query", "")
    if not query.strip():
        raise BadArgument("'query' is needed")
    try:
        since, until = (windows.parse_bound(text(args, n)) for n in ("since", "until"))
    except ValueError:  # a search reads an unclear date as none
        since = until = None
    value = lambda b: b.value if b else None
    request = hybrid.Request(query, embed(query), k=evidence.clamp(whole(args, "limit"), 8, 25), entity_type=text(args, "entity_type"), since=value(since), until=value(until), path=text(args, "path"))
    found = hybrid.retrieve(scope.table("evidence_chunks"), scope.table("embeddings"), request, commits=scope.table("commits"), files=scope.table("files_changed"), cover=True)
    rows = _dicts(found)
    matches = rows[0]["text_match_count"] if rows else 0
    by_text = [r for r in rows if r["text_score"] > 0]
    seen = list(dict.fromkeys((r["entity_type"], r["entity_key"]) for r in rows))
    return Result(rows=rows, matched=matches if by_text else None, coverage={"returned_by_text": len(by_text), "artefacts": len(seen)}, notes=hybrid.notes(len(rows), matches, request))


def search_corpus(stored: Corpus, args: dict, embed: Callable[[str], list[float]]) -> Result:
    """The best passages of a stored corpus: artefact, type, excerpt and the score of both rankings fused.

    Reads the indexes and the few chunks that are shown; nothing is scanned whole.
    """
    query, top = text(args, "query", ""), whole(args, "top")
    if not query.strip():
        raise BadArgument("'query' is needed")
    if top is not None and not 1 <= top <= MOST_PASSAGES:
        raise BadArgument(f"'top' must be between 1 and {MOST_PASSAGES}")
    spark = stored.chunks.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in embed(query)])], "qid int, embedding array<double>")
    by_vector = ivf.topk(stored.vectors, asked, POOL).select("qid", "chunk_id", "rank")
    by_text = textindex.search_index(stored.terms, query, k=POOL)
    w = Window.partitionBy("qid").orderBy(F.desc("text_score"), "chunk_id")  # POOL rows
    by_text = by_text.withColumn("qid", F.lit(0)).withColumn("rank", F.row_number().over(w)).select("qid", "chunk_id", "rank")
    best = vector.fused_ranks(by_vector.unionByName(by_text)).orderBy(F.desc("fused"), "chunk_id").limit(top or PASSAGES).collect()
    score = {r.chunk_id: r.fused for r in best}
    shown = stored.chunks.where(F.col("chunk_id").isin(list(score))).select("chunk_id", "entity_type", "entity_key", F.left("content", F.lit(EXCERPT)).alias("excerpt")).collect()
    rows = [{"artefact": f"{r.entity_type}:{r.entity_key}", "type": r.entity_type, "excerpt": r.excerpt, "score": score[r.chunk_id]} for r in sorted(shown, key=lambda r: (-score[r.chunk_id], r.chunk_id))]
    return Result(rows=rows)


def registry(embed: Callable[[str], list[float]]) -> dict[str, Callable[[TenantScope, dict], Result]]:
    """The tools by name, each turning bad arguments into an error result."""

    def guarded(tool: Callable[..., Result], *more: Any) -> Callable[[TenantScope, dict], Result]:
        def call(scope: TenantScope, args: dict) -> Result:
            try:
                return tool(scope, args, *more)
            except BadArgument as e:
                return Result(error=str(e))

        return call

    # search_corpus takes a stored corpus in place of a scope.
    plain = (get_issue, diff_between_releases, find_regressions, count_evidence, list_releases)
    return {"search_commits": guarded(search_commits, embed), "search_corpus": guarded(search_corpus, embed)} | {t.__name__: guarded(t) for t in plain}
