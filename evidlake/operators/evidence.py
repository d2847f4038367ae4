"""Counts, listings and links over evidence tables.

A page and its total are built from one filtered frame, so they can't disagree about what matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows

#: The date fields that may be counted, (entity type, field) -> column.
DATE_FIELDS = {
    ("commit", "committed"): "committed_at",
    ("issue", "created"): "created_at",
    ("issue", "closed"): "closed_at",
    ("pull_request", "created"): "created_at",
    ("pull_request", "merged"): "merged_at",
    ("release", "published"): "published_at",
}
#: The labels that make an issue a regression, case-sensitive.
REGRESSION_LABELS = ("bug", "regression", "Bug", "kind:bug")


def date_column(entity_type: str, field: str) -> str:
    try:
        return DATE_FIELDS[entity_type, field]
    except KeyError:
        raise ValueError(f"{entity_type} has no countable date {field!r}; known: {sorted(DATE_FIELDS)}") from None


def clamp(limit: int | None, default: int, most: int) -> int:
    return default if limit is None else max(1, min(most, limit))


def has_label(labels: Column, wanted: list[str]) -> Column:
    """At least one label in common, whatever the case."""
    low = F.array(*[F.lower(F.lit(w)) for w in wanted])
    return F.arrays_overlap(F.transform(labels, F.lower), low)


def in_window(df: DataFrame, column: str, since=None, until=None, labels: list[str] | None = None) -> DataFrame:
    """Rows with the date in [since, until); rows without the date never count."""
    out = df.where(F.col(column).isNotNull() & windows.half_open(F.col(column), since, until))
    if not labels:
        return out
    if "labels" not in df.columns:
        raise ValueError("only issues carry labels")
    return out.where(has_label(F.col("labels"), labels))


def count(df: DataFrame, column: str, since=None, until=None, labels: list[str] | None = None) -> DataFrame:
    return in_window(df, column, since, until, labels).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Earliest, latest and number of dated rows, unfiltered: what a count may be compared with."""
    return df.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"), F.count(column).alias("total"))


def count_with_coverage(df: DataFrame, column: str, since=None, until=None, labels: list[str] | None = None) -> DataFrame:
    """Count and coverage from one scan, and whether the corpus spans the whole window."""
    c = F.col(column)
    hit = c.isNotNull() & windows.half_open(c, since, until)
    if labels:
        hit = hit & has_label(F.col("labels"), labels)
    out = df.agg(F.count_if(hit).alias("n"), F.min(c).alias("earliest"), F.max(c).alias("latest"), F.count(c).alias("total"))
    low, high = windows._moment(since), windows._moment(until)
    spans = F.col("total") > 0
    spans = spans & (F.lit(True) if low is None else F.col("earliest") <= F.lit(low)) & (F.lit(True) if high is None else F.col("latest") >= F.lit(high))
    return out.withColumn("complete_for_window", spans)


def releases(df: DataFrame, prefix: str | None = None, since=None, until=None) -> DataFrame:
    """Releases by literal tag prefix and window; without bounds undated ones stay."""
    out = df if prefix is None else df.where(F.col("tag").startswith(prefix))
    return out.where(windows.half_open(F.col("published_at"), since, until))


def release_page(matching: DataFrame, limit: int | None = None) -> DataFrame:
    return matching.orderBy(F.col("published_at").desc_nulls_last(), F.col("tag").desc()).limit(clamp(limit, 50, 300))


def release_window(df: DataFrame, from_tag: str, to_tag: str) -> DataFrame:
    """One row (start, end): when two tags were published; null where unknown."""
    at = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("published_at")))
    return df.where(F.col("tag").isin(from_tag, to_tag)).agg(at(from_tag).alias("start"), at(to_tag).alias("end"))


def commits_between(commits: DataFrame, window: DataFrame) -> DataFrame:
    """Commits after the first release and up to the second. The window is one row."""
    bounds = F.broadcast(window)  # one row by construction
    return commits.join(bounds, windows.after_upto(F.col("committed_at"), F.col("start"), F.col("end"))).drop("start", "end")


def commit_page(matching: DataFrame, limit: int | None = None) -> DataFrame:
    return matching.orderBy("committed_at", "sha").limit(clamp(limit, 40, 100))


def regressions(issues: DataFrame, area: str = "", since=None) -> DataFrame:
    """Issues with a regression label; an area is a case-insensitive part of title or body, with SQL wildcards."""
    out = issues.where(F.arrays_overlap("labels", F.array(*map(F.lit, REGRESSION_LABELS))))
    out = out.where(windows.half_open(F.col("created_at"), since, None))
    like = f"%{area}%"
    return out.where(F.col("title").ilike(like) | F.col("body").ilike(like)) if area else out


def mentions(pulls: DataFrame) -> DataFrame:
    """(mentioned number, pull, merged_at) for each #number in a merged pull request's title or body."""
    text = F.concat_ws("\n", "title", "body")
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)\b"), 1), lambda x: x.try_cast("int")))
    return pulls.where("merged_at is not null").select(F.explode(found).alias("mentioned"), F.col("number").alias("pull"), "merged_at")


def fixed_by(issues: DataFrame, pulls: DataFrame) -> DataFrame:
    """Issues with the earliest pull request that mentions them and merged no sooner than they were opened.

    Mentions are extracted once and joined on the number, so no issue is compared with every pull
    request; the least is kept before issues are joined back.
    """
    keyed = issues.select(F.col("number").alias("_n"), F.col("created_at").alias("_c")).distinct()
    m = mentions(pulls)
    first = m.join(keyed, (m.mentioned == F.col("_n")) & (m.merged_at >= F.col("_c"))).groupBy("_n", "_c").agg(F.min(F.struct("merged_at", "pull")).alias("f"))
    out = issues.join(first, (issues.number == F.col("_n")) & (issues.created_at == F.col("_c")), "left")
    return out.select(*[issues[c] for c in issues.columns], F.col("f.pull").alias("fixed_by"))


def by_day(t: Column) -> Column:
    return F.date_trunc("day", t)


def next_after(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, *, bucket: Callable[[Column], Column] = by_day) -> DataFrame:
    """Forward as-of join: each left row's first right value of the same key at or after its time, else null.

    Both sides meet in one shuffle on key and bucket of time, so a hot key is spread over its buckets. A
    window looks back over descending time within a bucket; its frame only grows, so the work is linear.
    Where nothing follows there, the first value of the next bucket that has any is taken, from one row
    per key and bucket. `bucket` must not fall as time rises. Nothing is multiplied. Equal times are
    decided by the least value; right rows without key, time or value and left ones without key or time
    match nothing.
    """
    w = [F.col(k) for k in keys]
    stamp = lambda df, t, is_right, row, val: df.select(*w, F.col(t).alias("_t"), F.lit(is_right).alias("_r"), row.alias("_row"), val.alias("_v"))
    null_row = F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType)
    null_value = F.lit(None).cast(right.schema[value].dataType)
    both = stamp(left, left_time, 0, F.struct(*left.columns), null_value).unionByName(stamp(right.dropna(subset=[*keys, right_time, value]), right_time, 1, null_row, F.col(value)))
    both = both.withColumn("_b", bucket(F.col("_t")))
    back = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").desc(), F.col("_r").desc(), F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_here", F.last("_v", ignorenulls=True).over(back)).where("_r = 0")

    first = F.min(F.when(F.col("_r") == 1, F.struct("_t", "_v")))["_v"]
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = both.where("_b is not null").groupBy(*keys, "_b").agg(first.alias("_first")).withColumn("_later", F.last("_first", ignorenulls=True).over(later))
    heads = heads.where("_later is not null").select(*[c.alias(f"_k{i}") for i, c in enumerate(w)], F.col("_b").alias("_kb"), "_later")
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(w):
        same = same & (c == F.col(f"_k{i}"))
    return rows.join(heads, same, "left").select("_row.*", F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_later")).alias(value))


def link_edges(pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """(pull_request, commit) artefacts of merged pull requests whose merge commit is known."""
    p = pulls.where("merged_at is not null").select("tenant_id", "number", F.col("merge_commit_sha").alias("sha"))
    return p.join(commits.select("tenant_id", "sha").distinct(), ["tenant_id", "sha"]).select(F.concat(F.lit("pull_request:"), F.col("number").cast("string")).alias("pull_request"), F.concat(F.lit("commit:"), "sha").alias("commit"))


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(artefact, other): every link once from either side. This form has no row that grows with a hub's links."""
    return edges.select(F.col(a).alias("artefact"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("artefact"), F.col(a).alias("other"))).distinct()


def adjacency(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(artefact, linked): the sorted neighbours of every artefact, in both directions, for artefacts with few links."""
    return neighbours(edges, a, b).groupBy("artefact").agg(F.sort_array(F.collect_list("other")).alias("linked"))
