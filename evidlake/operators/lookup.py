"""Point lookups by natural key, for one key or a frame of them, and keys in pages.

One key is a filter that reaches the scan; a frame of keys is a join, sent to the rows by broadcast up to a
counted bound. Beyond it both are dealt by key to as many tasks as their counted rows call for, so that a
task's part doesn't grow with the tables. What isn't found is null, not an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import numbered, small
from ..scope import TenantScope

#: Table and natural key of each kind of evidence.
KEYS = {"commit": ("commits", "sha"), "release": ("releases", "tag"), "issue": ("issues", "number"), "pull_request": ("pull_requests", "number")}
BROADCAST_KEYS = 1_000_000
#: Rows of the largest table of a join that are a task's part.
TASK_ROWS = 250_000
PAGE = 1000


def point(scope: TenantScope, kind: str, key: str | int) -> DataFrame:
    """The row of one artefact, or none."""
    table, column = KEYS[kind]
    return scope.table(table).where(F.col(column) == F.lit(key))


def files_of(scope: TenantScope, sha: str) -> DataFrame:
    """(path, status, additions, deletions) of a commit, by path."""
    return scope.table("files_changed").where(F.col("sha") == F.lit(sha)).select("path", "status", "additions", "deletions").orderBy("path")


def _tasks(*frames: DataFrame) -> int:
    """How many tasks share a join of these frames, by the rows of the largest."""
    return max(1, math.ceil(max(df.count() for df in frames) / TASK_ROWS))


def _of_keys(rows: DataFrame, column: str, wanted: DataFrame, key: str, tasks: int) -> DataFrame:
    """The rows of the wanted keys, dealt to tasks by key: all of them before the join where the keys are too many for a broadcast."""
    sent = small(wanted, BROADCAST_KEYS)
    same = F.col(column) == F.col(key)
    return rows.repartition(tasks, column).join(wanted, same, "left_semi") if sent is wanted else rows.join(sent, same, "left_semi").repartition(tasks, column)


def points(rows: DataFrame, column: str, keys: DataFrame, key: str = "key", *, tasks: int | None = None) -> DataFrame:
    """(key, found, row) for every distinct key that isn't null: the row as a struct, null if there is none."""
    tasks = tasks or _tasks(rows, keys)
    wanted = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().repartition(tasks, "_key")
    met = _of_keys(rows, column, wanted, "_key", tasks).select(F.col(column).alias("_row_key"), F.struct(*rows.columns).alias("row"))
    out = wanted.join(met, F.col("_key") == F.col("_row_key"), "left")
    return out.select(F.col("_key").alias(key), F.col("_row_key").isNotNull().alias("found"), "row")


def commits_with_files(commits: DataFrame, files: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """points() of commits with `files`, structs in order of path; a commit without files has an empty list.

    Only files of the wanted commits are gathered; a commit's files are one list, as its row shows them.
    """
    tasks = _tasks(commits, files, keys)
    found = points(commits, "sha", keys, key, tasks=tasks)
    wanted = found.where("found").select(F.col(key).alias("_sha"))
    own = _of_keys(files, "sha", wanted, "_sha", tasks)
    listed = own.groupBy(F.col("sha").alias("_sha")).agg(F.sort_array(F.collect_list(F.struct("path", "status", "additions", "deletions"))).alias("files"))
    return found.join(listed, F.col(key) == F.col("_sha"), "left").select(key, "found", "row", F.when(F.col("found"), F.coalesce("files", F.array())).alias("files"))


def tenant_of(tenants: DataFrame, slug: str) -> DataFrame:
    return tenants.where(F.col("slug") == F.lit(slug))


def key_owner(api_keys: DataFrame, tenants: DataFrame, key_hash: Column, now: Column) -> DataFrame:
    """The tenant that a key's hash stands for, unless the key is revoked by then."""
    valid = api_keys.where((F.col("key_hash") == key_hash) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > now))).select("tenant_id")
    return tenants.join(F.broadcast(valid), "tenant_id", "left_semi")


def key_pages(rows: DataFrame, *, by: list[str], key: str, page: int = PAGE) -> DataFrame:
    """(by..., page from 0, keys): the distinct keys of each group in order, so many a page; a hot group is many tasks' work."""
    if page < 1:
        raise ValueError("a page has one key at least")
    placed = numbered(rows.where(F.col(key).isNotNull()).select(*by, key).distinct(), [key], by)
    return placed.groupBy(*by, F.floor((F.col("place") - 1) / page).cast("int").alias("page")).agg(F.sort_array(F.collect_list(key)).alias("keys"))
