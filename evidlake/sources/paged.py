"""Evidence from a paged service or a recorded folder of its pages, as a Spark data source.

A page is a list of JSON objects. The recorded form is a folder of `page-<n>.jsonl` files per entity
type; the live form is any callable that answers a request. Cursors are running maxima and never go
back, however pages are ordered.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: The field that moves each entity type's cursor; the others are read in full.
CURSOR_FIELDS = {"commit": ("commit", "committer", "date"), "issue": ("updated_at",), "pull_request": None, "release": None}

#: Payloads as the service writes them.
PAYLOADS = {
    "commit": "sha string, html_url string, commit struct<message:string, author:struct<name:string,email:string,date:timestamp>, committer:struct<name:string,email:string,date:timestamp>>, files array<struct<filename:string,status:string,additions:int,deletions:int>>",
    "issue": "number int, title string, body string, state string, labels array<struct<name:string>>, user struct<login:string>, created_at timestamp, updated_at timestamp, closed_at timestamp, html_url string, pull_request string",
    "pull_request": "number int, title string, body string, state string, merged_at timestamp, merge_commit_sha string, base struct<ref:string>, head struct<ref:string>, user struct<login:string>, created_at timestamp, html_url string",
    "release": "tag_name string, name string, body string, published_at timestamp, target_commitish string, html_url string",
}


class RateGate:
    """A token bucket: refilled by the hour's allowance, at most a hundred at first, shut by the server until its reset."""

    def __init__(self, per_hour: int, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if per_hour <= 0:
            raise ValueError("the allowance must be positive")
        self.per_hour, self.now, self.sleep = per_hour, now, sleep
        self.tokens, self.filled, self.shut_until = float(min(per_hour, 100)), now(), 0.0

    def observe(self, remaining: int, reset_at: float) -> None:
        if remaining <= 0:
            self.shut_until = reset_at

    def wait_needed(self) -> float:
        """0 after taking a token, else the seconds to wait."""
        t = self.now()
        if t < self.shut_until:
            return self.shut_until - t
        self.tokens = min(self.per_hour, self.tokens + max(0.0, t - self.filled) * self.per_hour / 3600)
        self.filled = max(t, self.filled)
        if self.tokens < 1:
            return (1 - self.tokens) * 3600 / self.per_hour
        self.tokens -= 1
        return 0.0

    def acquire(self) -> None:
        while (seconds := self.wait_needed()) > 0:
            self.sleep(seconds)


def follow(fetch: Callable[[str, str | None], tuple[int, dict, list]], first: str, etag: str | None = None, gate: RateGate | None = None) -> Iterator[tuple[list, str | None]]:
    """(rows, etag) of each page from `first` on: fetch(url, etag) answers (status, headers, rows).

    The etag goes with the first request only; 304 ends the walk, any other failure is an error.
    """
    url = first
    while url:
        if gate is not None:
            gate.acquire()
        status, headers, rows = fetch(url, etag if url == first else None)
        if gate is not None and "x-ratelimit-remaining" in headers:
            gate.observe(int(headers["x-ratelimit-remaining"]), float(headers.get("x-ratelimit-reset", 0)))
        if status == 304:
            return
        if not 200 <= status < 300:
            raise OSError(f"{url} answered {status}")
        yield rows, headers.get("etag")
        links = dict(reversed([x.strip() for x in part.split(";", 1)]) for part in headers.get("link", "").split(",") if ";" in part)
        url = links.get('rel="next"', "").strip("<>") or None


def cursor_of(payload: dict, kind: str) -> str | None:
    at = payload
    for key in CURSOR_FIELDS[kind] or ():
        at = (at or {}).get(key)
    return at if CURSOR_FIELDS[kind] else None


class ReplaySource(DataSource):
    """spark.read or readStream.format("evidence_replay"): options path and kind. One row (page, payload) per object.

    A stream reads one page per batch and resumes after the last; its offset carries the cursor.
    """

    @classmethod
    def name(cls):
        return "evidence_replay"

    def schema(self):
        return "page int, payload string"

    def reader(self, schema):
        return _ReplayReader(self.options["path"], self.options["kind"])

    def simpleStreamReader(self, schema):
        return _ReplayStream(self.options["path"], self.options["kind"])


def _pages(path: str, kind: str) -> list[str]:
    folder = os.path.join(path.removeprefix("file://"), kind)
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("page-")) if os.path.isdir(folder) else []


class _Page(InputPartition):
    pass


class _ReplayReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self):
        return [_Page((i, f)) for i, f in enumerate(_pages(self.path, self.kind))]

    def read(self, partition):
        if partition is None:  # no page at all
            return
        i, file = partition.value
        with open(file, encoding="utf-8") as f:
            yield from ((i, line.rstrip("\n")) for line in f if line.strip())


class _ReplayStream(SimpleDataSourceStreamReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def initialOffset(self):
        return {"page": 0, "cursor": None}

    def read(self, start):
        pages = _pages(self.path, self.kind)
        if start["page"] >= len(pages):
            return iter(()), start
        rows = list(_ReplayReader(self.path, self.kind).read(_Page((start["page"], pages[start["page"]]))))
        seen = [c for c in (cursor_of(json.loads(r[1]), self.kind) for r in rows) if c]
        cursor = max([*seen, *([start["cursor"]] if start["cursor"] else [])], default=None)
        return iter(rows), {"page": start["page"] + 1, "cursor": cursor}

    def readBetweenOffsets(self, start, end):
        pages = _pages(self.path, self.kind)
        return iter([r for i in range(start["page"], end["page"]) for r in _ReplayReader(self.path, self.kind).read(_Page((i, pages[i])))])


def records(payloads: DataFrame, kind: str, tenant_id: str, column: str = "payload") -> DataFrame:
    """Payloads (JSON text) as rows of the kind's table. Issues that are pull requests are left out; gaps get defaults."""
    p = payloads.select(F.from_json(column, PAYLOADS[kind]).alias("p")).select("p.*")
    tenant = F.lit(tenant_id).alias("tenant_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if kind == "commit":
        epoch = F.timestamp_seconds(F.lit(0))
        when = lambda *cs: F.coalesce(*[F.col(c) for c in cs], epoch)
        files = F.coalesce(F.transform("files", lambda f: F.struct(f["filename"].alias("path"), f["status"].alias("status"), f["additions"].alias("additions"), f["deletions"].alias("deletions"))), F.array())
        return p.select(tenant, "sha", text("commit.message").alias("message"), F.col("commit.author.name").alias("author_name"), F.col("commit.author.email").alias("author_email"), when("commit.author.date", "commit.committer.date").alias("authored_at"), when("commit.committer.date", "commit.author.date").alias("committed_at"), F.col("html_url").alias("url"), files.alias("files"))
    if kind == "issue":
        labels = F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>"))
        return p.where("pull_request is null").select(tenant, "number", text("title").alias("title"), text("body").alias("body"), "state", labels.alias("labels"), F.col("user.login").alias("author"), "created_at", "closed_at", F.col("html_url").alias("url"))
    if kind == "pull_request":
        ref = lambda c: F.coalesce(F.col(c), F.lit("main"))
        return p.select(tenant, "number", text("title").alias("title"), text("body").alias("body"), "state", "merged_at", "merge_commit_sha", ref("base.ref").alias("base_ref"), F.coalesce("head.ref", F.lit("")).alias("head_ref"), F.col("user.login").alias("author"), "created_at", F.col("html_url").alias("url"))
    return p.select(tenant, F.col("tag_name").alias("tag"), "name", text("body").alias("body"), "published_at", "target_commitish", F.col("html_url").alias("url"))


def high_water(df: DataFrame, column: Column, previous: str | None) -> str | None:
    """The cursor after a batch: the larger of its maximum and the previous one."""
    top = df.agg(F.max(column).cast("string").alias("m")).first().m
    return max(x for x in (top, previous) if x is not None) if (top or previous) else None
