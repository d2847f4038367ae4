"""Date windows. Three conventions exist side by side, so a window always says which it is."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """A moment; whole_day where a plain date was read as the end of that day."""

    value: datetime
    text: str
    whole_day: bool = False


def parse_bound(text: str | None, *, upper: bool = False) -> Bound | None:
    """None for no text. A plain date as upper bound takes in that day. What isn't a date is an error."""
    if not text:
        return None
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{text!r} is not an ISO-8601 date; use a form like 2024-01-01") from None
    value = (value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)).replace(tzinfo=None)
    whole = upper and re.fullmatch(r"\d{4}-\d\d-\d\d", text) is not None
    return Bound(value + timedelta(days=1) if whole else value, text, whole)


def _moment(b: Bound | datetime | str | None):
    return b.value if isinstance(b, Bound) else b


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def half_open(col: Column, since=None, until=None) -> Column:
    """since <= col < until, for counts and listings."""
    low, high = _moment(since), _moment(until)
    return _all([col >= F.lit(low)] * (low is not None) + [col < F.lit(high)] * (high is not None))


def after_upto(col: Column, start, end) -> Column:
    """start < col <= end, for the difference of two releases."""
    return (col > start) & (col <= end)


def closed(col: Column, since=None, until=None) -> Column:
    """since <= col <= until, for searches."""
    low, high = _moment(since), _moment(until)
    return _all([col >= F.lit(low)] * (low is not None) + [col <= F.lit(high)] * (high is not None))


def describe(column: str, since: Bound | None, until: Bound | None) -> str:
    """The window in words, as it was applied."""
    if since is None and until is None:
        return f"no date window - every record with a {column} value"
    stamp = lambda b: b.value.strftime("%Y-%m-%dT%H:%M:%SZ")
    said = " and ".join(f"{column} {sign} {stamp(b)}" for sign, b in ((">=", since), ("<", until)) if b is not None)
    return said + (f' (until="{until.text}" was read as the whole of that day)' if until is not None and until.whole_day else "")
