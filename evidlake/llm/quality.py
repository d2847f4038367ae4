"""Quality rules with risk-controlled thresholds.

Fixed rules reject texts that are short or mostly repeat themselves. Beyond them, each rule in RULES
is a score with cutoffs from lenient to strict, and a set of cutoffs has at most one for each rule.
PATHS are sequences of sets, declared before any label is seen: all rules together, each rule alone, and
all rules but one; from set to set one rule is tightened by one cutoff. Labelled good documents are the
holdout: per stratum (language) the sets of a path are tested in order, until the first whose exact
binomial bound (Clopper-Pearson) on false rejection, by any of its rules, is above ALPHA. Testing in a
fixed order spends no error on the length of a path; Bonferroni's correction divides DELTA by the number
of strata and shares it among the paths (JOINT_SHARE for all rules together, the rest in equal parts).
So with probability 1 - DELTA, every set that was proven, in every stratum, loses at most ALPHA of the
good documents, and any of them may be used: the one that rejects most documents of the stratum is.
A stratum with too few labels for a proof keeps all that pass the base rules: `labels_needed` says how
many that takes.

Edge cases: null has no words and so fails the base rules; a null stratum is one of its own; labels
of unknown or null ids are ignored, the best of several labels counts; ids and rows that repeat are
judged row by row, but a labelled id is one trial in a stratum, lost if any of its rows is, however often
it repeats; a score equal to its cutoff passes; a very long text is counted whole, by itself; of sets that
reject as many documents the one declared first is used; empty tables give no rows or no cutoffs; other
columns, whatever their names, are ignored by `judge` and returned unchanged by `keep_good`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, picked, plain, settle, stored
from .wordhash import mixed, new_cache, windows

ALPHA = 0.01
DELTA = 0.05
REPEAT_WINDOW = 8
MIN_WORDS = 20
SLICE_BYTES = 1 << 20
BROADCAST_STRATA = 10_000

#: Cutoffs from lenient to strict.
RULES = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25),
    "duplicate_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeated_words": (0.29, 0.28, 0.27, 0.26, 0.25, 0.2, 0.15, 0.1),
    "capital_letters": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "stuttered_words": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}

#: Share of a stratum's error for the path of all rules together; the other paths have the rest in equal parts.
JOINT_SHARE = 0.9


def path_of(rules: list[str]) -> list[tuple[int, ...]]:
    """Sets of cutoffs, as so many cutoffs of each of RULES as are passed over (0: the rule isn't used), each rule tightened in turn."""
    sets, now = [], dict.fromkeys(RULES, 0)
    for step in range(max(map(len, RULES.values()))):
        for rule in rules:
            if step < len(RULES[rule]):
                now[rule] += 1
                sets.append(tuple(now.values()))
    return sets


PATHS = [path_of(list(RULES)), *[path_of([r]) for r in RULES], *[path_of([r for r in RULES if r != left]) for left in RULES]]
SHARES = [JOINT_SHARE] + [(1 - JOINT_SHARE) / (len(PATHS) - 1)] * (len(PATHS) - 1)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_stutters")
_SPACE = np.zeros(256, dtype=np.int64)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL = np.zeros(256, dtype=np.int64)
_CAPITAL[65:91] = 1
_POINT = np.ones(256, dtype=np.int64)
_POINT[0x80:0xC0] = 0


def count_texts(texts: list[bytes], cache: dict) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])

    def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return np.diff(np.r_[0, total[ends]])

    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter(map(cache.__getitem__, (x for w in words for x in w)), dtype=np.uint64, count=int(lengths.sum()))
    run, start = windows(h, lengths, REPEAT_WINDOW)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    _, place, count = np.unique(mixed(run ^ (owner[start] * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
    twice = start[count[place] > 1]
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT_WINDOW, -1)
    stutter = np.zeros(len(h), dtype=np.int64)
    stutter[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": lengths,
        "word_chars": per_text(_POINT[raw] - _SPACE[raw], ends),
        "n_symbols": per_text(_SYMBOL[raw], ends),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": per_text((np.cumsum(edge)[:-1] > 0).astype(np.int64), np.cumsum(lengths)),
        "n_capitals": per_text(_CAPITAL[raw], ends),
        "n_stutters": per_text(stutter, np.cumsum(lengths)),
    }


def _count_array(text: pa.Array) -> pa.Array:
    """Counts of a batch, a slice of about SLICE_BYTES at a time; a longer text is a slice of its own."""
    text, cache, parts, at = text.cast(pa.binary()), new_cache(), [], 0
    ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(text):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        parts.append(count_texts([t or b"" for t in text.slice(at, end - at).to_pylist()], cache))
        at = end
    cols = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
    give_back()
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in cols], names=list(COUNTS))


def counts(text: Column) -> Column:
    # Marked as not deterministic, so that Catalyst doesn't evaluate it once more for each use of its fields.
    return F.arrow_udf(_count_array, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">").asNondeterministic()(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def scores(c: Column) -> dict[str, Column]:
    ratio = lambda a, b: c[a] / F.greatest(c[b], F.lit(1))
    return {
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "capital_letters": ratio("n_capitals", "word_chars"),
        "stuttered_words": ratio("n_stutters", "n_words"),
    }


def binomial_at_most(x: int, n: int, p: float) -> float:
    """P(X <= x) of a binomial: at most its level exactly when the upper exact bound on the rate is at most p.

    Terms are added from x downwards until they no longer count, some multiple of their deviation many.
    """
    if n == 0 or x >= n:
        return 1.0
    k = min(x, math.ceil(n * p))  # the terms above the mean, if any, follow from the largest one
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    peak = term = math.exp(log)
    total = peak
    for j in range(k, 0, -1):
        term *= j * (1 - p) / ((n - j + 1) * p)
        total += term
        if term < total * 1e-18:
            break
    term = peak
    for j in range(k, x):
        term *= (n - j) * p / ((j + 1) * (1 - p))
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, total)


#: All declared sets in order, as an array of arrays in SQL.
SETS = "array(" + ", ".join("array(" + ", ".join(map(str, s)) + ")" for path in PATHS for s in path) + ")"


def labels_needed(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The fewest labelled good documents of a stratum, none of them lost, that prove a set of all rules together."""
    return math.ceil(math.log(JOINT_SHARE * delta / strata) / math.log1p(-alpha))


def passed(c: Column) -> list[Column]:
    """How many cutoffs of each rule a document passes, from the lenient ones on."""
    of = scores(c)
    return [sum(((of[rule] <= cut).cast("int") for cut in cuts[1:]), (of[rule] <= cuts[0]).cast("int")) for rule, cuts in RULES.items()]


def by_set(profiles: DataFrame, count: str) -> DataFrame:
    """(stratum, idx, count) of (stratum, t0, t1, ..., n): for each declared set, how many of n it rejects."""
    over = " OR ".join(f"s[{i}] > t{i}" for i in range(len(RULES)))
    rejects = F.expr(f"transform({SETS}, s -> cast({over} AS int))")
    each = profiles.select("stratum", "n", F.posexplode(rejects).alias("idx", "gone"))
    return each.groupBy("stratum", "idx").agg(F.sum(F.col("n") * F.col("gone")).alias(count))


def thresholds(measured: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """measured: (doc_id, stratum, c) -> (stratum, cutoffs map of rule to cutoff); one row per stratum that has any.

    Documents are counted by the cutoffs that they pass (at most 9 to the power of the rules, for each
    stratum, whatever the input); sets are then tried on these counts.
    """
    t = [f"t{i}" for i in range(len(RULES))]
    labels = picked(labels, _l="doc_id", quality="quality")
    good = labels.where("_l is not null").groupBy("_l").agg(F.max("quality").alias("q")).where("q = 1").select("_l")
    rows = measured.where(~base_failed(F.col("c"))).select("doc_id", "stratum", *[x.alias(n) for n, x in zip(t, passed(F.col("c")), strict=True)])
    held = rows.join(good, rows.doc_id == good._l).groupBy("stratum", "doc_id").agg(*[F.min(n).alias(n) for n in t])
    held, every = (settle(x.groupBy("stratum", *t).agg(F.count("*").alias("n"))) for x in (held, rows))
    trials = settle(held.groupBy("stratum").agg(F.sum("n").alias("n")))
    strata = max(1, trials.count())

    @F.pandas_udf("double")
    def chance(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_at_most(int(a), int(b), alpha) for a, b in zip(x, n, strict=True)], dtype="float64")

    declared = [(idx, p, i, share * delta / strata) for idx, (p, i, share) in enumerate((p, i, share) for p, (path, share) in enumerate(zip(PATHS, SHARES, strict=True)) for i in range(len(path)))]
    sets = measured.sparkSession.createDataFrame(declared, "idx int, path int, step int, level double")
    same = lambda a: F.col("stratum").eqNullSafe(F.col(a))
    lost = by_set(held, "x").join(trials.select(F.col("stratum").alias("_s"), "n"), same("_s")).join(F.broadcast(sets), "idx")
    tested = lost.withColumn("safe", (chance("x", "n") <= F.col("level")).cast("int"))
    w = Window.partitionBy("stratum", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a path of a stratum: some tens of rows
    proven = tested.withColumn("ok", F.min("safe").over(w)).where("ok = 1").select("stratum", "idx")
    gone = by_set(every, "gone").select(F.col("stratum").alias("_s"), F.col("idx").alias("_i"), "gone")
    best = proven.join(gone, same("_s") & (F.col("idx") == F.col("_i"))).groupBy("stratum").agg(F.max(F.struct("gone", -F.col("idx"))).alias("b"))
    chosen = F.element_at(F.expr(SETS), (1 - F.col("b.col2")).cast("int"))
    cuts = F.array(*[F.array(*map(F.lit, cuts)) for cuts in RULES.values()])
    names = F.array(*map(F.lit, RULES))
    used = F.filter(F.transform(chosen, lambda s, i: F.struct(names[i].alias("rule"), F.when(s > 0, cuts[i][F.greatest(s - 1, F.lit(0))]).alias("cut"))), lambda e: e["cut"].isNotNull())
    return settle(best.select("stratum", F.map_from_entries(used).alias("cutoffs")))


def verdict(rows: DataFrame, cutoffs: DataFrame, counted: str = "c", stratum: str = "stratum") -> DataFrame:
    """Adds base_failed, rejected_by (rules whose cutoff the row exceeds) and kept."""
    small = cutoffs.count() <= BROADCAST_STRATA
    named = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    out = rows.join(F.broadcast(named) if small else named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    failed = [F.when(s > F.element_at("_cutoffs", F.lit(rule)), F.lit(rule)) for rule, s in scores(F.col(counted)).items()]
    rejected = F.array_compact(F.array(*failed))
    return out.withColumn("base_failed", base_failed(F.col(counted))).withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "_cutoffs")


def judge(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang", **risk) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, rejected_by, kept."""
    docs = picked(docs, doc_id=id_col, stratum=stratum_col, text=text_col)
    measured = settle(docs.select("doc_id", "stratum", counts(F.col("text")).alias("c")))
    out = verdict(measured, thresholds(measured, labels, **risk))
    return out.select("doc_id", "c.*", "base_failed", "rejected_by", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang", **risk) -> DataFrame:
    """The documents that the rules keep, all columns.

    Texts are counted once: documents are written with their counts, from which the cutoffs' pass reads
    the counts alone; nothing but counts of labelled documents is shuffled.
    """
    rows, name = plain(docs)
    counted = stored(rows.withColumn("counted", counts(F.col(name(text_col)))), "quality")
    measured = counted.select(F.col(name(id_col)).alias("doc_id"), F.col(name(stratum_col)).alias("stratum"), F.col("counted").alias("c"))
    judged = verdict(counted, thresholds(measured, labels, **risk), "counted", name(stratum_col))
    return judged.where("kept").select(*rows.columns).toDF(*docs.columns)
