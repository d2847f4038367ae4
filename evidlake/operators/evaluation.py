"""Evaluation: ranks to scores, scores to figures per arm, paired differences, intervals, verdicts, samples.

An error is dropped and counted, never scored; a metric that doesn't apply is null, not 1. Frames:
results (qid, arm, hits array<struct<artefact, score>>, ms, error), scores (qid, arm, top1, rr,
lenient_top1, margin, error).
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import twister
from ..functions.numbers import settled, verdict
from ..functions.text import let, markers
from ..plans import numbered, settle
from ..plans.ranks import at_ranks, middle, nearest
from ..plans.scan import Ranges

HITS = 50
RESAMPLES = 10_000
#: Draws of a replicate that are listed together.
DRAWS = 1000
#: Tasks that share the replicates of an exact interval.
TASKS = 32
#: The quality metrics, in the order in which they are reported.
QUALITY_METRICS = ("citation_recall", "citation_precision", "groundedness", "must_contain")


def collapse(hits: Column, most: int = HITS) -> Column:
    """Distinct artefacts in order of first appearance, each with the score of its first hit."""
    names = lambda h: F.transform(h, lambda x: x["artefact"])
    first = lambda h: F.filter(h, lambda x, i: F.array_position(names(h), x["artefact"]) == i + 1)
    return let(F.slice(hits, 1, most), first)


def score_results(results: DataFrame, questions: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """results with qid's target from questions (qid, target) and links (artefact, linked array) -> scores."""
    joined = results.join(questions.select("qid", "target"), "qid")
    if links is not None:
        joined = joined.join(links.select(F.col("artefact").alias("target"), "linked"), "target", "left")
    else:
        joined = joined.withColumn("linked", F.lit(None).cast("array<string>"))
    r = joined.withColumn("_r", collapse(F.col("hits")))
    fine = F.col("error").isNull()
    place = F.array_position(F.transform("_r", lambda x: x["artefact"]), F.col("target"))
    first = F.get("_r", F.lit(0))["artefact"]
    top1 = F.coalesce(place == 1, F.lit(False))
    lenient = top1 | F.coalesce(F.array_contains("linked", first), F.lit(False))
    margin = F.when(top1 & (F.size("_r") > 1), F.get("_r", F.lit(0))["score"] - F.get("_r", F.lit(1))["score"])
    return r.select("qid", "arm", F.when(fine, top1.cast("int")).alias("top1"), F.when(fine, F.when(place > 0, 1 / place).otherwise(0.0)).alias("rr"), F.when(fine, lenient.cast("int")).alias("lenient_top1"), F.when(fine, margin).alias("margin"), "ms", "error")


def nearest_rank(col: str, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY {col})")


def arm_means(scores: DataFrame, *by: str) -> DataFrame:
    """n, errors and means per arm (and more groups)."""
    return scores.groupBy("arm", *by).agg(F.count("top1").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg("top1").alias("top1"), F.avg("rr").alias("mrr"), F.avg("lenient_top1").alias("lenient_top1"), F.count("margin").alias("margin_n"))


def arm_figures(scores: DataFrame, *by: str) -> DataFrame:
    """n, means, errors, median margin and latency percentiles per arm (and more groups)."""
    keys = ["arm", *by]
    scores = settle(scores)
    means = arm_means(scores, *by)
    lower, upper = middle()
    margin = at_ranks(scores, "margin", {"_lower": lower, "_upper": upper}, keys).select(*keys, ((F.col("_lower") + F.col("_upper")) / 2).alias("median_margin"))
    ms = at_ranks(scores.where("error is null"), "ms", {"p50_ms": nearest(50), "p95_ms": nearest(95)}, keys).drop("n")
    return beside(beside(means, margin, keys), ms, keys).select(*keys, "n", "errors", "top1", "mrr", "lenient_top1", "median_margin", "margin_n", "p50_ms", "p95_ms")


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    r = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(r, same, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def paired(values: DataFrame, x: str, y: str, *, key: list[str], value: str = "value", arm: str = "arm") -> DataFrame:
    """(key..., x, y, delta) of the keys on which both arms have a value: one aggregate, no self-join."""
    of = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    both = values.where(F.col(arm).isin(x, y)).groupBy(*key).agg(of(x).alias("x"), of(y).alias("y"))
    return both.where("x is not null and y is not null").withColumn("delta", F.col("x") - F.col("y"))


def query_deltas(values: DataFrame, x: str, y: str, *, query="id", pass_="pass_index", value="value") -> DataFrame:
    """(query, pairs, delta): passes are averaged per query before arms are compared."""
    return paired(values, x, y, key=[query, pass_], value=value).groupBy(query).agg(F.count("*").alias("pairs"), F.avg("delta").alias("delta"))


def exploratory(scores: DataFrame, skip: list[tuple[str, str]] = ()) -> DataFrame:
    """(x, y, n, difference) for every later arm x and earlier arm y by name, over the questions both scored.

    Arms of a question are gathered, which are few by design; questions are never paired with each other.
    """
    arms = F.sort_array(F.collect_list(F.when(F.col("top1").isNotNull(), F.struct("arm", "top1"))))
    per = scores.groupBy("qid").agg(arms.alias("a"))
    pairs = F.flatten(F.transform("a", lambda y, i: F.transform(F.filter("a", lambda x: x["arm"] > y["arm"]), lambda x: F.struct(x["arm"].alias("x"), y["arm"].alias("y"), (x["top1"] - y["top1"]).alias("d")))))
    out = per.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"), settled(F.avg("p.d")).alias("difference"))
    for a, b in skip:
        out = out.where(~((F.col("x") == a) & (F.col("y") == b)))
    return out


def determinism(first: DataFrame, repeat: DataFrame, limit: int = 3) -> DataFrame:
    """(arm, compared, changed, caveat): how often a second pass put another artefact first. A repeat without its first pass is an error."""
    top = lambda df, name: df.select("arm", "qid", F.struct(F.get(collapse(F.col("hits")), F.lit(0))["artefact"].alias("a"), F.col("error").alias("e")).alias(name))
    both = top(repeat, "again").join(top(first, "once"), ["arm", "qid"], "left")
    both = both.withColumn("once", F.coalesce("once", F.when(F.raise_error(F.concat(F.col("arm"), F.lit(" repeated "), F.col("qid"), F.lit(", which its first pass did not answer"))).isNull(), F.col("again"))))
    fine = F.col("again.e").isNull() & F.col("once.e").isNull()
    out = both.groupBy("arm").agg(F.count_if(fine).alias("compared"), F.count_if(fine & ~F.col("again.a").eqNullSafe(F.col("once.a"))).alias("changed"))
    return out.withColumn("caveat", F.col("changed") > limit)


def bootstrap_exact(deltas: DataFrame, *, by: str = "comparison", order: str = "qid", value: str = "delta", resamples: int = RESAMPLES, seed: int = 20261002, tasks: int = TASKS) -> DataFrame:
    """(by, n, mean, ci_low, ci_high) with the standard library's generator, draw for draw, replicates spread over tasks.

    Every comparison draws from the seed anew. Tasks start at their own replicate: the generator's state
    there is found by a jump (see functions.twister). A task holds the deltas of one comparison, 8 bytes
    each; for comparisons beyond that use bootstrap_hashed. Comparisons are few: their sizes reach the driver.
    """
    spark, kind = deltas.sparkSession, deltas.schema[by].dataType
    packed = deltas.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("d")))), lambda x: x["d"]).alias("d"))
    packed = settle(packed)
    sizes = packed.select("k", F.size("d").alias("n")).collect()
    if not sizes:
        return spark.createDataFrame([], f"{by} {kind.simpleString()}, n long, mean double, ci_low double, ci_high double")
    each = -(-resamples // max(1, min(tasks, resamples)))
    starts = range(0, resamples, each)
    parts = []
    for n in sorted({r.n for r in sizes}):
        parts += [(n, first, min(each, resamples - first), bytearray(s.tobytes())) for first, s in zip(starts, twister.states(seed, 2 * n * each, len(starts)), strict=True)]
    chunks = spark.createDataFrame(parts, "n int, first int, count int, state binary")
    work = packed.join(chunks, F.size("d") == F.col("n")).repartition(len(parts), "k", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in ("k", "d", "count", "state")}
                d = r["d"].values.to_numpy()
                g = twister.generator(np.frombuffer(r["state"].as_py(), dtype=np.uint32))
                means = [math.fsum(d[np.floor(g.random_sample(len(d)) * float(len(d))).astype(np.int64)].tolist()) / len(d) for _ in range(r["count"].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r["k"].as_py()], batch.schema.field("k").type), pa.array([means], pa.list_(pa.float64()))], names=["k", "means"])

    drawn = work.select("k", "d", "count", "state").mapInArrow(run, f"k {kind.simpleString()}, means array<double>")
    ends = drawn.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("means"))).alias("m"))  # as many numbers as there are replicates
    at = lambda p: F.round(F.element_at("m", min(resamples - 1, max(0, math.ceil(p * resamples / 1000) - 1)) + 1), 12) + 0.0
    exact = F.udf(lambda d: round(math.fsum(d) / len(d), 12) + 0.0, "double")
    means = packed.select(F.col("k").alias("_k"), F.size("d").cast("long").alias("n"), exact("d").alias("mean"))
    return means.join(ends, F.col("_k").eqNullSafe(F.col("k"))).select(F.col("_k").alias(by), "n", "mean", at(25).alias("ci_low"), at(975).alias("ci_high"))


def bootstrap_hashed(deltas: DataFrame, *, by: list[str] = (), order: str = "qid", value: str = "delta", resamples: int = 200, seed: int = 7) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high) where draw j of replicate r is a hash of (seed, r, j): the same on any engine.

    The replicates are an aggregate over a grid of replicates and draws that joins the ranked deltas on
    their rank; ranks, grid and join spread over tasks, however many deltas a group has. Spark takes the
    grid for as small as the table of sizes that it grows from: the join names its kind, else the whole
    grid would be sent through the driver, and blocks of draws are dealt to tasks by number.
    """
    deltas = settle(deltas.select(*by, order, F.col(value).cast("double").alias("d")))
    ranked = numbered(deltas, [order], by, "i").select(*by, "i", "d")
    sizes = deltas.groupBy(*by).agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {DRAWS}")))).where("n > 0")
    blocks = blocks.repartition(int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "lo")
    draws = blocks.select(*by, "n", F.explode(F.sequence(F.col("lo") * DRAWS + 1, F.least("n", (F.col("lo") + 1) * DRAWS))).alias("j"))
    grid = draws.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("r"))
    mixed = (F.col("r") * 7919 + F.col("j") * 104729 + seed) * 48271 % 2147483647
    drawn = grid.withColumn("i", mixed * 48271 % 2147483647 % F.col("n") + 1).join(ranked.hint("shuffle_hash"), [*by, "i"])
    means = drawn.groupBy(*by, "r").agg((F.sum("d") / F.max("n")).alias("m"))
    ends = means.groupBy(*by).agg(settled(nearest_rank("m", 0.025)).alias("ci_low"), settled(nearest_rank("m", 0.975)).alias("ci_high"))
    figures = deltas.groupBy(*by).agg(F.count("*").alias("n"), settled(F.avg("d")).alias("mean"))
    return figures.join(ends, list(by), "left") if by else figures.crossJoin(F.broadcast(ends))


def with_verdict(intervals: DataFrame, threshold: float = 0.10) -> DataFrame:
    return intervals.withColumn("verdict", verdict(F.col("mean"), F.col("ci_low"), F.col("ci_high"), threshold))


def largest_remainder(counts: DataFrame, seats: int, *, name="name", count="n") -> DataFrame:
    """(name, n, seats): whole shares first, then one each to the largest remainders, names deciding ties.

    One row per category, so these windows are small.
    """
    every = Window.partitionBy()
    out = counts.select(F.col(name), F.col(count).cast("long").alias("n")).withColumn("_t", F.sum("n").over(every))
    out = out.withColumn("_f", F.expr(f"{seats} * n div _t")).withColumn("_m", seats * F.col("n") % F.col("_t"))
    place = F.row_number().over(Window.orderBy(F.desc("_m"), name))
    left = F.lit(seats) - F.sum("_f").over(every)
    return out.withColumn("seats", F.col("_f") + (place <= left).cast("long")).drop("_t", "_f", "_m")


def first_per_category(rows: DataFrame, n: int, *, category: str, order: list) -> DataFrame:
    """The first n rows of each category."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def seeded_order(keys: list[str], seed: int) -> list[str]:
    """Keys in sorted order, then shuffled by the standard library's generator; for lists of report size."""
    out = sorted(keys)
    random.Random(seed).shuffle(out)
    return out


def scalable_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a place in (0, 1) that depends on seed and key only: order by it for a shuffle of any size."""
    return rows.withColumn("place", (F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).cast("double"))


def rotate_arms(runs: DataFrame, arms: int, *, position="position", pass_="pass_index") -> DataFrame:
    """Each pass starts one arm later."""
    return runs.withColumn("slot", F.pmod(F.col(position) - F.col(pass_), F.lit(arms)))


def assemble(chunks: DataFrame, most_tokens: int = 1500, *, key="artefact", order="chunk_index", tokens="token_count", text="content") -> DataFrame:
    """(key, text, token_count): whole chunks in order until one would go over; a first chunk that does is cut in proportion."""
    cut = Ranges(chunks.select(key, order, tokens, text), [key], [order])
    run = cut.summed(cut.rows, tokens, "_so_far").withColumn("_past", (F.col("_so_far") > most_tokens).cast("int"))
    run = cut.lagged(cut.largest(run, "_past", "_over"), F.lit(1), "_before")
    shown = F.when(F.col("_over") == 0, F.col(text)).when(F.col("_before").isNull(), F.left(text, (F.length(text) * most_tokens / F.col(tokens)).cast("int")))
    # Only what is shown is gathered, which the tokens bound.
    parts = run.groupBy(key).agg(F.sort_array(F.collect_list(F.when(shown.isNotNull(), F.struct(F.col(order).alias("o"), shown.alias("t"))))).alias("p"), F.sum(tokens).alias("token_count"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), "token_count")


def gate(results: DataFrame, questions: DataFrame, *, arm: str = "S2", least: int = 120, links: DataFrame | None = None) -> DataFrame:
    """One row: expected, evaluated, correct, errors, missing, skipped, passed. Every question needs one answer of the arm without error."""
    counts = results.groupBy("qid").agg(F.count("*").alias("answers"))
    scored = score_results(results.where(F.col("arm") == arm), questions, links).groupBy("qid").agg(F.max("top1").alias("top1"), F.max("error").alias("error"), F.count("*").alias("own"))
    per = questions.select("qid").join(counts, "qid", "left").join(scored, "qid", "left")
    why = F.when(F.col("answers").isNull(), "missing").when(F.col("answers") > 1, "duplicate").when(F.col("own").isNull(), "arm").otherwise(F.col("error"))
    cases = per.withColumn("why", why)
    unknown = results.join(questions.select("qid"), "qid", "left_anti").agg(F.count("*").alias("unknown"))
    out = cases.agg(F.count("*").alias("expected"), F.count_if(F.col("why").isNull()).alias("evaluated"), F.coalesce(F.sum(F.when(F.col("why").isNull(), F.col("top1"))), F.lit(0)).cast("long").alias("correct"), F.count_if(F.col("why") == "missing").alias("missing"), F.count_if(F.col("why") == "skipped").alias("skipped"), F.count_if(F.col("why").isNotNull() & ~F.col("why").isin("missing", "skipped")).alias("_e"))
    out = out.crossJoin(F.broadcast(unknown)).withColumn("errors", F.col("_e") + F.col("unknown")).drop("_e", "unknown")
    ok = (F.col("evaluated") == F.col("expected")) & (F.col("errors") + F.col("missing") + F.col("skipped") == 0) & (F.col("correct") >= least)
    return out.withColumn("passed", ok)


def cost_per_1000(results: DataFrame, rates: DataFrame, *, not_sent: str = "no query vector", search_arms=("S2", "S3")) -> DataFrame:
    """(arm, cost_per_1000): tokens at a million's rate plus a fee per request, over questions asked, or searches sent for search arms.

    rates: (arm, per_million_tokens, per_request)."""
    asked = results.where(~(F.col("arm").isin(*search_arms) & F.col("error").eqNullSafe(F.lit(not_sent))))
    own = asked.groupBy("arm").agg(F.count("*").alias("n"), F.sum("query_tokens").alias("t")).join(rates, "arm", "left")
    total = F.col("t") * F.coalesce("per_million_tokens", F.lit(0.0)) / 1_000_000 + F.col("n") * F.coalesce("per_request", F.lit(0.0))
    return own.select("arm", (1000 * total / F.col("n")).alias("cost_per_1000"))


def metric_scope(metric: str) -> Column:
    """Whether a question has a metric: citations for what can be answered, required words where there are any."""
    if metric in ("citation_recall", "citation_precision"):
        return F.col("category") != "unanswerable"
    if metric == "must_contain":
        return F.size("must_contain") > 0
    if metric == "groundedness":
        return F.lit(True)
    raise ValueError(f"unknown quality metric {metric!r}")


def metric_value(metric: str) -> Column:
    """An outcome's value on a quality metric; null where it doesn't apply or the answer failed."""
    value = F.col("must_contain_satisfied").cast("double") if metric == "must_contain" else F.col(metric).cast("double")
    return F.when(F.col("error").isNull() & metric_scope(metric), value)


def compare_metrics(outcomes: DataFrame, questions: DataFrame, x: str, y: str, passes: int, *, query="id", pass_="pass_index", threshold: float = 0.10, resamples: int = 200) -> DataFrame:
    """Arm x against y on every quality metric: metric, nominal_k, nominal_pairs, k, pairs, mean_delta, ci_low, ci_high, verdict.

    questions (query, category, must_contain) give the nominal size of a metric. One without a pair of
    values has k = 0, no mean and interval, and the verdict "no data".
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), metric_value(m).alias("value")) for m in QUALITY_METRICS])).alias("v")
    long = outcomes.select(F.col(query).alias("q"), F.col(pass_).alias("p"), "arm", values).select("q", "p", "arm", "v.*")
    deltas = paired(long, x, y, key=["metric", "q", "p"]).groupBy("metric", "q").agg(F.count("*").alias("pairs"), F.avg("delta").alias("delta"))
    deltas = settle(deltas)
    intervals = bootstrap_hashed(deltas, by=["metric"], order="q", resamples=resamples).withColumnRenamed("n", "k").withColumnRenamed("mean", "mean_delta")
    pairs = deltas.groupBy("metric").agg(F.sum("pairs").cast("long").alias("pairs"))
    nominal = questions.agg(*[F.count_if(metric_scope(m)).alias(m) for m in QUALITY_METRICS])
    listed = nominal.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("nominal_k")) for m in QUALITY_METRICS])).alias("m")).select("m.*")
    out = listed.join(intervals, "metric", "left").join(pairs, "metric", "left")
    said = F.when(F.col("k").isNull(), "no data").otherwise(verdict(F.col("mean_delta"), F.col("ci_low"), F.col("ci_high"), threshold))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("metric", "nominal_k", (F.col("nominal_k") * passes).alias("nominal_pairs"), zero("k"), zero("pairs"), "mean_delta", "ci_low", "ci_high", said.alias("verdict"))


def summarise(outcomes: DataFrame) -> DataFrame:
    """The figures of every arm in one aggregate: counts, scoped means with their n, latency, costs, models seen."""
    fine = F.col("error").isNull()
    un = fine & (F.col("category") == "unanswerable")
    metrics = ("citation_recall", "citation_precision", "groundedness", "must_contain")
    seen = F.when(fine & F.col("filtered_stage").isNull(), F.col("model"))
    outcomes = settle(outcomes)
    figures = outcomes.groupBy("arm").agg(
        F.count("*").alias("outcome_count"), F.count_if(~fine).alias("error_count"), F.count_if("no_reply").alias("no_reply_count"), F.count_if(F.col("filtered_stage").isNotNull()).alias("filtered_count"),
        *[F.avg(metric_value(m)).alias(f"mean_{m}") for m in metrics], *[F.count(metric_value(m)).alias(f"{m}_count") for m in metrics],
        F.count_if(fine & F.col("groundedness").isNull() & F.col("groundedness_reason").isNotNull()).alias("judge_failure_count"),
        F.count_if(un & F.col("unanswerable_handled")).alias("unanswerable_handled"), F.count_if(un).alias("unanswerable_total"),
        F.avg(F.when(fine, F.col("cost_usd"))).alias("mean_cost_usd_per_query"), F.sum("cost_usd").alias("total_cost_usd"), F.sort_array(F.collect_set(seen)).alias("models_seen"),
    )
    latency = at_ranks(outcomes.where(fine), "latency_ms", {"p50_latency_ms": nearest(50), "p95_latency_ms": nearest(95)}, ["arm"]).drop("n")
    return beside(figures, latency, ["arm"])


def admissible(outcomes: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Outcomes with an error where an answer came from another provider than its arm's, or was degraded. Filtered answers name none."""
    names = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    right = F.col("providers") == F.array(names[F.col("arm")])
    why = F.when(F.col("degraded"), "degraded").when(F.col("filtered_stage").isNull() & ~F.coalesce(right, F.lit(False)), "answered by another provider")
    return outcomes.withColumn("error", F.coalesce("error", why))


def judge_score(reply: Column) -> Column:
    """The score in a judge's JSON reply; null unless it is a finite number from 0 to 1."""
    x = F.get_json_object(reply, "$.score").try_cast("double")
    return F.when(x.between(0.0, 1.0), x)


def audit(kept: DataFrame, sheet: DataFrame, least: int = 200) -> DataFrame:
    """One row (kept, unlisted, unjudged, sound): every question is on the sheet and none else, and enough are kept."""
    listed = kept.select("qid").distinct().withColumn("_k", F.lit(1)).join(sheet.select("qid").distinct().withColumn("_s", F.lit(1)), "qid", "full")
    out = listed.agg(F.count("_k").alias("kept"), F.count_if(F.col("_s").isNull()).alias("unlisted"), F.count_if(F.col("_k").isNull()).alias("unjudged"))
    return out.withColumn("sound", (F.col("unlisted") + F.col("unjudged") == 0) & (F.col("kept") >= least))


def audit_by_type(questions: DataFrame, marks: DataFrame, last: DataFrame) -> DataFrame:
    """(entity_type, questions, kept, unmarked, repeated, invalid, disagreeing) for every type of a set, kept or not.

    questions (qid, entity_type); marks (qid, mark) of the audit; last (qid, mark) of the spot check that
    the audit extends and must agree with. A question is kept if its one mark is "fine".
    """
    per = marks.groupBy("qid").agg(F.count("*").alias("n"), F.max("mark").alias("mark"))
    agreed = last.select("qid", F.col("mark").alias("last"))
    joined = questions.select("qid", "entity_type").join(per, "qid", "left").join(agreed, "qid", "left")
    return joined.groupBy("entity_type").agg(
        F.count("*").alias("questions"), F.count_if((F.col("mark") == "fine") & (F.col("n") == 1)).alias("kept"), F.count_if(F.col("n").isNull()).alias("unmarked"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("mark").isin("fine", "not fine")).alias("invalid"), F.count_if(F.col("mark") != F.col("last")).alias("disagreeing"),
    )


def spot_check(marks: dict[str, str], qids: list[str], *, size: int, seed: int, round_: int, most_bad: int = 3) -> dict:
    """Which questions a round samples, and whether their marks pass; marks of other questions, or missing ones, are errors."""
    sample = random.Random(seed + round_).sample(sorted(qids), min(size, len(qids)))
    if set(marks) != set(sample) or not set(marks.values()) <= {"fine", "not fine"}:
        raise ValueError("the marks are not those of the sample")
    bad = sum(m == "not fine" for m in marks.values())
    return {"fine": len(sample) - bad, "not_fine": bad, "passes": bad <= most_bad}


def rejection_counts(checked: DataFrame, reasons: str = "reasons") -> DataFrame:
    return checked.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def question_faults(question: Column, copied: Column, leaks: Column, *, most_copied: float = 0.5, words: tuple[int, int] = (6, 40)) -> Column:
    """Why a question is rejected, as an array; empty where it passes."""
    n = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return F.array_compact(F.array(F.when(copied > most_copied, F.lit("copies its target")), F.when(leaks, F.lit("contains the target's key")), F.when(n < words[0], F.lit("too short")), F.when(n > words[1], F.lit("too long"))))


def same_order(a: DataFrame, b: DataFrame, *, key: str, items: str, most: int = 5) -> DataFrame:
    """(key, same): whether the first few items of two result lists are the same, in order; a missing list is not."""
    both = a.select(key, F.slice(items, 1, most).alias("_a")).join(b.select(key, F.slice(items, 1, most).alias("_b")), key, "full")
    return both.select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def foreign_hits(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits (qid, arm, chunk_id, artefact) that the corpus lacks or files under another artefact."""
    hits = results.select("qid", "arm", F.explode("hits").alias("h")).select("qid", "arm", "h.chunk_id", "h.artefact")
    return hits.join(corpus.select("chunk_id", "artefact").distinct(), ["chunk_id", "artefact"], "left_anti")


def resolve_markers(answers: DataFrame, evidence: DataFrame, *, key: list[str]) -> DataFrame:
    """(key..., marker, artefact): the evidence that each citation marker names, by its place from 1; others are left out."""
    cited = answers.select(*key, F.explode(F.array_distinct(F.transform(markers(F.col("answer")), lambda m: m.try_cast("int")))).alias("marker"))
    return cited.join(evidence.select(*key, F.col("position").alias("marker"), "artefact"), [*key, "marker"])
