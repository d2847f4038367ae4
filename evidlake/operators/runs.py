"""Checks of a run's files before they are scored, and the drawing of its questions.

Faults are rows, so that a run of any size is checked by joins; `refuse` turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import routine_bump
from ..plans import settle
from ..plans.scan import Ranges
from . import evaluation

LEAST_TOKENS = 40


def incomplete(results: DataFrame, questions: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, qid, fault): what keeps a run from being analysed. Every arm answers every question once, and no other."""
    wanted = questions.select("qid").distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    counted = results.groupBy("arm", "qid").agg(F.count("*").alias("n"))
    both = wanted.withColumn("_w", F.lit(True)).join(counted, ["arm", "qid"], "full")
    fault = F.when(F.col("_w").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("arm", "qid", fault.alias("fault")).where("fault is not null")


def worker_faults(rows: DataFrame, arm: str, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(fault, qid): why a worker's output is not one arm's answer to the frozen questions, in order, over this corpus.

    rows (place, qid, arm, hits array<struct<chunk_id, artefact>>, error); questions (place, qid); corpus
    (chunk_id, artefact). Faults: "arm", "order", "hit", and "all errors", once, with a null qid.
    """
    arms = rows.where(~F.col("arm").eqNullSafe(F.lit(arm))).select(F.lit("arm").alias("fault"), "qid")
    paired = rows.select("place", "qid").join(questions.select("place", F.col("qid").alias("wanted")), "place", "full")
    order = paired.where(~F.col("qid").eqNullSafe(F.col("wanted"))).select(F.lit("order").alias("fault"), F.coalesce("qid", "wanted").alias("qid"))
    hits = rows.select("qid", F.explode("hits").alias("h")).select("qid", "h.chunk_id", "h.artefact")
    foreign = hits.join(corpus.select("chunk_id", "artefact").distinct(), ["chunk_id", "artefact"], "left_anti").select(F.lit("hit").alias("fault"), "qid").distinct()
    none = rows.agg(F.count("*").alias("n"), F.count("error").alias("e")).where("n > 0 and n = e").select(F.lit("all errors").alias("fault"), F.lit(None).cast(rows.schema["qid"].dataType).alias("qid"))
    return arms.unionByName(order).unionByName(foreign).unionByName(none)


def refuse(faults: DataFrame, what: str, most: int = 5) -> None:
    """An error that names the first few faults, if there are any."""
    found = faults.limit(most).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))


def with_vectors(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Questions with the vector that another arm made for them, by qid; one without has an error instead."""
    v = vectors.select("qid", "vector")
    return questions.join(v, "qid", "left").withColumn("error", F.when(F.col("vector").isNull(), "no query vector"))


def digest_order(key: Column, seed: int) -> Column:
    """A shuffle by seed that any engine repeats."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def draw(candidates: DataFrame, quotas: dict[str, int], seed: int, *, least_tokens: int = LEAST_TOKENS, skip: Column | None = None) -> DataFrame:
    """(entity_type, artefact, place): of each type its quota of artefacts, in a seeded order, each at most once.

    candidates (entity_type, artefact, token_count, text). Those below the floor of tokens and routine
    bumps are passed over. A type that runs dry is an error; none is borrowed from another.
    """
    routine = routine_bump(F.col("entity_type"), F.col("text")) if skip is None else skip
    fit = candidates.where((F.col("token_count") >= least_tokens) & ~F.coalesce(routine, F.lit(False))).select("entity_type", "artefact").distinct()
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col("entity_type")]
    w = Window.partitionBy("entity_type").orderBy("_o", "artefact")
    most = max(quotas.values(), default=0)  # a bound that is a literal, so that each task sends so many rows of a type at most
    placed = fit.withColumn("_o", digest_order(F.col("artefact"), seed)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    drawn = placed.where(F.col("place") <= quota).drop("_o")
    wanted = candidates.sparkSession.createDataFrame(list(quotas.items()) or [("", 0)], "entity_type string, quota int")
    dry = drawn.groupBy("entity_type").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "entity_type", "right").where(F.coalesce("n", F.lit(0)) < F.col("quota")).select("entity_type").collect()
    if dry:
        raise LookupError("no artefact is left to draw of " + ", ".join(sorted(r.entity_type for r in dry)))
    return drawn.select("entity_type", "artefact", "place")


def schedule(quotas: dict[str, int], seed: int) -> list[str]:
    """The order in which types are drawn: each as often as its quota, shuffled by the standard library's generator."""
    import random

    out = [t for t, n in quotas.items() for _ in range(n)]
    random.Random(seed).shuffle(out)
    return out


def cost_faults(calls: DataFrame, recorded: str = "recorded_usd", computed: str = "cost_usd", places: int = 6) -> DataFrame:
    """Calls whose recorded cost isn't the one recomputed from their tokens, to so many places; a cost that is missing on one side is a fault."""
    same = F.round(F.col(recorded).cast("decimal(18,9)"), places).eqNullSafe(F.round(F.col(computed).cast("decimal(18,9)"), places))
    return calls.where(~same)


def overlaps(intervals: DataFrame, *, key: list[str], start: str, end: str) -> DataFrame:
    """(key..., intervals, overlapping, monotone): how many intervals begin before an earlier one ended, and whether ends rise too."""
    cut = Ranges(intervals.select(*key, start, end), key, [start, end])
    rows = cut.largest(cut.rows, end, "_seen", before=True)
    over, back = (F.coalesce(F.col(c) < F.col("_seen"), F.lit(False)) for c in (start, end))
    return rows.groupBy(*key).agg(F.count("*").alias("intervals"), F.count_if(over).alias("overlapping"), (F.count_if(back) == 0).alias("monotone"))


def study(results: DataFrame, questions: DataFrame, arms: list[str], comparisons: list[tuple[str, str]], *, links: DataFrame | None = None, threshold: float = 0.05, **draws) -> DataFrame:
    """(section, name, metric, value, note): all that a run shows, as one table; an incomplete run is refused.

    Sections: "arm" (figures of each arm), "type" (the same per entity type, named arm/type), "comparison" (the
    paired difference of the first places, its interval and, as a note, its verdict) for the declared pairs,
    and "exploratory" (differences of the other pairs, without interval). questions (qid, target, entity_type).
    """
    refuse(incomplete(results, questions, arms), "the run is not complete")
    scores = settle(evaluation.score_results(results, questions, links).join(questions.select("qid", "entity_type"), "qid"))

    def stacked(df: DataFrame, section: str, name: Column, metrics: list[str], note: Column | None = None) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        note = F.lit(None).cast("string") if note is None else note
        return df.select(F.lit(section).alias("section"), name.alias("name"), note.alias("note"), F.explode(each).alias("m")).select("section", "name", "m.metric", "m.value", "note")

    means = ["n", "errors", "top1", "mrr", "lenient_top1"]
    out = stacked(evaluation.arm_figures(scores), "arm", F.col("arm"), [*means, "median_margin", "p50_ms", "p95_ms"])
    out = out.unionByName(stacked(evaluation.arm_means(scores, "entity_type"), "type", F.concat_ws("/", "arm", "entity_type"), means))
    first = scores.select("qid", "arm", F.col("top1").cast("double").alias("value"))
    deltas = None
    for x, y in comparisons:
        one = evaluation.paired(first, x, y, key=["qid"]).select("qid", "delta", F.lit(f"{x}-{y}").alias("comparison"))
        deltas = one if deltas is None else deltas.unionByName(one)
    if deltas is not None:
        judged = evaluation.with_verdict(evaluation.bootstrap_exact(deltas, **draws), threshold)
        out = out.unionByName(stacked(judged, "comparison", F.col("comparison"), ["n", "mean", "ci_low", "ci_high"], F.col("verdict")))
    others = evaluation.exploratory(scores, comparisons)
    return out.unionByName(stacked(others, "exploratory", F.concat_ws("-", "x", "y"), ["n", "difference"]))
