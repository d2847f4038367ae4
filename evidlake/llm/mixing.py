"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source gets a share of all words by its weight, capped at `max_epochs` times its own size, with
the excess reshared. A source's target is met by complete epochs first; the rest is a weighted
sample without replacement: documents in order of exponential keys -ln(u) / weight, taken while
their running size (to the middle of a document) stays within what is left.

That running size only grows, so what is taken is all that comes before one place in the order. Keys
are cut into KEY_BUCKETS ranges, whose sums tell in which range of a source the place lies; only that
range's documents are summed one by one. The places, one row per source, then go to the documents:
these stay where they are, and no source is gathered in one task.

Edge cases: a null or wordless text has size 0 and takes 0; a null source is a source of its own,
last in order; a null id is the empty string in the hash; documents with equal keys go by id, then by
size, and rows that agree in all of these are counted as one group, of which as many are taken as fit;
rows that repeat count separately; a source without words has target 0; very long texts count whole, and
one of them can make a source miss its target by half its size; an empty table gives an empty result;
other columns, whatever their names, are ignored by `mix` and returned unchanged by `mixed`. Sources
are compared in one task, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_WORD, few, picked, plain, settle, stored

KEY_BUCKETS = 4096
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of a digest of the key: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(per_source: DataFrame, weights=SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: shares by weight of all words, none above its cap.

    Filling in order of cap / weight, a source is capped when the even level of what is left reaches
    its cap; the others split the rest. One row per source, so these windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), place + 1)
    ranked = per_source.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dec = lambda c: c.cast("decimal(19,0)")
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("fits", dec(F.col("cap")) * dec(F.col("w_left")) <= dec(F.col("w")) * dec(F.col("total") - F.col("spent")))
        .withColumn("capped", F.min("fits").over(upto))
    )
    free = F.when(~F.col("capped"), F.col("w")).otherwise(0)
    used = F.when(F.col("capped"), F.col("cap")).otherwise(0)
    rest = (F.col("w") * (F.col("total") - F.sum(used).over(whole))).cast("double") / F.sum(free).over(whole)
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def _keyed(rows: DataFrame, id_col: str, text_col: str, source_col: str, quality: DataFrame | None, seed: int) -> DataFrame:
    """Adds doc_id, source, size, _key and _range, the key's place in equal shares of all keys."""
    out = rows.withColumns({"doc_id": F.col(id_col), "source": F.col(source_col), "size": sizes(F.col(text_col))})
    weight = F.lit(1.0)
    if quality is not None:
        q = few(settle(quality.select(F.col("doc_id").alias("_q_id"), F.col("weight").cast("double").alias("_q_w"))))
        out, weight = out.join(q, out.doc_id == F.col("_q_id"), "left"), F.coalesce("_q_w", F.lit(1.0))
    out = out.withColumn("_key", -F.log(uniform(F.col("doc_id"), seed)) / weight)
    return out.withColumn("_range", F.least(F.lit(KEY_BUCKETS - 1), F.floor((1 - F.exp(-F.col("_key"))) * KEY_BUCKETS)).cast("int"))


def _places(base: DataFrame, weights, max_epochs: int) -> DataFrame:
    """One row per source: sizes, target, complete epochs, and the place up to which one more copy is taken.

    _at is the range that the place lies in (none, if nothing more is taken), _cut the first group of
    equal rows there that isn't taken whole (none, if all of the range is), of which _cut.m rows are.
    """
    ranges = base.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "_s")
    running = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
    planned = offsets.join(targets, F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    planned = planned.withColumn("_epochs", epochs)
    twice_left = F.when(F.col("_epochs") < max_epochs, F.floor(2 * (F.col("target") - F.col("_epochs") * F.col("source_size")))).otherwise(-1).cast("long")
    planned = planned.withColumn("_left", twice_left)
    holds = (2 * F.col("_before") <= F.col("_left")) & (F.col("_left") < 2 * (F.col("_before") + F.col("_sum")))
    place = F.max(F.when(holds, F.struct("_range", "_before"))).alias("_p")
    bounds = planned.groupBy("_s").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "_epochs", "_left")], place)
    bounds = settle(bounds.select("_s", "source_size", "target", "_epochs", "_left", F.col("_p._range").alias("_at"), F.col("_p._before").alias("_before")))

    near = base.join(few(bounds.where("_at is not null")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_at"))).where("size > 0")
    groups = near.groupBy("source", "_key", "doc_id", "size").agg(F.count("*").alias("n"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
    upto = Window.partitionBy("source").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(upto), F.lit(0))
    room = F.col("_left") - 2 * F.col("_start") - F.col("size")
    fit = F.when(room < 0, F.lit(0)).otherwise(F.least(F.col("n"), F.floor(room / (2 * F.col("size"))) + 1)).cast("long")
    groups = groups.withColumn("_start", start).withColumn("m", fit)
    cut = groups.where("m < n").groupBy("source").agg(F.min(F.struct("_key", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size", "m")).alias("_cut"))
    cut = cut.withColumnRenamed("source", "_c")
    return settle(bounds.join(cut, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c", "_left", "_before"))


def _with_copies(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to keyed rows."""
    rows = rows.join(few(places), F.col("source").eqNullSafe(F.col("_s")))
    key, here, cut = F.col("_key"), F.col("_range") == F.col("_at"), lambda c: F.col(f"_cut.{c}")
    same_id = F.col("doc_id").eqNullSafe(cut("doc_id"))
    id_before = F.coalesce(F.col("doc_id") < cut("doc_id"), F.col("doc_id").isNull() & cut("known"))
    before = (key < cut("_key")) | ((key == cut("_key")) & (id_before | (same_id & (F.col("size") < cut("size")))))
    taken = F.when(F.col("_range") < F.col("_at"), True).when(here, F.col("_cut").isNull() | before).otherwise(False)
    at_cut = F.coalesce(here & (key == cut("_key")) & same_id & (F.col("size") == cut("size")) & (cut("m") > 0), F.lit(False))
    copies = lambda more: F.when(F.col("size") > 0, F.col("_epochs") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    if not places.where("_cut.m > 0").limit(1).count():
        return rows.withColumn("copies", copies(taken))
    # Equal rows of which some are taken: they are written by themselves and numbered in the order of their parts.
    ties = stored(rows.where(at_cut), "ties").withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()})
    sums = Window.partitionBy("_ts").orderBy("_tp").rowsBetween(Window.unboundedPreceding, -1)
    parts = ties.groupBy(F.col("source").alias("_ts"), F.col("_part").alias("_tp")).agg(F.count("*").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(sums), F.lit(0))).drop("_c")
    number = F.row_number().over(Window.partitionBy("source", "_part").orderBy("_n"))
    ties = ties.withColumn("_i", number).join(parts, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("_part") == F.col("_tp")))
    some = ties.withColumn("copies", copies(F.col("_i") + F.col("_off") <= cut("m"))).drop("_part", "_n", "_ts", "_tp", "_i", "_off")
    return rows.where(~at_cut).withColumn("copies", copies(taken)).unionByName(some)


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", quality: DataFrame | None = None, weights=SOURCE_WEIGHTS, max_epochs=MAX_EPOCHS, seed=17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    quality: (doc_id, weight double > 0), at most one row per id; documents without one weigh 1.
    """
    rows, name = plain(docs)
    base = settle(_keyed(rows, name(id_col), name(text_col), name(source_col), quality, seed).select("doc_id", "source", "size", "_key", "_range"))
    out = _with_copies(base, _places(base, weights, max_epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for bad; several labels of an id count as the best."""
    best = picked(labels, doc_id="doc_id", quality="quality").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight"))


def mixed(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", quality: DataFrame | None = None, weights=SOURCE_WEIGHTS, max_epochs=MAX_EPOCHS, seed=17) -> DataFrame:
    """The mix itself, all columns of the documents: each row as often as it is taken, rows taken never left out.

    Documents are read twice, for their sizes and for the result, and joined with one row per source;
    beyond a bounded number of weights, those are joined by shuffle.
    """
    rows, name = plain(docs)
    keyed = _keyed(rows, name(id_col), name(text_col), name(source_col), quality, seed)
    base = settle(keyed.select("doc_id", "source", "size", "_key", "_range"))
    whole = _with_copies(keyed, _places(base, weights, max_epochs)).where("copies > 0")
    return whole.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*rows.columns).toDF(*docs.columns)
