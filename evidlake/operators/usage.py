"""Usage, cost, budgets, verdicts and ordered-sample checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import Ranges


def totals_by_label(rows: DataFrame, labels: DataFrame, *, key="caller", value="total", other="other") -> DataFrame:
    """(label, total): keys without a label count under `other`; sums are rounded last."""
    named = rows.join(labels.select(F.col(key).alias("_k"), "label"), rows[key] == F.col("_k"), "left")
    return named.groupBy(F.coalesce("label", F.lit(other)).alias("label")).agg(F.round(F.sum(value)).cast("long").alias("total"))


def reconcile(client: DataFrame, metric: DataFrame, *, key="label", tolerance: float = 0.02) -> DataFrame:
    """(key, client, metric, within): both sides must exist, and differ by at most the tolerance of the client's."""
    both = client.select(key, F.col("total").alias("client")).join(metric.select(key, F.col("total").alias("metric")), key, "full")
    near = F.abs(F.col("metric") - F.col("client")) <= tolerance * F.col("client")
    return both.withColumn("within", F.coalesce(near, F.lit(False)))


def daily_budget(usage: DataFrame, budget: int | Column, *, tenant="tenant_id", day="usage_date", tokens="tokens") -> DataFrame:
    """(tenant, day, used, within_budget)."""
    return usage.groupBy(tenant, day).agg(F.sum(tokens).cast("long").alias("used")).withColumn("within_budget", F.col("used") < budget)


def running_budget(usage: DataFrame, budget: int, *, key: list[str], order: list[str], tokens="tokens") -> DataFrame:
    """Each request with what was used before it, and whether it was let through: the check comes before the spending."""
    cut = Ranges(usage, key, order)
    out = cut.summed(cut.rows, tokens, "used_before", before=True).withColumn("used_before", F.col("used_before").cast("long"))
    return out.withColumn("allowed", F.col("used_before") < budget).select(*usage.columns, "used_before", "allowed")


def call_cost(calls: DataFrame, rates: DataFrame, *, on: list[str], at: str) -> DataFrame:
    """Calls with cost_usd by the rate valid at their day; a call without a rate has none.

    rates: (on..., valid_from, valid_to or null, input, cached, cache_write, output per million, decimal).
    Rates are few and joined by key; the interval is a filter on the pairs of a key.
    """
    r = rates.select(*[F.col(c).alias(f"_{c}") for c in on], "valid_from", "valid_to", F.col("input").alias("_in"), F.col("cached").alias("_ca"), F.col("cache_write").alias("_cw"), F.col("output").alias("_out"))
    day = F.to_date(at)
    match = (day >= F.col("valid_from")) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))
    for c in on:
        match = match & (calls[c] == F.col(f"_{c}"))
    joined = calls.join(r, match, "left")
    dec = lambda c: F.col(c).cast("decimal(18,0)")
    total = dec("tokens_in") * F.col("_in") + dec("tokens_out") * F.col("_out") + dec("cache_read") * F.col("_ca") + dec("cache_created") * F.col("_cw")
    return joined.select(*[calls[c] for c in calls.columns], (total / F.lit(1_000_000)).cast("decimal(18,9)").alias("cost_usd"))


def failover(runs: DataFrame, *, least_failures: int = 14, least_successes: int = 43) -> DataFrame:
    """One row of counts and the outcome of a run before and a run after (phase, status, region)."""
    before, after, ok = F.col("phase") == "before", F.col("phase") == "after", F.col("status").eqNullSafe(F.lit(200))
    out = runs.agg(F.count_if(before).alias("before_total"), F.count_if(before & ~ok).alias("before_failures"), F.count_if(after).alias("after_total"), F.count_if(after & ok).alias("after_successes"), F.count_if(after & ok & (F.col("region") == "secondary")).alias("after_secondary"))
    held = (F.col("after_successes") >= least_successes) & (F.col("after_secondary") >= 1)
    return out.withColumn("outcome", F.when(F.col("before_failures") < least_failures, "inconclusive").when(held, "held").otherwise("did not hold"))


def streaks(rows: DataFrame, *, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key..., value, first, last, length): runs of equal neighbours by order; nulls end a run and make none."""
    cut = Ranges(rows, key, order)
    marked = cut.lagged(cut.rows, F.col(value), "_before")
    marked = marked.withColumn("_new", (F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).cast("int"))
    runs = cut.summed(marked, "_new", "_run")
    return runs.where(F.col(value).isNotNull()).groupBy(*key, "_run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("_run")


def gaps(rows: DataFrame, *, key: list[str], at: str, least_seconds: float) -> DataFrame:
    """(key..., samples, least_gap, spaced): the smallest gap between ordered samples, in seconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cut = Ranges(rows.select(*key, at), key, [at])
    g = cut.lagged(cut.rows, F.col(at), "_before").withColumn("_g", (micros(at) - micros("_before.v")) / 1e6)
    return g.groupBy(*key).agg(F.count("*").alias("samples"), F.min("_g").alias("least_gap")).withColumn("spaced", F.coalesce(F.col("least_gap") >= least_seconds, F.lit(True)))


def running_max(rows: DataFrame, *, key: list[str], order: list[str], value: str) -> DataFrame:
    """A cursor that never goes back: the largest value so far."""
    cut = Ranges(rows, key, order)
    return cut.largest(cut.rows, value, "cursor").select(*rows.columns, "cursor")


def seen_within(uploads: DataFrame, observed: DataFrame, seconds: int, *, key: str, at: str = "ts", seen: str = "ts") -> DataFrame:
    """Uploads with the first observation of their key within so many seconds, and whether there is one.

    An interval join: rows meet on the key and a time bucket of that length (each upload looks into two),
    so a busy key is spread over buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    u = uploads.withColumn("_id", F.monotonically_increasing_id())
    probes = u.select("_id", F.col(key).alias("_k"), F.col(at).alias("_at"), F.explode(F.array(bucket(at), bucket(at) + 1)).alias("_b"))
    o = observed.select(F.col(key).alias("_k"), F.col(seen).alias("_s"), bucket(seen).alias("_b"))
    limit = F.col("_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    first = probes.join(o, ["_k", "_b"]).where((F.col("_s") >= F.col("_at")) & (F.col("_s") <= limit)).groupBy("_id").agg(F.min("_s").alias("first_seen"))
    return u.join(first, "_id", "left").drop("_id").withColumn("in_time", F.col("first_seen").isNotNull())


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, equal): rows left when equal ones cancel, counted with repeats."""
    side = lambda df, n: df.withColumn("_n", F.lit(n))
    net = side(a, 1).unionByName(side(b, -1)).groupBy(*a.columns).agg(F.sum("_n").alias("n"))
    out = net.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("only_a"), F.coalesce(-F.sum(F.when(F.col("n") < 0, F.col("n"))), F.lit(0)).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def exact_cover(replies: DataFrame, *, key: list[str], index: str) -> DataFrame:
    """(key..., n, exact): whether the indexes are 0 to n - 1, each once."""
    out = replies.groupBy(*key).agg(F.count("*").alias("n"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.count_distinct(index).alias("_d"))
    return out.withColumn("exact", (F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n"))).drop("_lo", "_hi", "_d")


def conjunction(checks: DataFrame, *, key: list[str], passed: str) -> DataFrame:
    """(key..., verdict): fail if any fact is false, pass if all are true, else not run."""
    out = checks.groupBy(*key).agg(F.bool_or(~F.col(passed)).alias("_f"), F.bool_and(F.coalesce(F.col(passed), F.lit(False))).alias("_p"))
    return out.withColumn("verdict", F.when(F.coalesce(F.col("_f"), F.lit(False)), "fail").when(F.col("_p"), "pass").otherwise("not run")).drop("_f", "_p")


def batches_by_size(rows: DataFrame, *, order: str, size: Column, most_rows: int = 500, most_bytes: int = 12 << 20) -> DataFrame:
    """Rows with (part, batch): in order, at most so many rows and bytes to a batch; a larger row is a batch of its own.

    Rows are dealt in ranges of the order, and each range is numbered in one pass that remembers only the
    batch's running size.
    """
    sized = rows.withColumn("_size", size.cast("long")).repartitionByRange(order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(order)

    def run(frames):
        batch = n = total = 0
        for pdf in frames:
            numbers = []
            for s in pdf["_size"]:
                if n and (n >= most_rows or total + s > most_bytes):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                numbers.append(batch)
            yield pdf.drop(columns="_size").assign(batch=pd.array(numbers, dtype="int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sized.mapInPandas(run, schema=fields + ", part int, batch int")


def metric_totals(rows: DataFrame, since, until, *, name: str, dimension: str, at="timestamp", value="value") -> DataFrame:
    """(caller, total) of a metric's rows in [since, until): rows are (timestamp, name, dimensions map, value)."""
    inside = rows.where((F.col(at) >= F.lit(since)) & (F.col(at) < F.lit(until)) & (F.col("name") == name))
    return inside.groupBy(F.coalesce(F.col("dimensions")[dimension], F.lit("")).alias("caller")).agg(F.sum(value).alias("total"))


def owner_rows(rows: DataFrame, caller: str, since, until, *, at="timestamp", value="total") -> DataFrame:
    """A caller's rows with a finite, positive value inside a window of a quarter of an hour at most."""
    if not 0 <= (until - since).total_seconds() <= 900:
        raise ValueError("the window must be at most 15 minutes long")
    good = F.col(at).between(F.lit(since), F.lit(until)) & (F.col(value) > 0) & (F.col(value) < F.lit(float("inf")))
    return rows.where((F.col("caller") == caller) & good)


def client_totals(records: DataFrame, entered: DataFrame | None = None) -> DataFrame:
    """(label, total) of recorded prompt and completion tokens; a label both recorded and entered by hand is an error."""
    out = records.groupBy(F.col("caller").alias("label")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("long").alias("total"))
    if entered is None:
        return out
    both = out.unionByName(entered.select("label", "total")).groupBy("label").agg(F.sum("total").alias("total"), F.count("*").alias("_n"))
    return both.select("label", F.when(F.col("_n") == 1, F.col("total")).otherwise(F.raise_error(F.concat(F.lit("both recorded and entered: "), F.col("label")))).alias("total"))


def first_denied(requests: DataFrame, *, key: list[str], order: str, tokens="tokens", status="status", denied: int = 403, least: int = 45_000) -> DataFrame:
    """(key..., at, used, enough): tokens used before a key's first denied request, and whether the budget was really spent."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = requests.withColumn("_u", F.coalesce(F.sum(F.when(F.col(status) == 200, F.col(tokens))).over(w), F.lit(0)).cast("long")).where(F.col(status) == denied)
    return used.groupBy(*key).agg(F.min(order).alias("at"), F.min_by("_u", order).alias("used")).withColumn("enough", F.col("used") >= least)


def price_run(samples: DataFrame, answers: int) -> DataFrame:
    """(arm, price): mean cost of an arm's sample times the answers to come; none where a sample failed."""
    out = samples.groupBy("arm").agg(F.avg("cost_usd").alias("_m"), F.count_if(F.col("error").isNotNull()).alias("_e"))
    return out.select("arm", F.when(F.col("_e") == 0, F.col("_m") * answers).alias("price"))


def latency_summary(uploads: DataFrame, *, uploaded="uploaded_at", seen="seen_at") -> DataFrame:
    """One row (n, median, longest) in seconds over what was seen."""
    s = uploads.where(F.col(seen).isNotNull()).select(((F.unix_micros(F.col(seen).cast("timestamp")) - F.unix_micros(F.col(uploaded).cast("timestamp"))) / 1e6).alias("s"))
    return s.agg(F.count("*").alias("n"), F.median("s").alias("median"), F.max("s").alias("longest"))
