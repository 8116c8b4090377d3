"""Metrics.  Every aggregate combines map-side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts, days_between
from beckon.operators.timeline import _null_safe

# fixed values: unit prices in USD, billing prices, default throttle
PRICE_READ, PRICE_WRITE, PRICE_INVOCATION, PRICE_CALL, PRICE_GB = 2.5e-7, 1.25e-6, 1.66667e-8, 1e-3, 0.09
GB = float(2**30)
BILL_MINIMUM, BILL_CANDIDATE, BILL_MESSAGE = 100.0, 0.001, 0.01
DEFAULT_THROTTLE = 1000
Z_95 = 1.959963984540054


def n_if(cond: Column) -> Column:
    """Count of rows for which ``cond`` holds."""
    return F.count(F.when(cond, 1))


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, ``empty`` when b is zero."""
    safe = F.when(b > 0, a / b)
    return safe if empty is None else safe.otherwise(F.lit(empty))


def rejection_counts(df: DataFrame, by: Sequence[str] = ("filter_type", "reason_code")) -> DataFrame:
    """A1: add program_id / marketplace to ``by`` for finer counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rejections"))


def etl_metrics(df: DataFrame, by: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """A2."""
    bad = F.col(outcome) == "error"
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), n_if(~bad).alias("transformed"), n_if(bad).alias("errors"))


def filter_metrics(df: DataFrame, outcome: str = "outcome", reason: str = "reason_code") -> DataFrame:
    """A3: totals per (program, marketplace) and per reason in one GROUPING SETS pass.

    Per-reason rows count rejected rows only; ``grain`` tells the two apart.
    """
    rejected = F.col(outcome) == "rejected"
    code = F.when(rejected, F.col(reason))
    base = df.select("program_id", "marketplace", code.alias("reason_code"), rejected.alias("rejected"))
    sets = [[F.col("program_id"), F.col("marketplace")], [F.col("program_id"), F.col("marketplace"), F.col("reason_code")]]
    out = base.groupingSets(sets, "program_id", "marketplace", "reason_code").agg(
        F.count(F.lit(1)).alias("input"), n_if(F.col("rejected")).alias("rejected"), F.grouping("reason_code").alias("__g")
    )
    out = out.filter((F.col("__g") == 1) | F.col("reason_code").isNotNull())
    grain = F.when(F.col("__g") == 1, "program").otherwise("reason")
    return out.withColumn("grain", grain).withColumn("passed", F.col("input") - F.col("rejected")).drop("__g")


def score_metrics(df: DataFrame, by: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """A4: fallback scores count as scored."""
    o = F.col(outcome)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("input"), n_if(o != "error").alias("scored"), n_if(o == "fallback").alias("fallback"), n_if(o == "error").alias("errors")
    )


def store_metrics(df: DataFrame, by: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """A5 counts; the failed ids are rows, see ``failed_items`` (a list per run has no bound)."""
    bad = F.col(outcome) == "error"
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("input"), n_if(~bad).alias("stored"), n_if(bad).alias("failed"))
    return out.withColumn("success", F.col("failed") == 0)


def failed_items(df: DataFrame, by: Sequence[str], item: str, outcome: str = "outcome") -> DataFrame:
    """A5: one row per failed item."""
    return df.filter(F.col(outcome) == "error").select(*by, item)


def workflow_summary(df: DataFrame, key: str = "execution_id", stage: str = "stage", outcome: str = "outcome") -> DataFrame:
    """All stage metrics of a run side by side in one aggregation."""
    at = lambda s: F.col(stage) == s
    bad = F.col(outcome) == "error"
    out = df.groupBy(key).agg(
        n_if(at("etl")).alias("etl_processed"), n_if(at("etl") & bad).alias("etl_errors"),
        n_if(at("filter")).alias("filter_input"), n_if(at("filter") & (F.col(outcome) == "rejected")).alias("filter_rejected"),
        n_if(at("score") & ~bad).alias("scored"), n_if(at("score") & bad).alias("score_errors"),
        n_if(at("store") & ~bad).alias("stored"), n_if(at("store") & bad).alias("store_failed"),
    )
    out = out.withColumn("total_errors", F.col("etl_errors") + F.col("score_errors") + F.col("store_failed"))
    return out.withColumn("success", (F.col("store_failed") == 0) & (F.col("total_errors") == 0))


def experiment_metrics(df: DataFrame, by: Sequence[str] = ("experiment_id", "treatment_id")) -> DataFrame:
    """Input has flags delivered, responded; conversion is null without deliveries."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("created"), n_if(F.col("delivered")).alias("delivered"), n_if(F.col("responded")).alias("responses"))
    return out.withColumn("conversion_rate", ratio(F.col("responses"), F.col("delivered"), None))


def compare_treatments(metrics: DataFrame) -> DataFrame:
    """Rank by conversion inside each experiment, null counting as zero."""
    rate = F.coalesce("conversion_rate", F.lit(0.0))
    return metrics.withColumn("place", F.row_number().over(Window.partitionBy("experiment_id").orderBy(rate.desc(), F.asc("treatment_id"))))


def auto_promote(metrics: DataFrame, control: str, min_lift: float = 0.05, z: float = Z_95) -> DataFrame:
    """Promote a variant whose lift reaches the threshold and is significant (two-proportion z)."""
    c = metrics.filter(F.col("treatment_id") == control).select("experiment_id", F.col("delivered").alias("n0"), F.col("responses").alias("x0"))
    v = metrics.filter(F.col("treatment_id") != control).select("experiment_id", "treatment_id", F.col("delivered").alias("n1"), F.col("responses").alias("x1"))
    d = v.join(c, "experiment_id").filter("n0 > 0 and n1 > 0")
    pooled = (F.col("x0") + F.col("x1")) / (F.col("n0") + F.col("n1"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n1")))
    d = d.withColumn("lift", F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0"))
    d = d.withColumn("z_score", F.when(se > 0, F.col("lift") / se).otherwise(0.0))
    promote = (F.col("lift") >= min_lift) & (F.abs("z_score") >= z)
    return d.select("experiment_id", "treatment_id", "lift", "z_score", promote.alias("promote"))


def campaign_metrics(deliveries: DataFrame, opens: DataFrame) -> DataFrame:
    """A10: sent, opened and open rate per campaign."""
    first = opens.select("delivery_id").distinct().withColumn("__o", F.lit(True))
    out = deliveries.join(first, "delivery_id", "left").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("sent"), n_if(F.col("__o")).alias("opened"))
    return out.withColumn("open_rate", ratio(F.col("opened"), F.col("sent")))


def delivery_metrics(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """A11."""
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col("status") == "delivered").alias("delivered"), n_if(F.col("status") == "failed").alias("failed"),
        n_if(F.col("error_code") == "FREQUENCY_CAP_EXCEEDED").alias("rate_limited"),
    )


def funnel_rates(events: DataFrame, by: Sequence[str], stage: str = "stage") -> DataFrame:
    """Open, click and response rates over sent."""
    names = ("sent", "opened", "clicked", "responded")
    out = events.groupBy(*by).agg(*[n_if(F.col(stage) == n).alias(n) for n in names])
    return out.withColumns({f"{n}_rate": ratio(F.col(n), F.col("sent")) for n in names[1:]})


def cost_summary(df: DataFrame, key: str = "program_id") -> DataFrame:
    """Usage sums and estimated cost; duration is summed but not priced."""
    names = ("read_units", "write_units", "invocations", "duration_ms", "external_calls", "bytes_out")
    out = df.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    cost = (
        F.col("read_units") * PRICE_READ + F.col("write_units") * PRICE_WRITE + F.col("invocations") * PRICE_INVOCATION
        + F.col("external_calls") * PRICE_CALL + F.col("bytes_out") * (PRICE_GB / GB)
    )
    return out.withColumn("estimated_cost", cost)


def legacy_usage(requests: DataFrame, customers: str = "customer_ids", approx: bool = False) -> DataFrame:
    """Totals overall and by endpoint, channel and program; a batch is one request.

    ``customers`` is an array column; distinct customers are counted over all ids.
    """
    dims = ("endpoint", "channel", "program_id")
    pairs = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    tagged = requests.withColumn("__d", F.explode(pairs)).select("__d.*", "ts", customers).filter(F.col("value").isNotNull())
    counts = tagged.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("requests"), F.min("ts").alias("first_request"), F.max("ts").alias("last_request"))
    ids = tagged.select("dimension", "value", F.explode(customers).alias("c"))
    unique = (F.approx_count_distinct("c") if approx else F.count_distinct("c")).alias("customers")
    return counts.join(ids.groupBy("dimension", "value").agg(unique), ["dimension", "value"])


def daily_customer_sketches(requests: DataFrame, customers: str = "customer_ids", precision: int = 14) -> DataFrame:
    """A14 over time: one HyperLogLog sketch per dimension, value and day, a few kilobytes whatever its customers.

    Days can be written as they end and merged for any longer period by ``merge_customer_sketches``, without the requests.
    """
    dims = ("endpoint", "channel", "program_id")
    pairs = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    ids = requests.select(F.to_date("ts").alias("day"), F.explode(pairs).alias("d"), customers).select("day", "d.*", F.explode(customers).alias("c"))
    return ids.filter("value is not null and c is not null").groupBy("dimension", "value", "day").agg(F.hll_sketch_agg("c", precision).alias("sketch"), F.count(F.lit(1)).alias("mentions"))


def merge_customer_sketches(sketches: DataFrame, period: Column) -> DataFrame:
    """Distinct customers per dimension, value and ``period`` of the day, from daily sketches alone."""
    merged = sketches.groupBy("dimension", "value", period.alias("period")).agg(F.hll_union_agg("sketch").alias("__s"), F.sum("mentions").alias("mentions"))
    return merged.withColumn("customers", F.hll_sketch_estimate("__s")).drop("__s")


def exact_sum(value: str, scale: int = 6) -> Column:
    """Sum of a double column that does not depend on row order (up to ``scale`` decimals)."""
    return F.sum(F.col(value).cast(f"decimal(28,{scale})")).cast("double")


def customer_features(orders: DataFrame, as_of, customer: str, value: str, at: str) -> DataFrame:
    """A15."""
    out = orders.groupBy(customer).agg(exact_sum(value).alias("lifetime_value"), F.count(F.lit(1)).alias("purchase_frequency"), F.max(at).alias("last_purchase"))
    out = out.withColumn("avg_order_value", F.col("lifetime_value") / F.col("purchase_frequency"))
    return out.withColumn("days_since_purchase", days_between(F.col("last_purchase"), as_ts(as_of)))


def category_affinity(df: DataFrame, customer: str, category: str) -> DataFrame:
    """Share of a customer's engagements per category; the window sees one row per category."""
    counts = df.groupBy(customer, category).agg(F.count(F.lit(1)).alias("engagements"))
    return counts.withColumn("affinity", F.col("engagements") / F.sum("engagements").over(Window.partitionBy(customer)))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, bucket: Column, name: str) -> DataFrame:
    """Interpolated percentile per key without holding a key's values in one task.

    Equal values are counted first, so repeated values cost one row.  Counts per coarse
    ``bucket`` (ascending in ``value``) locate the one or two buckets that hold the wanted
    ranks; only their values are ordered.
    """
    keys = list(keys)
    tagged = df.filter(F.col(value).isNotNull()).withColumn("__b", bucket).groupBy(*keys, "__b", value).agg(F.count(F.lit(1)).alias("__m"))
    counts = tagged.groupBy(*keys, "__b").agg(F.sum("__m").alias("__c"))
    run = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = counts.withColumn("__end", F.sum("__c").over(run)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    pos = (F.col("__n") - 1) * p
    located = located.withColumns({"__lo": F.floor(pos) + 1, "__hi": F.ceil(pos) + 1, "__f": pos - F.floor(pos)})
    located = located.filter((F.col("__end") >= F.col("__lo")) & (F.col("__end") - F.col("__c") < F.col("__hi")))
    near = _null_safe(tagged, located, [*keys, "__b"], "inner")
    inner = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__r", F.sum("__m").over(inner) + F.col("__end") - F.col("__c"))
    pick = lambda c: F.min(F.when(F.col("__r") >= F.col(c), F.col(value)))
    out = near.groupBy(*keys).agg(pick("__lo").alias("__vl"), pick("__hi").alias("__vh"), F.first("__f").alias("__f"))
    return out.select(*keys, (F.col("__vl") + (F.col("__vh") - F.col("__vl")) * F.col("__f")).alias(name))


def metric_rollup(df: DataFrame, series: Sequence[str], ts: str, value: str, period: str = "5 minutes", bucket_width: float = 1.0) -> DataFrame:
    """Sum, count and exact p99 per period."""
    keys = [*series, "period"]
    timed = df.withColumn("period", F.window(ts, period)["start"])
    sums = timed.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("samples"))
    p99 = exact_percentile(timed, keys, value, 0.99, F.floor(F.col(value) / bucket_width), "p99")
    return _null_safe(sums, p99, keys)


def alarms(rollup: DataFrame, series: Sequence[str], metric: str, threshold: float, periods: int, period_s: int = 300) -> DataFrame:
    """Alarm when the metric exceeds the threshold in ``periods`` consecutive periods.

    A missing period does not breach.  The window sees one row per period.
    """
    breach = F.col(metric) > threshold
    run = Window.partitionBy(*series).orderBy(F.unix_seconds("period")).rangeBetween(-(periods - 1) * period_s, 0)
    return rollup.withColumn("breach", breach).withColumn("alarm", F.sum(F.coalesce(breach, F.lit(False)).cast("int")).over(run) >= periods)


def channel_performance(attempts: DataFrame) -> DataFrame:
    """A19."""
    out = delivery_metrics(attempts, ["channel"]).withColumnRenamed("total", "attempts")
    return out.withColumn("success_rate", ratio(F.col("delivered"), F.col("attempts"))).select("channel", "attempts", "delivered", "failed", "success_rate")


def program_health(df: DataFrame) -> DataFrame:
    """A19."""
    bad = F.col("outcome") == "error"
    return df.groupBy("program_id").agg(n_if(~bad).alias("successes"), n_if(bad).alias("errors"))


def throttle_status(requests: DataFrame, limits: DataFrame, as_of, window_s: int, program: str = "program_id", ts: str = "ts") -> DataFrame:
    """Requests in the current window, maximum (override or 1000), remaining, throttled."""
    now = as_ts(as_of)
    age = F.unix_micros(now) - F.unix_micros(F.col(ts))
    recent = n_if((age >= 0) & (age < window_s * 1_000_000))
    counts = requests.groupBy(program).agg(recent.alias("current_count"))
    out = counts.join(limits.select(program, "max_deliveries"), program, "left")
    out = out.withColumn("max_deliveries", F.coalesce("max_deliveries", F.lit(DEFAULT_THROTTLE)).cast("bigint"))
    left = F.greatest(F.lit(0), F.col("max_deliveries") - F.col("current_count"))
    return out.withColumn("remaining", left).withColumn("throttled", F.col("remaining") <= 0)


def queue_stats(queue: DataFrame) -> DataFrame:
    """A21."""
    return queue.groupBy("channel").agg(F.count(F.lit(1)).alias("queued"))


def program_status_rollup(runs: DataFrame) -> DataFrame:
    """Run counts and failures since the last success.

    Two aggregations instead of a per-program window: the last success, then what follows it.
    Timeouts count as failures in the streak.
    """
    ok = F.col("status") == "success"
    key = F.struct("started_at", "run_id")
    totals = runs.groupBy("program_id").agg(
        n_if(ok).alias("successes"), n_if(F.col("status") == "failure").alias("failures"), n_if(F.col("status") == "timeout").alias("timeouts"),
        F.max(F.when(ok, key)).alias("last_ok"), F.max("started_at").alias("last_run"),
    )
    late = runs.join(totals.select("program_id", "last_ok"), "program_id").filter(F.col("last_ok").isNull() | (key > F.col("last_ok")))
    streak = late.groupBy("program_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    out = totals.join(streak, "program_id", "left")
    return out.withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0))).drop("last_ok")


def cache_hit_rate(lookups: DataFrame) -> DataFrame:
    """Over the output of ``lookup_score_cache``."""
    out = lookups.agg(F.count(F.lit(1)).alias("lookups"), n_if(F.col("cache_hit")).alias("hits"))
    return out.withColumn("hit_rate", ratio(F.col("hits"), F.col("lookups")))


def usage_billing(usage: DataFrame) -> DataFrame:
    """Input has client_id, ts, candidates, messages."""
    out = usage.groupBy("client_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("candidates").alias("candidates"), F.sum("messages").alias("messages"))
    return out.withColumn("amount", F.greatest(F.lit(BILL_MINIMUM), F.col("candidates") * BILL_CANDIDATE + F.col("messages") * BILL_MESSAGE))
