"""Rates over trailing windows, per row and skew-safe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.operators.filters import haversine_miles
from beckon.operators.timeline import DAY, _null_safe, previous_row, prior_totals, trailing_aggregate

HOUR = 3600
# fixed values: default limits of the fraud and security rules
MAX_COUNT_PER_HOUR, MAX_AMOUNT_PER_HOUR, AMOUNT_RATIO = 10, 5000.0, 5.0
DEFAULT_CAP, DEFAULT_CAP_DAYS = 3, 7
UNIT_SECONDS = {"h": HOUR, "d": DAY, "w": 7 * DAY}


def velocity_filter(
    df: DataFrame, customer: str, ts: str, amount: str, max_count: int = MAX_COUNT_PER_HOUR, max_amount: float = MAX_AMOUNT_PER_HOUR, window_s: int = HOUR
) -> DataFrame:
    """trailing-hour count and amount (current row included) and whether both are in bounds.

    Amounts are summed exactly; a row whose amount is NaN or infinite adds nothing and is not allowed.
    """
    out = trailing_aggregate(df, [customer], ts, window_s, {"window_amount": amount}, "window_count", include_current=True)
    return out.withColumn("allowed", (F.col("window_count") <= max_count) & (F.col("window_amount") <= max_amount) & ~F.coalesce(F.isnan(amount) | (F.abs(amount) == float("inf")), F.lit(False)))


def amount_anomaly(df: DataFrame, customer: str, ts: str, tie: str, amount: str, ratio: float = AMOUNT_RATIO) -> DataFrame:
    """F16: amount against the average of the customer's earlier rows; the first row is never flagged."""
    out = prior_totals(df, [customer], [ts, tie], F.unix_micros(F.col(ts)), DAY * 1_000_000, amount, "__n", "__s")
    typical = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    out = out.withColumn("amount_ratio", F.when(typical > 0, F.col(amount) / typical))
    return out.withColumn("anomaly", F.coalesce(F.col("amount_ratio") > ratio, F.lit(False))).drop("__n", "__s")


def change_velocity(df: DataFrame, customer: str, ts: str, min_changes: int = 2, window_s: int = 600) -> DataFrame:
    """at least two changes within ten minutes, the current one counted."""
    out = trailing_aggregate(df, [customer], ts, window_s, None, "recent_changes", include_current=True)
    return out.withColumn("alert", F.col("recent_changes") >= min_changes)


def error_burst(df: DataFrame, customer: str, ts: str, tickets: DataFrame, min_errors: int = 3, window_s: int = DAY) -> DataFrame:
    """rows that complete a burst of errors, leaving out customers that already have a ticket."""
    out = trailing_aggregate(df, [customer], ts, window_s, None, "recent_errors", include_current=True)
    return out.filter(F.col("recent_errors") >= min_errors).join(tickets.select(customer).distinct(), customer, "left_anti")


def impossible_travel(df: DataFrame, customer: str, ts: str, tie: str, lat: str, lon: str, max_miles: float, window_s: int = HOUR) -> DataFrame:
    """consecutive events farther apart than ``max_miles`` within the window."""
    out = previous_row(df, [customer], [ts, tie], F.unix_micros(F.col(ts)), DAY * 1_000_000, [ts, lat, lon])
    miles = haversine_miles(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"), F.col(lat), F.col(lon))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"prev_{ts}"))
    out = out.withColumn("miles", miles)
    return out.withColumn("suspicious", F.coalesce((F.col("miles") > max_miles) & (gap <= window_s * 1_000_000), F.lit(False)))


def frequency_window_counts(candidates: DataFrame, sends: DataFrame, keys: Sequence[str], at: str, sent_at: str, window_s: int, name: str = "recent_sends") -> DataFrame:
    """Per candidate the sends of the same keys in ``[at - w, at)``, without a range join.

    Both sides become one timeline; sends weigh one, candidates nothing.
    """
    keys = list(keys)
    c = candidates.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__w"), F.struct(*candidates.columns).alias("__row"))
    s = sends.select(*keys, F.col(sent_at).alias("__at"), F.lit(1).alias("__w"))
    both = c.unionByName(s, allowMissingColumns=True)
    out = trailing_aggregate(both, keys, "__at", window_s, {name: "__w"}, "__n").filter(F.col("__row").isNotNull())
    return out.select("__row.*", F.col(name).cast("bigint").alias(name))


def parse_window(text: str) -> int:
    """ "24h", "7d", "1w" to seconds."""
    return int(text[:-1]) * UNIT_SECONDS[text[-1]]


def frequency_cap(
    candidates: DataFrame, sends: DataFrame, at: str, sent_at: str, rules: Sequence[Mapping] | None = None, customer: str = "customer_id", program: str = "program_id"
) -> DataFrame:
    """Allowed iff every rule's prior sends stay below its maximum.

    A rule is ``{"scope": "global" | "program", "max", "window"}``; the default is three per
    program in seven days.  The window is closed at its start.
    """
    rules = rules or [{"scope": "program", "max": DEFAULT_CAP, "window": f"{DEFAULT_CAP_DAYS}d"}]
    windows = [(r["scope"] == "program", parse_window(r["window"])) for r in rules]
    out = windowed_sends(candidates, sends, at, sent_at, windows, customer, program)
    return out.withColumn("allowed", _all([F.col(f"sends_{i}") < r["max"] for i, r in enumerate(rules)]))


def windowed_sends(candidates: DataFrame, sends: DataFrame, at: str, sent_at: str, windows: Sequence[tuple[bool, int]], customer: str, program: str) -> DataFrame:
    """``sends_0``, ``sends_1``, ...: earlier sends in ``[at - w, at)`` for each (per program?, w), all in one sweep.

    Both sides are aggregated by second once and then stand in one timeline for every window, with the window's number
    as part of the key; a candidate's second asks twice, at the start and at the end.  Buckets are one window wide, so a
    task sees two windows of one key at most.  The plan does not depend on the number of windows, and candidates are
    joined once.  Candidates without a time have no earlier sends.
    """
    own = [customer, program]
    c = candidates.select(*own, F.unix_seconds(at).alias("sec"), F.lit(0).alias("w"), F.lit(1).alias("asks"))
    s = sends.select(*own, F.unix_seconds(sent_at).alias("sec"), F.lit(1).alias("w"), F.lit(0).alias("asks"))
    seconds = c.unionByName(s).filter("sec is not null").groupBy(*own, "sec").agg(F.sum("w").alias("n"), F.max("asks").alias("asks"))
    kinds = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(scoped).alias("scoped"), F.lit(w).cast("bigint").alias("width")) for i, (scoped, w) in enumerate(windows)])
    timed = seconds.withColumn("r", F.explode(kinds)).select("*", "r.*").drop("r")
    timed = timed.withColumn("scope", F.when(F.col("scoped"), F.col(program))).withColumn("b", F.floor(F.col("sec") / F.col("width")))
    mark = lambda b, pos, kind, n, sign: F.struct(b.alias("b"), pos.alias("pos"), F.lit(kind).alias("kind"), n.alias("n"), F.lit(sign).alias("sign"))
    none, b, sec = F.lit(0).cast("bigint"), F.col("b"), F.col("sec")
    sent = F.when(F.col("n") > 0, F.array(mark(b, sec, 1, F.col("n"), 0), mark(b + 1, sec, 1, F.col("n"), 0)))
    asked = F.when(F.col("asks") > 0, F.array(mark(b, sec - F.col("width"), 0, none, -1), mark(b, sec, 0, none, 1)))
    nothing = F.array().cast("array<struct<b:bigint,pos:bigint,kind:int,n:bigint,sign:int>>")
    placed = timed.select(*own, "sec", "rule", "scoped", "scope", F.explode(F.concat(F.coalesce(sent, nothing), F.coalesce(asked, nothing))).alias("e")).select("*", "e.*").drop("e")
    upto = Window.partitionBy("rule", customer, "scoped", "scope", "b").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("run", F.sum("n").over(upto)).filter("sign != 0")
    sums = [F.sum(F.when(F.col("rule") == i, F.col("sign") * F.col("run"))).alias(f"sends_{i}") for i in range(len(windows))]
    counts = run.groupBy(*own, F.col("sec").alias("__sec")).agg(*sums)
    out = _null_safe(candidates.withColumn("__sec", F.unix_seconds(at)), counts, [*own, "__sec"])
    return out.withColumns({f"sends_{i}": F.coalesce(f"sends_{i}", F.lit(0)) for i in range(len(windows))}).drop("__sec")


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
