"""Reject rules, filter chains and predicates over candidates.

A filter is a nullable reject struct: null passes, otherwise it says why the row is
rejected.  Chains fold rejects with ``coalesce``, so the first rejection wins and the
later ones are not evaluated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts, days_between
from beckon.functions.isolate import with_isolated
from beckon.operators.mapping import max_score
from beckon.schema import REJECTION, ddl

# fixed values: thresholds of the standard filters and of serving
TRUST_MIN, FRAUD_MAX, QUALITY_MIN, CONFIDENCE_MIN = 0.5, 0.5, 0.6, 0.7
SERVING_MAX_EVENT_DAYS, STALE_CANDIDATE_HOURS, STALE_SCORE_HOURS = 30, 24, 12
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def _reject(filter_id: str, code: str, reason: Column | str) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(filter_id).alias("filter_id"), reason.alias("reason"), F.lit(code).alias("reason_code"))


def filter_eligibility(params: Mapping, filter_id: str, as_of=None) -> Column:
    """every required channel must be eligible; then a timing window must be set."""
    channels = params.get("requiredChannels", [])
    flags = F.col("attributes.channel_eligibility")
    missing = [~F.coalesce(flags[c], F.lit(False)) for c in channels]
    window = F.col("attributes.timing_window")
    names = F.concat_ws(", ", *[F.when(m, F.lit(c)) for m, c in zip(missing, channels)])
    reason = F.concat(F.lit("closed channels: "), names)
    out = F.when(reduce(lambda a, b: a | b, missing, F.lit(False)), _reject(filter_id, "CHANNEL_INELIGIBLE", reason))
    if params.get("checkTimingWindow", True):
        out = out.when(window.isNull() | (window == ""), _reject(filter_id, "TIMING_WINDOW_MISSING", "no timing window"))
    return out


def filter_trust(params: Mapping, filter_id: str, as_of=None) -> Column:
    """F2."""
    low, high = params.get("minTrustScore", TRUST_MIN), params.get("maxFraudScore", FRAUD_MAX)
    trust, fraud = F.col("scores")["trust"]["value"], F.col("scores")["fraud"]["value"]
    return (
        F.when(trust.isNull(), _reject(filter_id, "TRUST_SCORE_MISSING", "no trust score"))
        .when(trust < low, _reject(filter_id, "TRUST_SCORE_LOW", F.concat(F.lit("trust "), trust.cast("string"), F.lit(f" under {low}"))))
        .when(fraud > high, _reject(filter_id, "FRAUD_DETECTED", F.concat(F.lit("fraud at "), fraud.cast("string"))))
    )


def filter_quality(params: Mapping, filter_id: str, as_of=None) -> Column:
    """F3."""
    q = F.col("scores")["quality"]
    floor, sure = params.get("minQualityScore", QUALITY_MIN), params.get("minConfidence", CONFIDENCE_MIN)
    out = (
        F.when(q["value"].isNull(), _reject(filter_id, "QUALITY_SCORE_MISSING", "no quality score"))
        .when(q["value"] < floor, _reject(filter_id, "QUALITY_SCORE_LOW", F.concat(F.lit("quality "), q["value"].cast("string"), F.lit(f" under {floor}"))))
        .when(q["confidence"] < sure, _reject(filter_id, "CONFIDENCE_LOW", F.concat(F.lit("quality confidence "), q["confidence"].cast("string"), F.lit(f" under {sure}"))))
    )
    if params.get("requireMedia", False):
        media = F.coalesce(F.col("attributes.media_eligible"), F.lit(False))
        out = out.when(~media, _reject(filter_id, "MEDIA_INELIGIBLE", "media wanted, not eligible"))
    return out


def filter_business_rule(params: Mapping, filter_id: str, as_of=None) -> Column:
    """order value floor, event age in whole days, delivery date required."""
    attrs = F.col("attributes")
    out = F.when(F.lit(False), _reject(filter_id, "", ""))
    if "minOrderValue" in params:
        value = attrs["order_value"]
        out = out.when(value.isNull(), _reject(filter_id, "ORDER_VALUE_MISSING", "no order value"))
        out = out.when(value < params["minOrderValue"], _reject(filter_id, "ORDER_VALUE_LOW", F.concat(F.lit("order value "), value.cast("string"), F.lit(f" under {params['minOrderValue']}"))))
    if "maxDaysSinceEvent" in params:
        age = days_between(attrs["event_date"], as_ts(as_of))
        out = out.when(age > params["maxDaysSinceEvent"], _reject(filter_id, "EVENT_TOO_OLD", F.concat(F.lit("event is "), age.cast("string"), F.lit(f" days old, limit {params['maxDaysSinceEvent']}"))))
    if params.get("requireDeliveryDate", False):
        out = out.when(attrs["delivery_date"].isNull(), _reject(filter_id, "DELIVERY_DATE_MISSING", "no delivery date"))
    return out


def sql_column(filter_id: str) -> str:
    return f"__sql_{filter_id}"


def filter_sql(params: Mapping, filter_id: str, as_of=None) -> Column:
    """a SQL condition under which a row passes; ``filter_chain`` evaluates it in isolation."""
    held = F.col(sql_column(filter_id))
    failed = F.when(held.isNull(), _reject(filter_id, "FILTER_ERROR", "condition could not be evaluated"))
    return failed.when(~held, _reject(filter_id, params.get("code", "CONDITION_FAILED"), params.get("reason", params["condition"])))


FILTERS: dict[str, Callable[..., Column]] = {
    "eligibility": filter_eligibility,
    "trust": filter_trust,
    "quality": filter_quality,
    "business_rule": filter_business_rule,
    "sql": filter_sql,
}


@dataclass(frozen=True)
class FilterSpec:
    """One configured filter; ``type`` picks the rule, ``id`` is recorded."""

    id: str
    type: str
    order: int = 0
    enabled: bool = True
    params: Mapping = field(default_factory=dict)


def default_chain(kind: str = "batch") -> list[FilterSpec]:
    """the standard batch chain, or the reactive one (eligibility without timing)."""
    if kind == "reactive":
        return [FilterSpec("eligibility", "eligibility", 0, True, {"checkTimingWindow": False})]
    return [FilterSpec(t, t, i) for i, t in enumerate(("eligibility", "trust", "quality", "business_rule"))]


def filter_chain(
    df: DataFrame, specs: Sequence[FilterSpec], as_of, registry: Mapping[str, Callable[..., Column]] | None = None, guard: Mapping[str, Column] | None = None
) -> DataFrame:
    """adds ``rejection`` (null for passed rows) and appends it to ``rejection_history``.

    ``guard`` maps a filter id to a condition under which that filter cannot be evaluated;
    such rows are rejected with FILTER_ERROR at that filter's place in the chain.  Filters of type ``sql``
    need no guard: a condition that fails to evaluate, or is null, is a FILTER_ERROR of that row alone.
    """
    known = {**FILTERS, **(registry or {})}
    steps = []
    texts = {sql_column(s.id): f"cast({s.params['condition']} as boolean)" for s in specs if s.enabled and s.type == "sql"}
    df = with_isolated(df, texts)
    for spec in sorted((s for s in specs if s.enabled), key=lambda s: s.order):
        verdict = known[spec.type](spec.params, spec.id, as_of)
        if guard and spec.id in guard:
            broken = F.coalesce(guard[spec.id], F.lit(False))
            verdict = F.when(broken, _reject(spec.id, "FILTER_ERROR", "input not usable")).otherwise(verdict)
        steps.append(verdict)
    first = F.coalesce(*steps) if steps else F.when(F.lit(False), _reject("", "", ""))
    stamp = F.struct(F.col("rejection.filter_id"), F.col("rejection.reason"), F.col("rejection.reason_code"), as_ts(as_of).alias("timestamp"))
    record = F.array(stamp).cast(f"array<{ddl(REJECTION)}>")
    old = F.coalesce(F.col("rejection_history"), F.array().cast(f"array<{ddl(REJECTION)}>"))
    out = df.withColumn("rejection", first)
    return out.withColumn("rejection_history", F.when(F.col("rejection").isNotNull(), F.concat(old, record)).otherwise(F.col("rejection_history"))).drop(*texts)


def split_passed_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """passed candidates and flat rejected rows."""
    passed = df.filter(F.col("rejection").isNull()).drop("rejection")
    rejected = df.filter(F.col("rejection").isNotNull()).select(
        "customer_id", F.col("subject.type").alias("subject_type"), F.col("subject.id").alias("subject_id"), "rejection.filter_id", "rejection.reason", "rejection.reason_code"
    )
    return passed, rejected


# --- serving predicates ---


def _age_us(col: Column, as_of) -> Column:
    return F.unix_micros(as_ts(as_of)) - F.unix_micros(col)


def has_channel() -> Column:
    return F.coalesce(F.array_contains(F.map_values("attributes.channel_eligibility"), True), F.lit(False))


def serving_eligible(as_of, max_event_days: int = SERVING_MAX_EVENT_DAYS) -> Column:
    """F8: not expired (equality is expired), event younger than 30 days, any channel."""
    return (
        (F.col("metadata.expires_at") > as_ts(as_of))
        & (_age_us(F.col("attributes.event_date"), as_of) < max_event_days * DAY_US)
        & has_channel()
    )


def serving_stale(as_of, candidate_hours: int = STALE_CANDIDATE_HOURS, score_hours: int = STALE_SCORE_HOURS) -> Column:
    """not updated for 24 h, or any score at least 12 h old."""
    old_score = _age_us(F.array_min(F.map_values("scores")["timestamp"]), as_of) >= score_hours * HOUR_US
    return (_age_us(F.col("metadata.updated_at"), as_of) >= candidate_hours * HOUR_US) | F.coalesce(old_score, F.lit(False))


def always_fresh_eligible(as_of) -> Column:
    """expiry equality still counts as valid; any channel."""
    return (F.col("metadata.expires_at") >= as_ts(as_of)) & has_channel()


def rule_list_eligible(as_of, rules: Sequence[str | tuple[str, int]]) -> Column:
    """AND of "not_expired", "has_channel", ("event_age", max_days)."""
    made = []
    for r in rules:
        if r == "not_expired":
            made.append(F.col("metadata.expires_at") >= as_ts(as_of))
        elif r == "has_channel":
            made.append(has_channel())
        else:
            made.append(_age_us(F.col("attributes.event_date"), as_of) <= r[1] * DAY_US)
    return reduce(lambda a, b: a & b, made, F.lit(True))


def rule_list_stale(as_of) -> Column:
    """strictly more than 24 h since the update."""
    return _age_us(F.col("metadata.updated_at"), as_of) > STALE_CANDIDATE_HOURS * HOUR_US


def filter_channel(df: DataFrame, channel: str) -> DataFrame:
    """F11."""
    return df.filter(F.coalesce(F.col("attributes.channel_eligibility")[channel], F.lit(False)))


def filter_treatment(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """apply each customer's treatment: channel_filter, score_threshold, subject_type_filter.

    Customers without a treatment keep all rows; no scores count as 0.0.
    """
    out = df.join(assignments.select("customer_id", "channel_filter", "score_threshold", "subject_type_filter"), "customer_id", "left")
    channel_ok = F.col("channel_filter").isNull() | F.coalesce(F.element_at("attributes.channel_eligibility", F.col("channel_filter")), F.lit(False))
    score_ok = F.col("score_threshold").isNull() | (max_score() >= F.col("score_threshold"))
    type_ok = F.col("subject_type_filter").isNull() | (F.col("subject.type") == F.col("subject_type_filter"))
    return out.filter(channel_ok & score_ok & type_ok).drop("channel_filter", "score_threshold", "subject_type_filter")


def ttl_expiry(created: Column, days: Column | int) -> Column:
    """creation plus TTL days; non-positive TTLs give null."""
    d = days if isinstance(days, Column) else F.lit(days)
    return F.when(d > 0, created + F.make_dt_interval(d.cast("int")))


def is_expired(expires: Column, as_of) -> Column:
    """strictly after the expiry."""
    return as_ts(as_of) > expires


def remaining_seconds(expires: Column, as_of) -> Column:
    """may be negative."""
    return F.unix_seconds(expires) - F.unix_seconds(as_ts(as_of))


def purge_expired(df: DataFrame, expires: Column, as_of) -> DataFrame:
    """F14."""
    return df.filter(~is_expired(expires, as_of))


# --- use-case predicates ---


def churn_signals(decline: Column, login_ratio: Column, days_since_purchase: Column) -> Column:
    """number of churn signals set."""
    flags = [decline >= 0.3, login_ratio <= 0.5, days_since_purchase >= 60]
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def at_risk(signals: Column, lifetime_value: Column, min_signals: int = 2, min_value: float = 500.0) -> Column:
    """F19."""
    return (signals >= min_signals) & (lifetime_value >= min_value)


def purchase_intent(views: DataFrame, keys: Sequence[str], seconds: str, min_views: int = 3, min_seconds: float = 300.0) -> DataFrame:
    """subjects viewed often and long enough."""
    out = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("views"), F.sum(seconds).alias("view_seconds"))
    return out.filter((F.col("views") >= min_views) & (F.col("view_seconds") >= min_seconds))


def churn_timing(days_since_churn: Column) -> Column:
    """between 30 and 90 days."""
    return days_since_churn.between(30, 90)


def refund_severity(delay_days: Column, damaged: Column) -> Column:
    """late by two days or damaged."""
    return (delay_days >= 2) | F.coalesce(damaged, F.lit(False))


def issue_value(value: Column, floor: float) -> Column:
    """value floor, null fails."""
    return F.coalesce(value >= floor, F.lit(False))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 3959.0) -> Column:
    """Great-circle distance in miles."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def interest_match(interests: Column, tags: Column, min_overlap: float, region: Column | None = None, regions: Sequence[str] = ()) -> Column:
    """share of the tags that are interests reaches the threshold; region in the list if given."""
    share = F.size(F.array_intersect(tags, interests)) / F.size(tags)
    ok = F.coalesce((F.size(tags) > 0) & (share >= min_overlap), F.lit(False))
    return ok if region is None else ok & F.coalesce(region.isin(*regions), F.lit(False))


def escalation(satisfaction: Column) -> Column:
    """first matching action, null for none."""
    return F.when(satisfaction < 2, "create-ticket").when(satisfaction < 3, "alert")


def recheck_stale(
    df: DataFrame, created: str, as_of, opt_outs: DataFrame, answered: DataFrame, active: DataFrame,
    customer: str = "customer_id", subject: str = "subject_id", min_age_days: int = 3,
) -> DataFrame:
    """candidates older than three days turn "expired" when opted out, answered, or inactive."""
    old = _age_us(F.col(created), as_of) > min_age_days * DAY_US
    mark = lambda d, keys, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    out = df.join(mark(opt_outs, [customer], "__out"), [customer], "left")
    out = out.join(mark(answered, [customer, subject], "__ans"), [customer, subject], "left")
    out = out.join(mark(active, [subject], "__act"), [subject], "left")
    status = (
        F.when(~old, "unchecked").when(F.col("__out").isNotNull(), "expired:opted_out")
        .when(F.col("__ans").isNotNull(), "expired:answered").when(F.col("__act").isNull(), "expired:inactive").otherwise("valid")
    )
    return out.withColumn("recheck", status).drop("__out", "__ans", "__act")
