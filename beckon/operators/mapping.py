"""Configured field mapping and candidate building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.functions.convert import as_ts, convert_type, messages
from beckon.schema import SCORE, SUBJECT, TREATMENT, ddl

# fixed values: required target fields of a candidate
REQUIRED_FIELDS = ("customerId", "subjectType", "subjectId", "eventDate")
MIN_TTL_DAYS, DEFAULT_TTL_DAYS = 0, 30
MAX_TTL_DAYS = 100_000  # more would leave the range of timestamps
# fixed values: channels of a candidate made from a live event
REACTIVE_CHANNELS = ("email", "in-app", "push")


@dataclass(frozen=True)
class FieldRule:
    """One target field: a source path or a constant, with optional conversion."""

    source: str | None = None
    type: str | None = None
    required: bool = False
    default: Any = None
    constant: Any = None

    @staticmethod
    def of(spec: str | Mapping[str, Any]) -> FieldRule:
        if isinstance(spec, str):
            return FieldRule(source=spec)
        if "constant" in spec:
            return FieldRule(constant=spec["constant"])
        if "sourceField" not in spec:
            raise ValueError("a mapping needs sourceField or constant")
        return FieldRule(spec["sourceField"], spec.get("type"), spec.get("required", False), spec.get("defaultValue"))


def source_path(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """Column and type for a dotted path through structs, maps or JSON text; null when a hop is missing."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string"), T.StringType()
    col, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for i, hop in enumerate(rest):
        if isinstance(kind, T.StructType):
            if hop not in kind.names:
                return F.lit(None).cast("string"), T.StringType()
            col, kind = col[hop], kind[hop].dataType
        elif isinstance(kind, T.MapType):
            col, kind = col[hop], kind.valueType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(col, "$." + ".".join(rest[i:])), T.StringType()
        else:
            return F.lit(None).cast("string"), T.StringType()
    return col, kind


def map_fields(df: DataFrame, mapping: Mapping[str, Any], into: str = "mapped") -> DataFrame:
    """Adds struct ``mapped`` and array ``mapping_errors`` (failed required targets)."""
    fields, errors = [], []
    for target, spec in mapping.items():
        rule = FieldRule.of(spec)
        if rule.source is None:
            fields.append(F.lit(rule.constant).alias(target))
            continue
        src, kind = source_path(df, rule.source)
        value = convert_type(src, rule.type, kind) if rule.type else src
        if rule.required:
            errors.append((value.isNull(), F.lit(f"{target}: no usable value")))
        elif rule.default is not None:
            value = F.coalesce(value, F.lit(rule.default))
        fields.append(value.alias(target))
    return df.withColumn(into, F.struct(*fields)).withColumn("mapping_errors", messages(*errors) if errors else F.array().cast("array<string>"))


def computed_fields(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Derived columns from SQL expressions (ternaries, buckets, tiers, date shifts)."""
    return df.selectExpr("*", *[f"({e}) AS `{n}`" for n, e in exprs.items()])


def normalize(df: DataFrame, rules: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Per column one or more of upper, lower, trim, email, phone, utc, ``date:<format>``."""

    def apply(col: Column, rule: str) -> Column:
        if rule == "upper":
            return F.upper(col)
        if rule in ("lower", "email"):
            return F.lower(F.trim(col)) if rule == "email" else F.lower(col)
        if rule == "trim":
            return F.trim(col)
        if rule == "phone":
            digits = F.regexp_replace(col, r"[^0-9]", "")
            national = F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
            return national.when(F.length(digits) > 0, F.concat(F.lit("+"), digits))
        if rule == "utc":
            return F.to_utc_timestamp(col.try_cast("timestamp"), "UTC")
        if rule.startswith("date:"):
            return F.try_to_timestamp(col, F.lit(rule[5:]))
        raise ValueError(f"unknown rule {rule}")

    changed = {}
    for name, chain in rules.items():
        col = F.col(name)
        for rule in [chain] if isinstance(chain, str) else chain:
            col = apply(col, rule)
        changed[name] = col
    return df.withColumns(changed)


def build_context(market: Column, program: Column, vertical: Column | None = None, extra: Column | None = None) -> Column:
    """Marketplace, program, vertical in this order, then given entries having both parts."""

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("id"))

    base = [entry("marketplace", market), entry("program", program)]
    if vertical is not None:
        base.append(entry("vertical", vertical))
    ctx = F.filter(F.array(*base), lambda c: c["id"].isNotNull())
    if extra is not None:
        kept = F.filter(extra, lambda c: c["type"].isNotNull() & c["id"].isNotNull())
        ctx = F.concat(ctx, F.coalesce(kept, F.array().cast("array<struct<type:string,id:string>>")))
    return ctx


def build_channel_eligibility(flags: Mapping[str, Column], given: Column | None = None) -> Column:
    """The given map, else the present flags, else email only."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in flags.items()]), lambda e: e["value"].isNotNull()
    )
    from_flags = F.when(F.size(entries) > 0, F.map_from_entries(entries)).otherwise(F.create_map(F.lit("email"), F.lit(True)))
    return from_flags if given is None else F.coalesce(given, from_flags)


def build_attributes(
    event_date: Column,
    delivery_date: Column | None = None,
    timing_window: Column | None = None,
    order_value: Column | None = None,
    media_eligible: Column | None = None,
    channels: Column | None = None,
) -> Column:
    """P10: the attribute struct of a fresh, unconsumed candidate."""

    def opt(col: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if col is None else col.try_cast(kind)

    return F.struct(
        event_date.alias("event_date"),
        opt(delivery_date, "timestamp").alias("delivery_date"),
        opt(timing_window, "string").alias("timing_window"),
        opt(order_value, "double").alias("order_value"),
        opt(media_eligible, "boolean").alias("media_eligible"),
        opt(channels, "map<string,boolean>").alias("channel_eligibility"),
        F.lit(False).alias("consumed"),
        F.lit(None).cast("timestamp").alias("consumed_at"),
        F.lit(None).cast("string").alias("consumed_channel"),
    )


def build_metadata(as_of, connector: str, ttl_days: Column | None = None, execution: Column | None = None) -> Column:
    """P10: version 1, expiry ``as_of`` + TTL (30 days when absent or unreadable), execution id default "unknown"."""
    now = as_ts(as_of)
    days = (F.lit(None) if ttl_days is None else ttl_days).try_cast("int")
    days = F.when(F.abs(days.cast("bigint")) <= MAX_TTL_DAYS, days).otherwise(F.lit(DEFAULT_TTL_DAYS))
    return F.struct(
        now.alias("created_at"),
        now.alias("updated_at"),
        (now + F.make_dt_interval(days)).alias("expires_at"),
        F.lit(1).cast("bigint").alias("version"),
        F.lit(connector).alias("source_connector_id"),
        F.coalesce((F.lit(None) if execution is None else execution).cast("string"), F.lit("unknown")).alias("workflow_execution_id"),
        F.lit(None).cast(ddl(TREATMENT)).alias("experiment_treatment"),
    )


def to_candidates(df: DataFrame, mapping: Mapping[str, Any], as_of, connector: str = "warehouse") -> DataFrame:
    """Mapped rows to nested candidates, with ``errors`` (empty for good rows).

    Split with ``good_candidates`` / ``bad_rows``; a failing row never stops the others.
    """
    mapped = map_fields(df, mapping)
    have = set(mapped.schema["mapped"].dataType.names)

    def m(name: str) -> Column | None:
        return F.col(f"mapped.{name}") if name in have else None

    none = F.lit(None).cast("string")
    pick = {n: (m(n) if m(n) is not None else none) for n in (*REQUIRED_FIELDS, "marketplace", "programId", "vertical")}
    context = build_context(pick["marketplace"], pick["programId"], pick["vertical"], m("contextList"))
    about = m("subjectMetadata") if m("subjectMetadata") is not None else F.lit(None)
    flags = {c: m(f) for c, f in (("email", "emailEligible"), ("sms", "smsEligible"), ("push", "pushEligible")) if m(f) is not None}
    channels = build_channel_eligibility(flags, m("channelEligibility")) if flags or m("channelEligibility") is not None else F.create_map(F.lit("email"), F.lit(True))
    missing = [
        (F.col(f"mapped.{n}").isNull() if n in have else F.lit(True), F.lit(f"{n}: absent")) for n in REQUIRED_FIELDS
    ]
    empty_context = (F.size(context) == 0, F.lit("context: no entry"))
    kinds = {f.name: f.dataType for f in mapped.schema["mapped"].dataType.fields}
    event_date = convert_type(pick["eventDate"], "INSTANT", kinds.get("eventDate"))
    unread = (pick["eventDate"].isNotNull() & event_date.isNull(), F.lit("eventDate: not an instant"))
    return mapped.select(
        *df.columns,
        pick["customerId"].alias("customer_id"),
        context.alias("context"),
        F.struct(pick["subjectType"].alias("type"), pick["subjectId"].alias("id"), about.cast("map<string,string>").alias("metadata")).alias("subject"),
        F.lit(None).cast(f"map<string,{ddl(SCORE)}>").alias("scores"),
        build_attributes(event_date, m("deliveryDate"), m("timingWindow"), m("orderValue"), m("mediaEligible"), channels).alias("attributes"),
        build_metadata(as_of, connector, m("ttlDays"), m("workflowExecutionId")).alias("metadata"),
        F.lit(None).cast("array<struct<filter_id:string,reason:string,reason_code:string,timestamp:timestamp>>").alias("rejection_history"),
        F.concat("mapping_errors", messages(*missing, unread, empty_context)).alias("errors"),
    )


def good_candidates(df: DataFrame) -> DataFrame:
    return df.filter(F.size("errors") == 0).drop("errors")


def bad_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.size("errors") > 0)


def candidates_from_events(events: DataFrame, as_of=None) -> DataFrame:
    """One candidate per live event; created at ``as_of`` (the event time when not given)."""
    now = F.col("eventDate") if as_of is None else as_ts(as_of)
    channels = F.create_map(*[x for c in REACTIVE_CHANNELS for x in (F.lit(c), F.lit(True))])
    value = F.col("metadata")["orderValue"].try_cast("double")
    keep = [c for c in events.columns if c not in ("customerId", "eventType", "subjectType", "subjectId", "programId", "marketplace", "eventDate", "metadata")]
    return events.select(
        *keep,
        F.col("customerId").alias("customer_id"),
        build_context(F.col("marketplace"), F.col("programId")).alias("context"),
        F.struct(F.col("subjectType").alias("type"), F.col("subjectId").alias("id"), F.col("metadata")).cast(ddl(SUBJECT)).alias("subject"),
        F.lit(None).cast(f"map<string,{ddl(SCORE)}>").alias("scores"),
        build_attributes(F.col("eventDate"), order_value=value, channels=channels).alias("attributes"),
        build_metadata(now, "reactive-workflow", execution=F.concat(F.lit("reactive-"), F.col("customerId"))).alias("metadata"),
        F.lit(None).cast("array<struct<filter_id:string,reason:string,reason_code:string,timestamp:timestamp>>").alias("rejection_history"),
    )


# --- reading nested candidates ---


def context_id(kind: str) -> Column:
    """Id of the first context entry of this type.  No lambda, so it stays in generated code."""
    ctx = F.col("context")
    return F.get(ctx["id"], F.array_position(ctx["type"], kind).cast("int") - 1)


def score_value(model: str) -> Column:
    return F.col("scores")[model]["value"]


def max_score(default: float | None = 0.0) -> Column:
    """Highest score value over all models, the default when there is none."""
    best = F.array_max(F.map_values("scores")["value"])
    return best if default is None else F.coalesce(best, F.lit(default))


def first_channel(priority: Sequence[str]) -> Column:
    """First eligible channel in the given order, "none" without any."""
    eligible = [F.when(F.col("attributes.channel_eligibility")[c], F.lit(c)) for c in priority]
    return F.coalesce(*eligible, F.lit("none"))


def storage_keys(df: DataFrame, primary_model: str, priority: Sequence[str] = ("email", "in-app", "push", "sms")) -> DataFrame:
    """Partition, sort and index keys; ``key_error`` is set when program or marketplace is absent."""
    program, market = context_id("program"), context_id("marketplace")
    score = F.coalesce(score_value(primary_model), F.lit(0.0))
    created = F.col("metadata.created_at")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return df.withColumns(
        {
            "pk": join("CUSTOMER#", F.col("customer_id"), "#PROGRAM#", program, "#MARKETPLACE#", market),
            "sk": join("SUBJECT#", F.col("subject.type"), "#", F.col("subject.id")),
            "gsi1_pk": join("PROGRAM#", program, "#CHANNEL#", first_channel(priority)),
            "gsi1_sk": join("SCORE#", F.format_string("%.6f", score), "#CUSTOMER#", F.col("customer_id")),
            "gsi2_pk": join("PROGRAM#", program, "#DATE#", F.date_format(created, "yyyy-MM-dd")),
            "gsi2_sk": join("CREATED#", F.unix_timestamp(created).cast("string"), "#CUSTOMER#", F.col("customer_id")),
            "ttl": F.unix_timestamp("metadata.expires_at"),
            "key_error": F.when(program.isNull(), F.lit("program context missing")).when(market.isNull(), F.lit("marketplace context missing")),
        }
    )


def to_legacy_v1(df: DataFrame, primary_model: str) -> DataFrame:
    """Flat legacy row; absent program or marketplace reads "unknown", dates are ISO text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return df.select(
        "customer_id",
        F.col("subject.type").alias("subject_type"),
        F.col("subject.id").alias("subject_id"),
        F.coalesce(context_id("program"), F.lit("unknown")).alias("program"),
        F.coalesce(context_id("marketplace"), F.lit("unknown")).alias("marketplace"),
        score_value(primary_model).alias("score"),
        F.date_format("attributes.event_date", iso).alias("event_date"),
        F.date_format("metadata.created_at", iso).alias("created_at"),
        F.date_format("metadata.expires_at", iso).alias("expires_at"),
    )


def translate_v1_requests(df: DataFrame) -> DataFrame:
    """Legacy request rows to current ones: scores included, no refresh."""
    return df.withColumns({"include_scores": F.lit(True), "refresh_eligibility": F.lit(False)})


def strip_scores(df: DataFrame, include: str | bool) -> DataFrame:
    """Null the scores unless requested (constant or per-row column)."""
    cond = F.col(include) if isinstance(include, str) else F.lit(include)
    return df.withColumn("scores", F.when(cond, F.col("scores")))


def score_cache_key(customer: Column, subject: Column, model: Column) -> Column:
    """P17."""
    return F.concat_ws("#", customer, subject, model)
