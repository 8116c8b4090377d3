"""Live events, batch or streaming (all stateless)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts, parse_instant

# fixed values: keywords that stop or restart messages
STOP_WORDS = ("STOP", "UNSUBSCRIBE", "CANCEL", "END", "QUIT")
START_WORD = "START"

_EVENT = "detail struct<customerId:string,eventType:string,subjectType:string,subjectId:string,programId:string,marketplace:string,eventDate:string,metadata:map<string,string>>"
_OPT_OUT = "detail struct<customerId:string,eventType:string,programId:string,timestamp:string>"


def parse_customer_events(df: DataFrame, body: str = "body", as_of=None) -> DataFrame:
    """Unwrap ``detail``; ``parse_error`` names the first missing field (null for good rows).

    ``as_of`` (a time or a column) replaces a missing event date.
    """
    d = F.from_json(F.col(body), _EVENT)["detail"]
    required = ("customerId", "eventType", "subjectType", "subjectId", "programId", "marketplace")
    error = F.coalesce(
        F.when(d.isNull(), F.lit("detail is missing")), *[F.when(d[n].isNull(), F.lit(f"{n} is missing")) for n in required],
        F.when(d["eventDate"].isNotNull() & parse_instant(d["eventDate"]).isNull(), F.lit("eventDate is invalid")),
    )
    now = F.lit(None).cast("timestamp") if as_of is None else as_ts(as_of)
    return df.select(
        *[c for c in df.columns if c != body],
        *[d[n].alias(n) for n in required],
        F.coalesce(parse_instant(d["eventDate"]), now).alias("eventDate"),
        F.coalesce(d["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
        error.alias("parse_error"),
    )


def parse_opt_out_events(df: DataFrame, body: str = "body", as_of=None) -> DataFrame:
    """Customer and event type are required, the program is optional."""
    d = F.from_json(F.col(body), _OPT_OUT)["detail"]
    error = F.coalesce(
        F.when(d.isNull(), F.lit("detail is missing")), *[F.when(d[n].isNull(), F.lit(f"{n} is missing")) for n in ("customerId", "eventType")]
    )
    now = F.lit(None).cast("timestamp") if as_of is None else as_ts(as_of)
    return df.select(
        *[c for c in df.columns if c != body],
        d["customerId"].alias("customerId"), d["eventType"].alias("eventType"), d["programId"].alias("programId"),
        F.coalesce(parse_instant(d["timestamp"]), now).alias("timestamp"),
        error.alias("parse_error"),
    )


def route_events(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """One row per matching rule.  A rule is ``{"id", "where"}`` with a Column condition."""
    hits = F.array_compact(F.array(*[F.when(r["where"], F.lit(r["id"])) for r in rules]))
    return df.withColumn("rule_id", F.explode(hits))


def event_pattern(source: str | None = None, type: str | None = None, any_of: Mapping[str, Sequence[str]] | None = None, at_least: Mapping[str, float] | None = None) -> Column:
    """A routing condition: source, type, value in list, numeric lower bounds; null never matches."""
    cond = F.lit(True)
    if source is not None:
        cond = cond & (F.col("source") == source)
    if type is not None:
        cond = cond & (F.col("event_type") == type)
    for name, values in (any_of or {}).items():
        cond = cond & F.col(name).isin(*values)
    for name, low in (at_least or {}).items():
        cond = cond & (F.col(name) >= low)
    return F.coalesce(cond, F.lit(False))


def sms_keyword_opt_outs(df: DataFrame, customer: str = "customer_id", body: str = "body", ts: str = "received_at", tie: str = "turn") -> DataFrame:
    """Customers whose latest keyword message is a stop word."""
    word = F.upper(F.trim(body))
    keyed = df.select(customer, ts, tie, word.alias("keyword")).filter(word.isin(*STOP_WORDS, START_WORD))
    last = keyed.groupBy(customer).agg(F.max_by(F.struct("keyword", ts), F.struct(ts, tie)).alias("m"))
    return last.filter(F.col("m.keyword") != START_WORD).select(customer, "m.keyword", F.col(f"m.{ts}").alias("opted_out_at"))
