"""Planning deliveries.  Nothing is sent; plans are rows with a status."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts
from beckon.functions.hashing import delivery_id
from beckon.operators.enrichment import attach_device_tokens, attach_template, attach_voice_ids, opted_out_flag
from beckon.operators.timeline import DAY, asof_join

DEFAULT_CAP = (3, 7)  # e-mails, days
SMS_LENGTH = 160
BUNDLE_SIZE = 5
# fixed values: order of tracking states when times are equal
TRACKING_ORDER = ("SENT", "DELIVERED", "OPENED", "CLICKED", "BOUNCED", "COMPLAINED")


def _verdict(df: DataFrame, steps: Sequence[tuple[Column, str, bool]], channel: str, campaign: str) -> DataFrame:
    """First failing step gives code and retryability; otherwise a delivery id."""
    code, retry = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for cond, name, again in reversed(steps):
        code = F.when(cond, name).otherwise(code)
        retry = F.when(cond, again).otherwise(retry)
    out = df.withColumns({"error_code": code, "retryable": retry, "channel": F.lit(channel), "campaign_id": F.lit(campaign)})
    did = delivery_id(F.col("customer_id"), F.col("subject_id"), F.col("program_id"), F.lit(channel), F.lit(campaign))
    return out.withColumns({"status": F.when(F.col("error_code").isNull(), "delivered").otherwise("failed"), "delivery_id": F.when(F.col("error_code").isNull(), did)})


def plan_email(
    df: DataFrame, templates: DataFrame, opt_outs: DataFrame, sends: DataFrame, as_of, campaign: str, tie: str,
    caps: Mapping[str, tuple[int, int]] | None = None, within_batch: bool = False, send_failed: Column | None = None,
) -> DataFrame:
    """Template, opt-out, frequency cap, send.

    Prior sends are counted in ``[as_of - days, as_of)`` per customer and program with the
    program's cap.  ``within_batch`` also counts earlier rows of this batch; the default does
    not, so one batch may exceed the cap.
    """
    caps = caps or {}
    limit, days = F.lit(DEFAULT_CAP[0]), F.lit(DEFAULT_CAP[1])
    for program, (n, d) in caps.items():
        limit = F.when(F.col("program_id") == program, n).otherwise(limit)
        days = F.when(F.col("program_id") == program, d).otherwise(days)
    age = F.unix_micros(as_ts(as_of)) - F.unix_micros("sent_at")
    recent = sends.filter((age > 0) & (age <= days.cast("bigint") * (DAY * 1_000_000))).groupBy("customer_id", "program_id").agg(F.count(F.lit(1)).alias("prior_sends"))
    out = opted_out_flag(attach_template(df, templates), opt_outs)
    out = out.join(recent, ["customer_id", "program_id"], "left").withColumn("prior_sends", F.coalesce("prior_sends", F.lit(0)))
    blocked = F.col("template_error").isNotNull() | F.col("opted_out")
    over = F.col("prior_sends") >= limit
    if within_batch:
        most = max([DEFAULT_CAP[0], *[n for n, _ in caps.values()]])
        rn = F.row_number().over(Window.partitionBy("customer_id", "program_id").orderBy(tie))
        early = out.filter(~blocked).withColumn("__rn", rn).filter(F.col("__rn") <= most).select(tie, "__rn")
        out = out.join(early, tie, "left")
        over = F.coalesce(F.col("prior_sends") + F.col("__rn") > limit, F.lit(True))
    steps = [
        (F.col("template_error").isNotNull(), "NO_TEMPLATE", False), (F.col("opted_out"), "OPTED_OUT", False), (over, "FREQUENCY_CAP_EXCEEDED", True),
        (F.lit(False) if send_failed is None else F.coalesce(send_failed, F.lit(False)), "SEND_FAILED", True),
    ]
    return _verdict(out, steps, "email", campaign).drop("__rn")


def _payload(names: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(n) for n in names]))


def plan_push(df: DataFrame, templates: DataFrame, tokens: DataFrame, campaign: str) -> DataFrame:
    """Template, then device tokens; payload as JSON."""
    out = attach_device_tokens(attach_template(df, templates), tokens)
    out = _verdict(out, [(F.col("template_error").isNotNull(), "NO_TEMPLATE", False), (F.col("device_error").isNotNull(), "NO_DEVICE_TOKEN", False)], "push", campaign)
    body = _payload(["delivery_id", "customer_id", "program_id", "marketplace", "template_id", "subject_type", "subject_id", "device_count"])
    return out.withColumn("payload", F.when(F.col("status") == "delivered", body))


def plan_in_app(df: DataFrame, templates: DataFrame, campaign: str) -> DataFrame:
    """Template only; the card as JSON."""
    out = _verdict(attach_template(df, templates), [(F.col("template_error").isNotNull(), "NO_TEMPLATE", False)], "in-app", campaign)
    body = _payload(["delivery_id", "customer_id", "program_id", "marketplace", "template_id", "subject_type", "subject_id"])
    return out.withColumn("payload", F.when(F.col("status") == "delivered", body))


def plan_voice(df: DataFrame, templates: DataFrame, voice: DataFrame, campaign: str) -> DataFrame:
    """Template, then voice user id; the prompt as JSON."""
    out = attach_voice_ids(attach_template(df, templates), voice)
    out = _verdict(out, [(F.col("template_error").isNotNull(), "NO_TEMPLATE", False), (F.col("voice_error").isNotNull(), "NO_VOICE_USER_ID", False)], "voice", campaign)
    body = _payload(["delivery_id", "customer_id", "voice_user_id", "program_id", "marketplace", "template_id", "subject_type", "subject_id"])
    return out.withColumn("payload", F.when(F.col("status") == "delivered", body))


def shadow_delivery(plan: DataFrame, shadow: Column, channel: str, campaign: str) -> DataFrame:
    """D3: shadow rows count as delivered under a ``shadow-`` id, whatever the plan says."""
    did = F.concat(F.lit(f"shadow-{channel}-"), delivery_id(F.col("customer_id"), F.col("subject_id"), F.lit(campaign)))
    swap = {"status": F.lit("delivered"), "error_code": F.lit(None).cast("string"), "retryable": F.lit(None).cast("boolean"), "delivery_id": did}
    on = F.coalesce(shadow, F.lit(False))
    out = plan.withColumn("shadow_mode", on)
    return out.withColumns({n: F.when(F.col("shadow_mode"), v).otherwise(F.col(n)) for n, v in swap.items()})


_PLACEHOLDER = re.compile(r"(\{\{\w+\}\}|\{\w+\})")


def unsubscribe_link(base: str, customer: Column, program: Column) -> Column:
    """D4."""
    return F.concat(F.lit(f"{base}?customerId="), customer, F.lit("&programId="), program)


def apply_tracking_events(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Latest tracking state per delivery; SENT before any event."""
    place = F.array_position(F.array(*[F.lit(s) for s in TRACKING_ORDER]), F.col("event_status"))
    last = events.groupBy("delivery_id").agg(F.max_by("event_status", F.struct("event_at", place)).alias("tracking_status"), F.max("event_at").alias("tracked_at"))
    out = deliveries.join(last, "delivery_id", "left")
    return out.withColumn("tracking_status", F.coalesce("tracking_status", F.lit("SENT")))


def render_template(df: DataFrame, template: str, variables: Mapping[str, str], into: str = "message") -> DataFrame:
    """Put column values into ``{{name}}`` / ``{name}``; ``missing_variable`` flags nulls and unknown names.

    The template is cut at its placeholders once, so values are never searched for placeholders themselves.
    """
    pieces, missing = [], F.lit(False)
    for k, part in enumerate(_PLACEHOLDER.split(template)):
        if k % 2 == 0:
            pieces.append(F.lit(part))
            continue
        name = part.strip("{}")
        if name in variables:
            value = F.col(variables[name]).cast("string")
            missing = missing | value.isNull()
            pieces.append(F.coalesce(value, F.lit("")))
        else:
            missing = F.lit(True)
            pieces.append(F.lit(part))
    return df.withColumns({into: F.concat(*pieces), "missing_variable": missing})


def schedule_local_send(event_at: Column, zone: Column, hour: int = 10, cooling_min: int = 60) -> Column:
    """Next local ``hour`` o'clock at least the cooling period after the event, as UTC."""
    ready = event_at + F.make_dt_interval(mins=F.lit(cooling_min))
    local = F.from_utc_timestamp(ready, zone)
    today = F.date_trunc("DAY", local) + F.make_dt_interval(hours=F.lit(hour))
    slot = F.when(local <= today, today).otherwise(today + F.make_dt_interval(days=F.lit(1)))
    return F.to_utc_timestamp(slot, zone)


def pick_channel(eligibility: Column, priority: Sequence[str]) -> Column:
    """First eligible channel by configured priority, null without any."""
    return F.coalesce(*[F.when(eligibility[c], F.lit(c)) for c in priority])


def bundle_top_n(df: DataFrame, customer: str, subject: str, order: Sequence[Column], n: int = BUNDLE_SIZE) -> DataFrame:
    """Best n subjects per customer in one row; at most n rows per customer are collected."""
    rn = F.row_number().over(Window.partitionBy(customer).orderBy(*order))
    top = df.select(customer, subject, rn.alias("__rn")).filter(F.col("__rn") <= n)
    items = F.sort_array(F.collect_list(F.struct("__rn", subject)))
    return top.groupBy(customer).agg(items[subject].alias("subjects"))


def enforce_max_length(text: Column, limit: int = SMS_LENGTH) -> tuple[Column, Column]:
    """(cut text, was too long)."""
    return F.left(text, F.lit(limit)), F.length(text) > limit


def follow_up_sequence(
    starts: DataFrame, conversions: DataFrame, steps: Sequence[tuple[str, int, bool]], customer: str = "customer_id", at: str = "event_date", converted_at: str = "converted_at"
) -> DataFrame:
    """Steps (channel, delay seconds, only if not converted) per start.

    A conditional step is left out when the customer converted between start and step.  The
    first conversion after a start is found with one as-of join on reversed time.
    """
    mirror = lambda c: F.timestamp_micros(-F.unix_micros(F.col(c)))
    l = starts.withColumn("__back", mirror(at))
    r = conversions.select(customer, mirror(converted_at).alias("__back_c"), F.col(converted_at).alias("__conv"))
    first = asof_join(l, r, [customer], "__back", "__back_c", ["__conv"])
    plan = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(s).alias("delay_s"), F.lit(cond).alias("conditional")) for c, s, cond in steps])
    out = first.withColumn("__step", F.explode(plan)).withColumns(
        {"channel": F.col("__step.channel"), "send_at": F.timestamp_micros(F.unix_micros(F.col(at)) + F.col("__step.delay_s").cast("bigint") * 1_000_000)}
    )
    converted = F.coalesce(F.col("__conv") <= F.col("send_at"), F.lit(False))
    return out.filter(~(F.col("__step.conditional") & converted)).drop("__back", "__conv", "__step")
