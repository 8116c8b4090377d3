"""Queries for F1-F25."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import days_between, iso
from beckon.operators import filters as fl
from beckon.operators import velocity as ve
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query

CHAIN = [
    fl.FilterSpec("business_rule", "business_rule", 3, True, {"minOrderValue": 20000.0, "maxDaysSinceEvent": 2000, "requireDeliveryDate": True}),
    fl.FilterSpec("eligibility", "eligibility", 0, True, {"requiredChannels": ["email", "push"]}),
    fl.FilterSpec("trust", "trust", 1, True, {}),
    fl.FilterSpec("quality", "quality", 2, True, {"minQualityScore": 0.3, "minConfidence": 0.2}),
    fl.FilterSpec("never", "quality", 9, False, {}),
]
MISSING_CH = "concat_ws(', ', case when not email then 'email' end, case when not push then 'push' end)"
ELIG_CODE = "case when not (email and push) then 'CHANNEL_INELIGIBLE' when timing_window is null then 'TIMING_WINDOW_MISSING' end"
TRUST_CODE = "case when trust is null then 'TRUST_SCORE_MISSING' when trust < 0.5 then 'TRUST_SCORE_LOW' when fraud > 0.5 then 'FRAUD_DETECTED' end"
QUAL_CODE = "case when quality is null then 'QUALITY_SCORE_MISSING' when quality < {q} then 'QUALITY_SCORE_LOW' when quality_conf < {c} then 'CONFIDENCE_LOW' end"
BIZ_CODE = """case when order_value is null then 'ORDER_VALUE_MISSING' when order_value < 20000 then 'ORDER_VALUE_LOW'
  when datediff('day', event_date, timestamp '2001-08-02') > 2000 then 'EVENT_TOO_OLD' when delivery_date is null then 'DELIVERY_DATE_MISSING' end"""
CHAIN_SQL = f"""select *, case when e is not null then 'eligibility' when t is not null then 'trust' when q is not null then 'quality' when b is not null then 'business_rule' end as filter_id,
  coalesce(e, t, q, b) as reason_code from (select *, {ELIG_CODE} as e, {TRUST_CODE} as t, {QUAL_CODE.format(q=0.3, c=0.2)} as q, {BIZ_CODE} as b from cand)"""


@query(
    "f1_filter_eligibility",
    f"""select k, {ELIG_CODE} as reason_code, case when not (email and push) then 'closed channels: ' || {MISSING_CH}
    when timing_window is null then 'no timing window' end as reason from cand_core""",
    ("cand_core",),
)
def f1(spark, sf):
    verdict = fl.filter_eligibility({"requiredChannels": ["email", "push"]}, "eligibility")
    return candidates(spark, sf, delivery=False).select("k", verdict["reason_code"].alias("reason_code"), verdict["reason"].alias("reason"))


@query("f2_filter_trust", f"select k, {TRUST_CODE} as reason_code from cand_core", ("cand_core",))
def f2(spark, sf):
    return candidates(spark, sf, delivery=False).select("k", fl.filter_trust({}, "trust")["reason_code"].alias("reason_code"))


@query(
    "f3_filter_quality",
    f"select k, coalesce({QUAL_CODE.format(q=0.6, c=0.7)}, case when not coalesce(media_eligible, false) then 'MEDIA_INELIGIBLE' end) as reason_code from cand_core",
    ("cand_core",),
)
def f3(spark, sf):
    verdict = fl.filter_quality({"requireMedia": True}, "quality")
    return candidates(spark, sf, delivery=False).select("k", verdict["reason_code"].alias("reason_code"))


@query("f4_filter_business_rule", f"select k, {BIZ_CODE} as reason_code from cand", ("cand",))
def f4(spark, sf):
    verdict = fl.filter_business_rule(CHAIN[0].params, "business_rule", AS_OF_ORDERS)
    return candidates(spark, sf).select("k", verdict["reason_code"].alias("reason_code"))


@query(
    "f5_filter_chain",
    f"select k, filter_id, reason_code, case when reason_code is null then 0 else 1 end as history from ({CHAIN_SQL})",
    ("cand",),
)
def f5(spark, sf):
    out = fl.filter_chain(candidates(spark, sf), CHAIN, AS_OF_ORDERS)
    return out.select("k", "rejection.filter_id", "rejection.reason_code", F.coalesce(F.size("rejection_history"), F.lit(0)).alias("history"))


@query(
    "f5_filter_error",
    f"select k, case when not (email and push) or timing_window is null then 'eligibility' when k % 10 = 0 then 'trust' when {TRUST_CODE} is not null then 'trust' end as filter_id, case when {ELIG_CODE} is not null then {ELIG_CODE} when k % 10 = 0 then 'FILTER_ERROR' else {TRUST_CODE} end as reason_code from cand_core",
    ("cand_core",),
)
def f5_error(spark, sf):
    out = fl.filter_chain(candidates(spark, sf, delivery=False), CHAIN[1:3], AS_OF_ORDERS, guard={"trust": F.col("k") % 10 == 0})
    return out.select("k", "rejection.filter_id", "rejection.reason_code")


@query(
    "f5_sql_filters",
    """select k, case when k % 4 = 0 then 'ratio' when 100 // (k % 4) < 50 then 'ratio' when k % 5 = 0 then 'number' when k % 5 < 3 then 'number' end as filter_id,
    case when k % 4 = 0 then 'FILTER_ERROR' when 100 // (k % 4) < 50 then 'RATIO_LOW' when k % 5 = 0 then 'FILTER_ERROR' when k % 5 < 3 then 'CONDITION_FAILED' end as reason_code from cand_core""",
    ("cand_core",),
)
def f5_sql(spark, sf):
    chain = [
        fl.FilterSpec("ratio", "sql", 0, params={"condition": "100 / (k % 4) >= 50", "code": "RATIO_LOW"}),
        fl.FilterSpec("number", "sql", 1, params={"condition": "cast(case when k % 5 = 0 then 'none' else cast(k % 5 as string) end as int) >= 3"}),
    ]
    out = fl.filter_chain(candidates(spark, sf, delivery=False), chain, AS_OF_ORDERS)
    return out.select("k", "rejection.filter_id", "rejection.reason_code")


@query("f6_passed", f"select k from ({CHAIN_SQL}) where reason_code is null", ("cand",))
def f6_passed(spark, sf):
    return fl.split_passed_rejected(fl.filter_chain(candidates(spark, sf), CHAIN, AS_OF_ORDERS))[0].select("k")


@query(
    "f6_rejected",
    f"select customer_id, subject_type, subject_id, filter_id, reason_code from ({CHAIN_SQL}) where reason_code is not null",
    ("cand",),
)
def f6_rejected(spark, sf):
    out = fl.split_passed_rejected(fl.filter_chain(candidates(spark, sf), CHAIN, AS_OF_ORDERS))[1]
    return out.select("customer_id", "subject_type", "subject_id", "filter_id", "reason_code")


@query(
    "f7_default_chain",
    f"""select k, coalesce(case when timing_window is null then 'TIMING_WINDOW_MISSING' end, {TRUST_CODE}, {QUAL_CODE.format(q=0.6, c=0.7)}) as batch_code, cast(null as string) as reactive_code from cand_core""",
    ("cand_core",),
)
def f7(spark, sf):
    df = candidates(spark, sf, delivery=False)
    batch = fl.filter_chain(df, fl.default_chain("batch"), AS_OF_ORDERS).withColumn("batch_code", F.col("rejection.reason_code")).drop("rejection")
    both = fl.filter_chain(batch.withColumn("rejection_history", F.lit(None).cast(df.schema["rejection_history"].dataType)), fl.default_chain("reactive"), AS_OF_ORDERS)
    return both.select("k", "batch_code", F.col("rejection.reason_code").alias("reactive_code"))


AS_OF_MID = "1998-06-15 00:00:00"
_EL8 = "(expires_at > timestamp '1998-06-15' and timestamp '1998-06-15' - event_date < interval '30' day and (email or in_app or push or sms))"


@query("f8_serving_eligible", f"select k, {_EL8} as eligible from cand_core", ("cand_core",))
def f8(spark, sf):
    return candidates(spark, sf, delivery=False).select("k", fl.serving_eligible(AS_OF_MID).alias("eligible"))


@query(
    "f9_serving_stale",
    """select k, @EPOCH{updated_at} <= @EPOCH{timestamp '1998-06-15'} - 86400 or (@EPOCH{updated_at} <= @EPOCH{timestamp '1998-06-15'} - 43200 and (trust is not null or fraud is not null or quality is not null)) as stale from cand_core""",
    ("cand_core",),
)
def f9(spark, sf):
    return candidates(spark, sf, delivery=False).select("k", fl.serving_stale(AS_OF_MID).alias("stale"))


@query(
    "f10_rule_lists",
    """select k, expires_at >= timestamp '1998-06-15' and (email or in_app or push or sms) as fresh,
    expires_at >= timestamp '1998-06-15' and (email or in_app or push or sms) and @EPOCH{timestamp '1998-06-15'} - @EPOCH{event_date} <= 10 * 86400 as configured,
    @EPOCH{timestamp '1998-06-15'} - @EPOCH{updated_at} > 86400 as stale from cand_core""",
    ("cand_core",),
)
def f10(spark, sf):
    return candidates(spark, sf, delivery=False).select(
        "k", fl.always_fresh_eligible(AS_OF_MID).alias("fresh"),
        fl.rule_list_eligible(AS_OF_MID, ["not_expired", "has_channel", ("event_age", 10)]).alias("configured"), fl.rule_list_stale(AS_OF_MID).alias("stale"),
    )


@query("f11_filter_channel", "select k from cand_core where sms", ("cand_core",))
def f11(spark, sf):
    return fl.filter_channel(candidates(spark, sf, delivery=False), "sms").select("k")


@query(
    "f12_filter_treatment",
    """select k from cand_core where case ck % 4 when 0 then email when 1 then greatest(coalesce(trust, 0), coalesce(fraud, 0), coalesce(quality, 0)) >= 0.7
    when 2 then subject_type = 'product' else true end""",
    ("cand_core",),
)
def f12(spark, sf):
    assigned = fixture(spark, sf, "customer").filter("c_custkey % 4 <> 3").selectExpr(
        "concat('CUST-', c_custkey) as customer_id", "case when c_custkey % 4 = 0 then 'email' end as channel_filter",
        "case when c_custkey % 4 = 1 then 0.7D end as score_threshold", "case when c_custkey % 4 = 2 then 'product' end as subject_type_filter",
    )
    return fl.filter_treatment(candidates(spark, sf, delivery=False), assigned).select("k")


@query(
    "f13_ttl",
    """select k, case when k % 40 > 0 then strftime(created_at + interval '1' day * cast(k % 40 as int), '%Y-%m-%d %H:%M:%S') end as expiry,
    timestamp '1998-06-15' > expires_at as expired, @EPOCH{expires_at} - @EPOCH{timestamp '1998-06-15'} as remaining from cand_core""",
    ("cand_core",),
)
def f13(spark, sf):
    return fixture(spark, sf, "cand_core").select(
        "k", iso(fl.ttl_expiry(F.col("created_at"), F.col("k") % 40)).alias("expiry"), fl.is_expired(F.col("expires_at"), AS_OF_MID).alias("expired"),
        fl.remaining_seconds(F.col("expires_at"), AS_OF_MID).alias("remaining"),
    )


@query("f14_purge_expired", "select k from cand_core where expires_at >= timestamp '1998-06-15'", ("cand_core",))
def f14(spark, sf):
    return fl.purge_expired(fixture(spark, sf, "cand_core"), F.col("expires_at"), AS_OF_MID).select("k")


@query(
    "f15_velocity_filter",
    """with e as (select event_id, user_id % 20 as grp, @EPOCH{ts} as sec, value from events),
    w as (select event_id, count(*) over r as n, sum(value) over r as s from e window r as (partition by grp order by sec range between 3600 preceding and current row))
    select event_id, n as window_count, round(s, 4) as window_amount, n <= 2 and s <= 100 as allowed from w""",
)
def f15(spark, sf):
    df = fixture(spark, sf, "events").withColumn("grp", F.col("user_id") % 20)
    out = ve.velocity_filter(df, "grp", "ts", "value", 2, 100.0)
    return out.select("event_id", "window_count", F.round("window_amount", 4).alias("window_amount"), "allowed")


@query(
    "f16_amount_anomaly",
    """with w as (select event_id, value, avg(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as typical from events)
    select event_id, round(case when typical > 0 then value / typical end, 4) as amount_ratio, coalesce(typical > 0 and value / typical > 5, false) as anomaly from w""",
)
def f16(spark, sf):
    out = ve.amount_anomaly(fixture(spark, sf, "events"), "user_id", "ts", "event_id", "value")
    return out.select("event_id", F.round("amount_ratio", 4).alias("amount_ratio"), "anomaly")


@query(
    "f17_change_velocity",
    """with e as (select event_id, user_id % 20 as grp, @EPOCH{ts} as sec from events where event_type in ('click', 'signup'))
    select event_id, count(*) over r as recent_changes, count(*) over r >= 2 as alert from e window r as (partition by grp order by sec range between 600 preceding and current row)""",
)
def f17(spark, sf):
    df = fixture(spark, sf, "events").filter("event_type in ('click', 'signup')").withColumn("grp", F.col("user_id") % 20)
    return ve.change_velocity(df, "grp", "ts").select("event_id", "recent_changes", "alert")


@query(
    "f18_error_burst",
    """with e as (select event_id, user_id, @EPOCH{ts} as sec from events where event_type = 'error'),
    w as (select event_id, user_id, count(*) over (partition by user_id order by sec range between 86400 preceding and current row) as recent_errors from e)
    select event_id, user_id, recent_errors from w where recent_errors >= 3 and user_id % 7 <> 0""",
)
def f18(spark, sf):
    events = fixture(spark, sf, "events")
    tickets = events.filter("user_id % 7 = 0").select("user_id")
    return ve.error_burst(events.filter("event_type = 'error'"), "user_id", "ts", tickets).select("event_id", "user_id", "recent_errors")


@query(
    "f19_churn_signals",
    """select c_custkey, coalesce((c_acctbal < 1000)::int, 0) + (c_custkey % 10 <= 5)::int + coalesce((datediff('day', last_purchase, timestamp '2001-08-02') >= 60)::int, 0) as signals,
    coalesce((c_acctbal < 1000)::int + (c_custkey % 10 <= 5)::int + coalesce((datediff('day', last_purchase, timestamp '2001-08-02') >= 60)::int, 0) >= 2 and lifetime_value >= 500, false) as risk
    from customer left join features on customer_id = 'CUST-' || c_custkey""",
    ("features",),
)
def f19(spark, sf):
    cust = fixture(spark, sf, "customer").withColumn("customer_id", F.concat(F.lit("CUST-"), "c_custkey"))
    df = cust.join(fixture(spark, sf, "features"), "customer_id", "left")
    signals = fl.churn_signals(F.when(F.col("c_acctbal") < 1000, 0.3).otherwise(0.1), (F.col("c_custkey") % 10) / 10, days_between(F.col("last_purchase"), F.lit(AS_OF_ORDERS).cast("timestamp")))
    df = df.withColumn("signals", signals)
    return df.select("c_custkey", "signals", F.coalesce(fl.at_risk(F.col("signals"), F.col("lifetime_value")), F.lit(False)).alias("risk"))


@query(
    "f20_purchase_intent",
    """select user_id, event_id % 20 as subject, count(*) as views, round(sum(value), 4) as view_seconds from events where event_type = 'view' group by all having count(*) >= 2 and sum(value) >= 50""",
)
def f20(spark, sf):
    views = fixture(spark, sf, "events").filter("event_type = 'view'").withColumn("subject", F.col("event_id") % 20)
    out = fl.purchase_intent(views, ["user_id", "subject"], "value", 2, 50.0)
    return out.withColumn("view_seconds", F.round("view_seconds", 4))


@query(
    "f21_use_case_rules",
    """select k, datediff('day', updated_at, expires_at) between 30 and 90 as churn_ok, (k % 5 >= 2 or k % 9 = 0) as refund, coalesce(order_value >= 100000, false) as worth from cand_core""",
    ("cand_core",),
)
def f21(spark, sf):
    return fixture(spark, sf, "cand_core").select(
        "k", fl.churn_timing(days_between(F.col("updated_at"), F.col("expires_at"))).alias("churn_ok"), fl.refund_severity(F.col("k") % 5, F.col("k") % 9 == 0).alias("refund"),
        fl.issue_value(F.col("order_value"), 100000.0).alias("worth"),
    )


@query(
    "f22_impossible_travel",
    """with l as (select event_id, ts, lat, lon, lag(ts) over w as pts, lag(lat) over w as plat, lag(lon) over w as plon from travel window w as (partition by user_id order by ts, event_id)),
    d as (select *, 2 * 3959.0e0 * asin(sqrt(least(1.0e0, sin(radians(lat - plat) / 2) ** 2 + cos(radians(plat)) * cos(radians(lat)) * sin(radians(lon - plon) / 2) ** 2))) as miles from l)
    select event_id, round(miles, 3) as miles, coalesce(miles > 500 and epoch_us(ts) - epoch_us(pts) <= 3600000000, false) as suspicious from d""",
    ("travel",),
)
def f22(spark, sf):
    out = ve.impossible_travel(fixture(spark, sf, "travel"), "user_id", "ts", "event_id", "lat", "lon", 500.0)
    return out.select("event_id", F.round("miles", 3).alias("miles"), "suspicious")


@query(
    "f23_interest_match",
    """select p_partkey, (split_part(p_name, ' ', 1) in ('small', 'red', 'blue'))::int + (split_part(p_name, ' ', 2) in ('ring', 'bolt'))::int >= 1 as tag_match,
    (split_part(p_name, ' ', 1) in ('small', 'red', 'blue'))::int + (split_part(p_name, ' ', 2) in ('ring', 'bolt'))::int = 2 and p_type in ('ECONOMY', 'SMALL') as full_match from part""",
)
def f23(spark, sf):
    tags = F.split("p_name", " ")
    likes = F.array(*[F.lit(x) for x in ("small", "red", "blue", "ring", "bolt")])
    return fixture(spark, sf, "part").select(
        "p_partkey", fl.interest_match(likes, tags, 0.5).alias("tag_match"), fl.interest_match(likes, tags, 1.0, F.col("p_type"), ["ECONOMY", "SMALL"]).alias("full_match")
    )


@query("f24_escalation_rules", "select event_id, case when value < 2 then 'create-ticket' when value < 3 then 'alert' end as action from events")
def f24(spark, sf):
    return fixture(spark, sf, "events").select("event_id", fl.escalation(F.col("value")).alias("action"))


@query(
    "f25_recheck_stale",
    """select k, case when timestamp '2001-08-02' - created_at <= interval '3' day then 'unchecked' when ck % 13 = 0 then 'expired:opted_out' when exists (select 1 from cand_core a where a.k % 7 = 0 and a.customer_id = c.customer_id and a.k % 2000 = c.k % 2000) then 'expired:answered'
    when not exists (select 1 from stock where active and p_partkey = k % 2000) then 'expired:inactive' else 'valid' end as recheck from cand_core c""",
    ("cand_core", "stock"),
)
def f25(spark, sf):
    df = fixture(spark, sf, "cand_core").withColumn("part", F.col("k") % 2000)
    outs = fixture(spark, sf, "opt_outs").filter("program_id is null")
    answered = df.filter("k % 7 = 0").select("customer_id", "part")
    active = fixture(spark, sf, "stock").filter("active").select(F.col("p_partkey").alias("part"))
    keyed = df.withColumn("pair", F.col("k"))
    return fl.recheck_stale(keyed, "created_at", AS_OF_ORDERS, outs, answered, active, "customer_id", "part").select("k", "recheck")
