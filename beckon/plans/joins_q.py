"""Queries for J1-J20 and U1-U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.operators import enrichment as en
from beckon.operators import experiments as ex
from beckon.operators import velocity as ve
from beckon.plans.fixtures import AS_OF_ORDERS, fixture
from beckon.plans.registry import query


@query(
    "j1_enrich",
    "select k, c_acctbal as balance, c_mktsegment as segment from cand_core left join customer on 'CUST-' || c_custkey = customer_id and c_custkey % 3 <> 0",
    ("cand_core",),
)
def j1(spark, sf):
    dim = fixture(spark, sf, "customer").filter("c_custkey % 3 <> 0").selectExpr("concat('CUST-', c_custkey) as customer_id", "c_acctbal as balance", "c_mktsegment as segment")
    return en.enrich(fixture(spark, sf, "cand_core"), dim, "customer_id", ["balance", "segment"]).select("k", "balance", "segment")


@query("j2_exclude_engaged", "select k from cand_core where k % 6 <> 0", ("cand_core",))
def j2(spark, sf):
    df = fixture(spark, sf, "cand_core")
    done = fixture(spark, sf, "orders").filter("o_orderkey % 6 = 0").selectExpr("concat('CUST-', o_custkey) as customer_id", "concat('ORD-', o_orderkey) as subject_id")
    return en.exclude_engaged(df, done).select("k")


@query("j3_exclude_opted_out", "select k from cand_core where ck % 13 <> 0 and not (ck % 17 = 0 and program_id = 'prog-1')", ("cand_core",))
def j3(spark, sf):
    return en.exclude_opted_out(fixture(spark, sf, "cand_core"), fixture(spark, sf, "opt_outs")).select("k")


@query(
    "j4_attach_device_tokens",
    "select k, case when ck % 3 = 0 then 0 else ck % 3 + 1 end as device_count, case when ck % 3 = 0 then 'NO_DEVICE_TOKEN' end as device_error from cand_core",
    ("cand_core",),
)
def j4(spark, sf):
    return en.attach_device_tokens(fixture(spark, sf, "cand_core"), fixture(spark, sf, "device_tokens")).select("k", "device_count", "device_error")


@query(
    "j5_attach_voice_ids",
    "select k, case when ck % 4 = 0 then 'voice-' || ck end as voice_user_id, case when ck % 4 <> 0 then 'NO_VOICE_USER_ID' end as voice_error from cand_core",
    ("cand_core",),
)
def j5(spark, sf):
    return en.attach_voice_ids(fixture(spark, sf, "cand_core"), fixture(spark, sf, "voice_ids")).select("k", "voice_user_id", "voice_error")


@query(
    "j6_attach_template",
    "select k, template_id, case when template_id is null then 'NO_TEMPLATE' end as template_error from cand_core left join templates using (program_id)",
    ("cand_core", "templates"),
)
def j6(spark, sf):
    return en.attach_template(fixture(spark, sf, "cand_core"), fixture(spark, sf, "templates")).select("k", "template_id", "template_error")


@query(
    "j7_apply_overrides",
    """select k, coalesce(o_enabled, enabled) as enabled, coalesce(o_schedule, schedule) as schedule, coalesce(o_reactive, reactive) as reactive,
    coalesce(o_ttl_days, ttl_days) as ttl_days, coalesce(o_window_days, window_days) as window_days
    from cand_core c join program_config p using (program_id) left join overrides o on o.program_id = c.program_id and o.marketplace = c.marketplace""",
    ("cand_core", "program_config", "overrides"),
)
def j7(spark, sf):
    fields = ["enabled", "schedule", "reactive", "ttl_days", "window_days"]
    cand = fixture(spark, sf, "cand_core").select("k", "program_id", "marketplace")
    configured = cand.join(fixture(spark, sf, "program_config").select("program_id", *fields), "program_id")
    return en.apply_overrides(configured, fixture(spark, sf, "overrides"), fields).select("k", *fields)


@query(
    "j8_enabled_programs",
    """select k from cand_core where program_id in (select program_id from program_config where enabled)
    and marketplace in (select unnest(string_split(marketplaces, ',')) from program_config p where p.program_id = cand_core.program_id)""",
    ("cand_core", "program_config"),
)
def j8(spark, sf):
    configs = fixture(spark, sf, "program_config").withColumn("marketplaces", F.split("marketplaces", ","))
    listed = en.program_marketplaces(configs).select("program_id", "marketplace")
    rows = en.enabled_programs(fixture(spark, sf, "cand_core"), configs)
    return rows.join(listed, ["program_id", "marketplace"], "left_semi").select("k")


@query(
    "j8_programs_for_marketplace",
    "select k from cand_core where program_id in (select program_id from program_config where list_contains(string_split(marketplaces, ','), 'ASIA'))",
    ("cand_core", "program_config"),
)
def j8b(spark, sf):
    configs = fixture(spark, sf, "program_config").withColumn("marketplaces", F.split("marketplaces", ","))
    return fixture(spark, sf, "cand_core").join(en.programs_for_marketplace(configs, "ASIA"), "program_id", "left_semi").select("k")


@query(
    "j9_lookup_score_cache",
    """select k, c.score_value as cached_value, case when c.score_value is not null then coalesce(c.confidence, 0) end as cached_confidence, c.score_value is not null as cache_hit
    from cand_core left join score_cache c on c.customer_id = cand_core.customer_id and c.subject_id = cand_core.subject_id and c.model_id = 'quality' and c.expires_at >= timestamp '2001-08-02'""",
    ("cand_core", "score_cache"),
)
def j9(spark, sf):
    asked = fixture(spark, sf, "cand_core").withColumn("model_id", F.lit("quality"))
    return en.lookup_score_cache(asked, fixture(spark, sf, "score_cache"), AS_OF_ORDERS).select("k", "cached_value", "cached_confidence", "cache_hit")


@query(
    "j10_attach_features",
    """select k, f.lifetime_value, cast(f.order_count as double) as order_count from cand_core left join features f on f.customer_id = cand_core.customer_id and ck % 5 <> 0""",
    ("cand_core", "features"),
)
def j10(spark, sf):
    long = fixture(spark, sf, "features").filter("cast(substr(customer_id, 6) as bigint) % 5 <> 0").selectExpr(
        "customer_id", "stack(3, 'lifetime_value', lifetime_value, 'order_count', cast(order_count as double), 'avg_order_value', avg_order_value) as (feature, num)"
    )
    out = en.attach_features(fixture(spark, sf, "cand_core"), long, ["lifetime_value", "order_count"])
    return out.select("k", "lifetime_value", "order_count")


@query(
    "j11_point_in_time_features",
    """select k, orders_that_day, last_key from cand_core c asof left join feature_history h on h.customer_id = c.customer_id and h.feature_time <= c.event_date""",
    ("cand_core", "feature_history"),
)
def j11(spark, sf):
    left = fixture(spark, sf, "cand_core").select("k", "customer_id", "event_date")
    return en.point_in_time_features(left, fixture(spark, sf, "feature_history"), "event_date", "feature_time", ["orders_that_day", "last_key"]).drop("customer_id", "event_date")


@query(
    "j12_assign_treatments",
    """with b as (select c_custkey, e.experiment_id, cast(abs(hash_value) % 100 as int) as bucket from (
      select c_custkey, experiment_id, ('0x' || substr(sha256('CUST-' || c_custkey || ':' || experiment_id), 1, 16))::ubigint as u,
        case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616 else u::hugeint end as hash_value
      from customer cross join (select distinct experiment_id from experiment_groups where enabled) e) e),
    g as (select experiment_id, treatment_id, pos, sum(allocation) over (partition by experiment_id order by pos) as hi, max(pos) over (partition by experiment_id) as mp from experiment_groups where enabled)
    select c_custkey, b.experiment_id, coalesce(min_by(treatment_id, pos) filter (where bucket < hi), max_by(treatment_id, pos)) as treatment_id from b join g using (experiment_id) group by all""",
    ("experiment_groups",),
)
def j12(spark, sf):
    customers = fixture(spark, sf, "customer").select("c_custkey", F.concat(F.lit("CUST-"), "c_custkey").alias("customer_id"))
    return ex.assign_treatments(customers, ex.SAMPLE_EXPERIMENTS).select("c_custkey", "experiment_id", "treatment_id")


@query(
    "j13_track_opens",
    """select delivery_id, case when o.opened_at is not null then 'OPENED' else 'SENT' end as tracking_status, strftime(o.opened_at, '%Y-%m-%d %H:%M:%S') as opened_at
    from deliveries left join (select delivery_id as d, min(opened_at) as opened_at from opens group by 1) o on o.d = delivery_id""",
    ("deliveries", "opens"),
)
def j13(spark, sf):
    out = en.track_opens(fixture(spark, sf, "deliveries"), fixture(spark, sf, "opens"))
    return out.select("delivery_id", "tracking_status", iso(F.col("opened_at")).alias("opened_at"))


@query(
    "j14_compare_v1_v2",
    """with a as (select customer_id, subject_id from cand_core where k % 10 <> 3), b as (select customer_id, subject_id from cand_core where k % 10 <> 7 and ck % 50 <> 0),
    j as (select coalesce(a.customer_id, b.customer_id) as customer_id, a.subject_id as sa, b.subject_id as sb from a full join b on a.customer_id = b.customer_id and a.subject_id = b.subject_id)
    select customer_id, count(sa) as v1_count, count(sb) as v2_count, count(*) filter (where sb is null) as only_v1, count(*) filter (where sa is null) as only_v2,
    count(sa) <> count(sb) as count_mismatch, case when count(sa) = 0 then 'v1' when count(sb) = 0 then 'v2' end as missing_customer, count(*) filter (where sb is null or sa is null) = 0 as matches from j group by 1""",
    ("cand_core",),
)
def j14(spark, sf):
    df = fixture(spark, sf, "cand_core")
    return en.compare_v1_v2(df.filter("k % 10 <> 3"), df.filter("k % 10 <> 7 and ck % 50 <> 0"))


ATTR_SQL = """select conversion_id, case when converted_at - sent_at <= interval '7' day then delivery_id end as delivery_id, case when converted_at - sent_at <= interval '7' day then channel end as channel
  from conversions c asof left join deliveries d on d.customer_id = c.customer_id and d.sent_at <= c.converted_at"""


@query("j15_attribute_conversions", ATTR_SQL, ("conversions", "deliveries"))
def j15(spark, sf):
    return en.attribute_conversions(fixture(spark, sf, "conversions"), fixture(spark, sf, "deliveries")).select("conversion_id", "delivery_id", "channel")


@query(
    "j15_channel_share",
    f"select channel, count(*) as conversions, round(count(*) / sum(count(*)) over ()::double, 6) as share from ({ATTR_SQL}) where channel is not null group by channel",
    ("conversions", "deliveries"),
)
def j15_share(spark, sf):
    return en.channel_attribution(en.attribute_conversions(fixture(spark, sf, "conversions"), fixture(spark, sf, "deliveries")))


@query(
    "j16_frequency_window_join",
    """with s as (select customer_id, @EPOCH{sent_at} as sec from deliveries), c as (select event_id, customer_id, @EPOCH{event_date} as sec from customer_event)
    select event_id, count(s.sec) as recent_sends from c left join s on s.customer_id = c.customer_id and s.sec >= c.sec - 259200 and s.sec < c.sec group by event_id""",
    ("deliveries", "customer_event"),
)
def j16(spark, sf):
    cand = fixture(spark, sf, "customer_event").select("event_id", "customer_id", "event_date")
    sends = fixture(spark, sf, "deliveries").select("customer_id", "sent_at")
    return ve.frequency_window_counts(cand, sends, ["customer_id"], "event_date", "sent_at", 3 * 86400).select("event_id", "recent_sends")


@query("j17_batch_get", "select k from cand_core where k % 9 = 0", ("cand_core",))
def j17(spark, sf):
    on = ["customer_id", "program_id", "marketplace", "subject_type", "subject_id"]
    df = fixture(spark, sf, "cand_core")
    return en.batch_get(df, df.filter("k % 9 = 0").select(*on), on).select("k")


@query(
    "j18_join_customer_context",
    """select k, (select sum(engagements) from customer_context x where x.customer_id = c.customer_id)::bigint as history_total,
    coalesce((select engagements from customer_context x where x.customer_id = c.customer_id and x.subject_type = c.subject_type), 0) as same_type, cast(ck % 10 as double) / 10 as channel_pref from cand_core c""",
    ("cand_core", "customer_context"),
)
def j18(spark, sf):
    out = en.join_customer_context(fixture(spark, sf, "cand_core"), fixture(spark, sf, "customer_context"))
    return out.select("k", "history_total", F.coalesce(F.element_at("history", F.col("subject_type")), F.lit(0)).alias("same_type"), "channel_pref")


@query(
    "j19_reconcile_sources",
    """select coalesce(a.p_partkey, b.p_partkey) as p_partkey, concat_ws(',', case when a.p_partkey is not null and b.p_partkey is not null and a.p_size is distinct from b.p_size then 'p_size' end,
    case when a.p_partkey is not null and b.p_partkey is not null and a.p_retailprice is distinct from b.p_retailprice then 'p_retailprice' end) as changed,
    case when b.p_partkey is null then 'missing' when a.p_partkey is null then 'extra' when a.p_size is distinct from b.p_size or a.p_retailprice is distinct from b.p_retailprice then 'changed' else 'same' end as status
    from stock a full join stock_shadow b on a.p_partkey = b.p_partkey""",
    ("stock", "stock_shadow"),
)
def j19(spark, sf):
    out = en.reconcile_sources(fixture(spark, sf, "stock"), fixture(spark, sf, "stock_shadow"), ["p_partkey"], ["p_name", "p_size", "p_retailprice"])
    return out.withColumn("changed", F.array_join("changed", ","))


@query(
    "j19_split_traffic",
    """select p_partkey, case when ('0x' || substr(md5('migration|' || p_partkey), 1, 8))::bigint % 10000 < 5000 then 'new' else 'old' end as route from stock""",
    ("stock",),
)
def j19_split(spark, sf):
    return en.split_traffic(fixture(spark, sf, "stock"), ["p_partkey"]).select("p_partkey", "route")


@query(
    "j20_attach_country_settings",
    """select k, coalesce(sender_id, 'CEN') as sender_id, coalesce(max_price, 0.03e0) as max_price from cand_core join clients using (program_id) left join country_settings using (country)""",
    ("cand_core", "clients", "country_settings"),
)
def j20(spark, sf):
    df = fixture(spark, sf, "cand_core").join(fixture(spark, sf, "clients").select("program_id", "country"), "program_id")
    return en.attach_country_settings(df, fixture(spark, sf, "country_settings"), {"sender_id": "CEN", "max_price": 0.03}).select("k", "sender_id", "max_price")


@query(
    "u1_union_attempts",
    "select delivery_id, status, error_code from deliveries",
    ("deliveries",),
)
def u1(spark, sf):
    d = fixture(spark, sf, "deliveries")
    delivered = d.filter("status = 'delivered'").select("delivery_id", "status")
    return en.union_attempts(delivered, d.filter("status = 'failed'").select("delivery_id", "status", "error_code"))


@query("u2_only_in_v1", "select customer_id, subject_id from cand_core where k % 10 = 7", ("cand_core",))
def u2(spark, sf):
    df = fixture(spark, sf, "cand_core")
    pick = lambda cond: df.filter(cond).select("customer_id", "subject_id")
    return en.only_in_first(pick("k % 10 <> 3"), pick("k % 10 <> 7"))


@query(
    "u3_common_customers",
    "select customer_id from cand_core where k % 3 = 0 intersect select customer_id from cand_core where k % 5 = 0",
    ("cand_core",),
)
def u3(spark, sf):
    df = fixture(spark, sf, "cand_core")
    return en.in_both(df.filter("k % 3 = 0").select("customer_id"), df.filter("k % 5 = 0").select("customer_id"))


@query(
    "u4_union_connectors",
    """select 'order' as source, customer_id, order_value, cast(null as string) as event_type from cand_core
    union all select 'event', customer_id, cast(null as double), event_type from customer_event""",
    ("cand_core", "customer_event"),
)
def u4(spark, sf):
    a = fixture(spark, sf, "cand_core").select(F.lit("order").alias("source"), "customer_id", "order_value")
    b = fixture(spark, sf, "customer_event").select(F.lit("event").alias("source"), "customer_id", "event_type")
    return en.union_connectors([a, b])
