"""Queries for S1-S13."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.plans.fixtures import AS_OF_EVENTS, fixture
from beckon.plans.registry import query
from beckon.sources import events as ev
from beckon.sources import stages
from beckon.sources import warehouse as wh

SCAN_SQL = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= '{startDate}' AND o_orderdate < '{endDate}' AND o_orderstatus = '{status}'"


@query(
    "s1_warehouse_scan",
    """select o_orderkey, o_custkey, o_totalprice from orders
    where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-04-01' and o_orderstatus = 'F'""",
)
def s1(spark, sf):
    params = {"startDate": dt.datetime(1998, 1, 1), "endDate": dt.datetime(1998, 4, 1), "status": "F"}
    return wh.warehouse_scan(spark, SCAN_SQL, params, {"orders": fixture(spark, sf, "orders")})


@query(
    "s1_scan_literals",
    """select o_orderkey, 'a {status} b' as note from orders where strftime(o_orderdate, '%Y-%m') like '1997-1%' and o_orderpriority like '2-%' and o_comment_text <> '1997 {x}'""".replace("o_comment_text", "'-'"),
)
def s1_literals(spark, sf):
    text = """select o_orderkey, 'a ' || '{open}' || 'status} b' as note /* {not_a_parameter} */ from orders
    where date_format(o_orderdate, 'yyyy-MM') like '{year}-1%' and o_orderpriority like '{level}-%' -- {nor_this}"""
    return wh.warehouse_scan(spark, text, {"year": 1997, "level": "2", "open": "{"}, {"orders": fixture(spark, sf, "orders")})


@query(
    "s2_stringify_rows",
    """select cast(k as string) k, customer_id, order_value_text, cast(email as string) email, cast(version as string) as version from
    (select *, cast(order_value as string) order_value_text from cand_core)""",
    ("cand_core",),
)
def s2(spark, sf):
    df = fixture(spark, sf, "cand_core").select("k", "customer_id", F.col("order_value").alias("order_value_text"), "email", "version")
    return wh.stringify_rows(df)


@query(
    "s3_review_source",
    """select k, customer_id, subject_id, 'product' as subject_kind, 'reviews' as program_name, case when email then 1 else 0 end as email_opt_in
    from cand c where delivery_date is not null and delivery_date < timestamp '2001-08-02'
    and not exists (select 1 from (select 'CUST-' || o_custkey cu, 'ORD-' || o_orderkey su from orders where o_orderkey % 6 = 0) d where d.cu = c.customer_id and d.su = c.subject_id)""",
    ("cand",),
)
def s3(spark, sf):
    done = fixture(spark, sf, "orders").filter("o_orderkey % 6 = 0").select(
        F.concat(F.lit("CUST-"), "o_custkey").alias("customer_id"), F.concat(F.lit("ORD-"), "o_orderkey").alias("subject_id")
    )
    out = wh.program_source(
        fixture(spark, sf, "cand"),
        F.col("delivery_date").isNotNull() & (F.col("delivery_date") < F.lit("2001-08-02").cast("timestamp")),
        {"subject_kind": "product", "program_name": "reviews"},
        {"email_opt_in": F.when(F.col("email"), 1).otherwise(0)},
        done,
        ["customer_id", "subject_id"],
    )
    return out.select("k", "customer_id", "subject_id", "subject_kind", "program_name", "email_opt_in")


@query(
    "s4_video_source",
    """select event_id, customer_id, subject_id, 'video' as subject_kind, 'video-ratings' as program_name
    from customer_event where event_type = 'view' and value / 100.0e0 >= 0.8e0""",
    ("customer_event",),
)
def s4_video(spark, sf):
    out = wh.program_source(
        fixture(spark, sf, "customer_event"),
        (F.col("event_type") == "view") & (F.col("value") / 100.0 >= 0.8),
        {"subject_kind": "video", "program_name": "video-ratings"},
        {},
    )
    return out.select("event_id", "customer_id", "subject_id", "subject_kind", "program_name")


@query(
    "s4_service_source",
    """select event_id, customer_id, subject_id, 'service' as subject_kind, 'service-survey' as program_name, value > 50 as priority_flag
    from customer_event where event_type = 'click'""",
    ("customer_event",),
)
def s4_service(spark, sf):
    out = wh.program_source(
        fixture(spark, sf, "customer_event"),
        F.col("event_type") == "click",
        {"subject_kind": "service", "program_name": "service-survey"},
        {"priority_flag": F.col("value") > 50},
    )
    return out.select("event_id", "customer_id", "subject_id", "subject_kind", "program_name", "priority_flag")


@query(
    "s6_stamp_provenance",
    """select k, customer_id, '2001-08-02 00:00:00' as processed_at, 'etl-job' as job_name, 'exec-9' as execution_id, 'etl' as stage from cand_core""",
    ("cand_core",),
)
def s6(spark, sf):
    df = fixture(spark, sf, "cand_core").select("k", "customer_id")
    return wh.stamp_provenance(df, "etl-job", "exec-9", "etl", "2001-08-02 00:00:00").withColumn("processed_at", iso(F.col("processed_at")))


_EVENT_FIELDS = """select event_id,
    case when event_id % 31 = 0 then null else 'CUST-' || user_id end as customer_id, event_type,
    case when event_id % 37 = 0 then null else 'S-' || (event_id % 20) end as subject_id, 'prog-' || (1 + event_id % 5) as program_id,
    strftime(case when event_id % 3 = 0 then timestamp '2024-01-31' else ts end, '%Y-%m-%d %H:%M:%S') as event_date,
    case when event_id % 4 = 0 then null else cast(value as string) end as order_value,
    case when event_id % 31 = 0 then 'customerId is missing' when event_id % 37 = 0 then 'subjectId is missing' end as parse_error
    from events"""


@query("s7_parse_customer_events", _EVENT_FIELDS)
def s7(spark, sf):
    out = ev.parse_customer_events(fixture(spark, sf, "event_json").drop("ts"), as_of=AS_OF_EVENTS)
    return out.select(
        "event_id", F.col("customerId").alias("customer_id"), F.col("eventType").alias("event_type"), F.col("subjectId").alias("subject_id"),
        F.col("programId").alias("program_id"), iso(F.col("eventDate")).alias("event_date"), F.col("metadata")["orderValue"].alias("order_value"), "parse_error",
    )


@query(
    "s8_parse_opt_out_events",
    """select event_id, case when event_id % 31 = 0 then null else 'CUST-' || user_id end as customer_id, event_type, 'prog-' || (1 + event_id % 5) as program_id,
    case when event_id % 31 = 0 then 'customerId is missing' end as parse_error from events""",
)
def s8(spark, sf):
    out = ev.parse_opt_out_events(fixture(spark, sf, "event_json").drop("ts"), as_of=AS_OF_EVENTS)
    return out.select(
        "event_id", F.col("customerId").alias("customer_id"), F.col("eventType").alias("event_type"), F.col("programId").alias("program_id"), "parse_error"
    )


_ROUTED = """(select event_id, event_type, value,
    case event_id % 3 when 0 then 'orders' when 1 then 'video' else 'shop' end as source,
    case event_id % 4 when 0 then 'CONFIRMED' when 1 then 'UPCOMING' when 2 then 'FAILED' else 'NEW' end as state,
    case event_id % 5 when 0 then 'Electronics' when 1 then 'Computers' else 'Books' end as category from events)"""


def route_rules():
    return [
        {"id": "order-confirmed", "where": ev.event_pattern("orders", "purchase", {"state": ["CONFIRMED"]})},
        {"id": "renewal", "where": ev.event_pattern("video", None, {"state": ["UPCOMING", "FAILED"]})},
        {"id": "long-view", "where": ev.event_pattern(None, "view", {"category": ["Electronics", "Computers"]}, {"value": 30})},
        {"id": "cart", "where": ev.event_pattern("shop", "click", None, {"value": 50})},
    ]


def routed_input(spark, sf):
    return fixture(spark, sf, "events").selectExpr(
        "event_id", "ts", "event_type", "value",
        "case event_id % 3 when 0 then 'orders' when 1 then 'video' else 'shop' end as source",
        "case event_id % 4 when 0 then 'CONFIRMED' when 1 then 'UPCOMING' when 2 then 'FAILED' else 'NEW' end as state",
        "case event_id % 5 when 0 then 'Electronics' when 1 then 'Computers' else 'Books' end as category",
    )


@query(
    "s9_route_events",
    f"""select event_id, 'order-confirmed' as rule_id from {_ROUTED} where source = 'orders' and event_type = 'purchase' and state = 'CONFIRMED'
    union all select event_id, 'renewal' from {_ROUTED} where source = 'video' and state in ('UPCOMING', 'FAILED')
    union all select event_id, 'long-view' from {_ROUTED} where event_type = 'view' and category in ('Electronics', 'Computers') and value >= 30
    union all select event_id, 'cart' from {_ROUTED} where source = 'shop' and event_type = 'click' and value >= 50""",
)
def s9(spark, sf):
    return ev.route_events(routed_input(spark, sf), route_rules()).select("event_id", "rule_id")


@query(
    "s10_export_day",
    """select k, program_id as program, '1998-06-10' as date from cand_core where program_id = 'prog-2' and
    ((created_at >= timestamp '1998-06-10' and created_at < timestamp '1998-06-11') or (updated_at >= timestamp '1998-06-10' and updated_at < timestamp '1998-06-11'))""",
    ("cand_core",),
)
def s10(spark, sf):
    df = fixture(spark, sf, "cand_core")
    return wh.export_day(df, "prog-2", "1998-06-10", F.col("program_id"), F.col("created_at"), F.col("updated_at")).select("k", "program", "date")


@query(
    "s11_parse_program_configs",
    """select 'prog-' || c_custkey as program_id, c_mktsegment as program_name, c_custkey % 2 = 0 as enabled, cast(2 as bigint) as n_marketplaces,
    cast(c_custkey % 60 as bigint) as ttl_days from customer where c_custkey % 10 <> 0""",
)
def s11(spark, sf):
    text = fixture(spark, sf, "customer").selectExpr(
        """case when c_custkey % 10 = 0 then '{"programId": ' else concat('{"programId": "prog-', c_custkey, '", "programName": "', c_mktsegment,
        '", "enabled": ', c_custkey % 2 = 0, ', "marketplaces": ["US", "UK"], "candidateTTLDays": ', c_custkey % 60, '}') end as value"""
    )
    return stages.parse_program_configs(text).select(
        F.col("programId").alias("program_id"), F.col("programName").alias("program_name"), "enabled",
        F.size("marketplaces").cast("bigint").alias("n_marketplaces"), F.col("candidateTTLDays").cast("bigint").alias("ttl_days"),
    )


@query(
    "s12_paged_extract",
    """select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 500 as bigint) as page_no from orders""",
)
def s12(spark, sf):
    df = fixture(spark, sf, "orders").select("o_orderkey")
    return wh.paged_extract(df, "o_orderkey", 500).select("o_orderkey", "page_no")


@query(
    "s13_sms_keyword_opt_outs",
    """with keyed as (select customer_id, received_at, turn, upper(trim(body)) as keyword from sms_messages where upper(trim(body)) in ('STOP','UNSUBSCRIBE','CANCEL','END','QUIT','START')),
    last as (select *, row_number() over (partition by customer_id order by received_at desc, turn desc) rn from keyed)
    select customer_id, keyword, strftime(received_at, '%Y-%m-%d %H:%M:%S') as opted_out_at from last where rn = 1 and keyword <> 'START'""",
    ("sms_messages",),
)
def s13(spark, sf):
    out = ev.sms_keyword_opt_outs(fixture(spark, sf, "sms_messages"))
    return out.withColumn("opted_out_at", iso(F.col("opted_out_at")))
