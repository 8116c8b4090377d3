"""Queries for P1-P17."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import convert_type, iso, parse_instant
from beckon.operators import mapping as mp
from beckon.plans.fixtures import AS_OF_EVENTS, AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query
from beckon.sources.events import parse_customer_events

MAPPING = {
    "customerId": {"sourceField": "cust_id", "type": "STRING", "required": True},
    "subjectType": {"sourceField": "prod_type", "type": "STRING", "required": True},
    "subjectId": {"sourceField": "prod_id", "type": "STRING", "required": True},
    "eventDate": {"sourceField": "event_text", "type": "INSTANT", "required": True},
    "deliveryDate": {"sourceField": "delivered_at", "type": "INSTANT"},
    "orderValue": {"sourceField": "amount", "type": "DOUBLE", "defaultValue": 0.0},
    "emailEligible": {"sourceField": "email_ok", "type": "BOOLEAN"},
    "smsEligible": {"sourceField": "sms_ok", "type": "BOOLEAN"},
    "mediaEligible": {"sourceField": "media_text", "type": "BOOLEAN"},
    "ttlDays": {"sourceField": "ttl_text", "type": "INTEGER"},
    "workflowExecutionId": "exec_id",
    "marketplace": "mkt",
    "programId": "prog",
    "tier": "nested.customer.profile.tier",
    "kind": {"constant": "product"},
}

# what the source text means, per row, in the oracle's words
EVENT_OK = "(k % 31 not in (0, 1, 2, 3, 6))"
EVENT_TS = "(case when k % 31 in (0, 1, 2, 3, 6) then null when k % 31 = 5 then event_date - interval '2' hour else event_date end)"


@query(
    "p1_map_fields",
    f"""select r.k, cust_id as customer, case when r.k % 5 = 0 then null else 'T' || (r.k % 3) end as tier, 'product' as kind,
    strftime({EVENT_TS.replace('k %', 'r.k %')}, '%Y-%m-%d %H:%M:%S') as event_date, cast(null as string) as absent
    from raw_rows r join cand c on c.k = r.k""",
    ("raw_rows",),
)
def p1(spark, sf):
    m = {"customer": "cust_id", "tier": "nested.customer.profile.tier", "kind": {"constant": "product"}, "absent": "nested.customer.address.city",
         "event_date": {"sourceField": "event_text", "type": "INSTANT"}}
    out = mp.map_fields(fixture(spark, sf, "raw_rows"), m)
    return out.select("k", "mapped.customer", "mapped.tier", "mapped.kind", iso(F.col("mapped.event_date")).alias("event_date"), "mapped.absent")


@query(
    "p2_convert_type",
    """select k, case when k % 43 = 0 then null else order_value end as as_double, cast(k % 50 + 10 as bigint) as as_long, cast(floor(k / 2.0) as bigint) as as_integer,
    case when k % 6 = 3 then null else k % 6 in (0, 2) end as as_boolean, k % 4 <> 0 as number_boolean,
    case k % 4 when 0 then 'a|b|c' when 1 then 'solo' when 2 then null else 'x|y' end as as_list, cast(k as string) as as_string
    from cand_core""",
    ("cand_core",),
)
def p2(spark, sf):
    df = fixture(spark, sf, "raw_rows").withColumn("half", F.col("k") / 2.0).withColumn("mod4", F.col("k") % 4)
    num, dbl = df.schema["k"].dataType, df.schema["half"].dataType
    return df.select(
        "k",
        convert_type(F.col("amount"), "DOUBLE").alias("as_double"),
        convert_type((F.col("k") % 50 + 10).cast("string"), "LONG").alias("as_long"),
        convert_type(F.col("half"), "INTEGER", dbl).cast("bigint").alias("as_integer"),
        convert_type(F.col("email_ok"), "BOOLEAN").alias("as_boolean"),
        convert_type(F.col("mod4"), "BOOLEAN", num).alias("number_boolean"),
        F.array_join(convert_type(F.col("tags"), "LIST"), "|").alias("as_list"),
        convert_type(F.col("k"), "STRING", num).alias("as_string"),
    )


@query(
    "p3_required_and_default",
    f"""select k, case when k % 43 = 0 or order_value is null then -1.0e0 else order_value end as order_value,
    concat_ws('; ', case when k % 29 = 1 then 'customerId: no usable value' end,
      case when not {EVENT_OK} then 'eventDate: no usable value' end) as errors from cand_core""",
    ("cand_core",),
)
def p3(spark, sf):
    m = {"customerId": MAPPING["customerId"], "eventDate": MAPPING["eventDate"], "orderValue": {"sourceField": "amount", "type": "DOUBLE", "defaultValue": -1.0}}
    out = mp.map_fields(fixture(spark, sf, "raw_rows"), m)
    return out.select("k", F.col("mapped.orderValue").alias("order_value"), F.array_join("mapping_errors", "; ").alias("errors"))


@query(
    "p4_parse_instant",
    f"select k, strftime({EVENT_TS}, '%Y-%m-%d %H:%M:%S') as parsed from cand_core",
    ("cand_core",),
)
def p4(spark, sf):
    return fixture(spark, sf, "raw_rows").select("k", iso(parse_instant(F.col("event_text"))).alias("parsed"))


@query("p5_constant_mapping", "select k, 'product' as subject_type, prod_id as subject_id from raw_rows", ("raw_rows",))
def p5(spark, sf):
    m = {"subject_type": {"constant": "product"}, "subject_id": "prod_id"}
    return mp.map_fields(fixture(spark, sf, "raw_rows"), m).select("k", "mapped.subject_type", "mapped.subject_id")


@query(
    "p6_computed_fields",
    """select event_id, round(value / 100.0e0, 6) as scaled, case when value > 100 then 'premium' when value > 50 then 'standard' else 'basic' end as tier,
    case when hour(event_date) < 6 then 'night' when hour(event_date) < 12 then 'morning' when hour(event_date) < 18 then 'afternoon' else 'evening' end as day_part,
    strftime(event_date + interval '7' day, '%Y-%m-%d') as follow_up from customer_event""",
    ("customer_event",),
)
def p6(spark, sf):
    exprs = {
        "scaled": "round(value / 100.0D, 6)",
        "tier": "case when value > 100 then 'premium' when value > 50 then 'standard' else 'basic' end",
        "day_part": "case when hour(event_date) < 6 then 'night' when hour(event_date) < 12 then 'morning' when hour(event_date) < 18 then 'afternoon' else 'evening' end",
        "follow_up": "date_format(event_date + interval '7' day, 'yyyy-MM-dd')",
    }
    return mp.computed_fields(fixture(spark, sf, "customer_event"), exprs).select("event_id", *exprs)


@query(
    "p7_normalize",
    """select c_custkey, upper(c_mktsegment) as segment, lower(c_name) || '@mail.test' as email, '+1555' || lpad(cast(c_custkey % 10000000 as string), 7, '0') as phone,
    '1999-02-03 00:00:00' as joined from customer""",
)
def p7(spark, sf):
    df = fixture(spark, sf, "customer").selectExpr(
        "c_custkey", "concat(' ', lower(c_mktsegment), ' ') as segment", "concat(' ', c_name, '@Mail.Test ') as email",
        "concat('(555) ', substr(lpad(c_custkey % 10000000, 7, '0'), 1, 3), '-', substr(lpad(c_custkey % 10000000, 7, '0'), 4)) as phone", "'03/02/1999' as joined",
    )
    out = mp.normalize(df, {"segment": ["trim", "upper"], "email": "email", "phone": "phone", "joined": ["date:dd/MM/yyyy", "utc"]})
    return out.withColumn("joined", iso(F.col("joined")))


@query(
    "p8_build_context",
    """select k, cast(pos as bigint) as pos, type, id from (
      select k, row_number() over (partition by k order by o) - 1 as pos, type, id from (
        select k, 0 as o, 'marketplace' as type, mkt as id from raw_rows union all select k, 1, 'program', prog from raw_rows
        union all select k, 2, 'vertical', prod_type from raw_rows union all select k, 3, 'region', exec_id from raw_rows) where id is not null)""",
    ("raw_rows",),
)
def p8(spark, sf):
    extra = F.array(
        F.struct(F.lit("region").alias("type"), F.col("exec_id").alias("id")), F.struct(F.lit(None).cast("string").alias("type"), F.lit("x").alias("id"))
    )
    ctx = mp.build_context(F.col("mkt"), F.col("prog"), F.col("prod_type"), extra)
    return fixture(spark, sf, "raw_rows").select("k", F.posexplode(ctx).alias("pos", "c")).select("k", F.col("pos").cast("bigint").alias("pos"), "c.type", "c.id")


@query(
    "p9_build_channel_eligibility",
    """select k, 'email' as channel, lower(email_ok) = 'true' as eligible from raw_rows where email_ok is not null
    union all select k, 'sms', lower(sms_ok) = 'true' from raw_rows where sms_ok is not null
    union all select k, 'email', true from raw_rows where email_ok is null and sms_ok is null""",
    ("raw_rows",),
)
def p9(spark, sf):
    flags = {"email": convert_type(F.col("email_ok"), "BOOLEAN"), "sms": convert_type(F.col("sms_ok"), "BOOLEAN")}
    return fixture(spark, sf, "raw_rows").select("k", F.explode(mp.build_channel_eligibility(flags)).alias("channel", "eligible"))


@query(
    "p10_attributes_and_metadata",
    """select r.k, strftime(c.delivery_date, '%Y-%m-%d') as delivery_date, false as consumed,
    strftime(timestamp '2001-08-02' + interval '1' day * cast(coalesce(cast(ttl_text as int), 30) as int), '%Y-%m-%d %H:%M:%S') as expires_at,
    cast(1 as bigint) as version, coalesce(exec_id, 'unknown') as execution_id from raw_rows r join cand c on c.k = r.k""",
    ("raw_rows",),
)
def p10(spark, sf):
    attrs = mp.build_attributes(F.lit(AS_OF_ORDERS).cast("timestamp"), F.col("delivery_date"))
    meta = mp.build_metadata(AS_OF_ORDERS, "warehouse", F.col("ttl_text").try_cast("int"), F.col("exec_id"))
    raw = fixture(spark, sf, "raw_rows").select("k", "ttl_text", "exec_id")
    df = raw.join(fixture(spark, sf, "cand").select("k", "delivery_date"), "k")
    df = df.select("k", attrs.alias("a"), meta.alias("m"))
    return df.select(
        "k", F.date_format("a.delivery_date", "yyyy-MM-dd").alias("delivery_date"), "a.consumed", iso(F.col("m.expires_at")).alias("expires_at"), "m.version",
        F.col("m.workflow_execution_id").alias("execution_id"),
    )


_P11_BAD = f"(r.k % 29 = 1 or r.k % 37 = 0 or not {EVENT_OK.replace('k %', 'r.k %')} or (mkt is null and prog is null))"


@query(
    "p11_to_candidates",
    f"""select r.k, cust_id as customer_id, prod_type as subject_type, prod_id as subject_id, coalesce(mkt, '-') as marketplace,
    case when r.k % 43 = 0 or order_value is null then 0.0e0 else order_value end as order_value
    from raw_rows r join cand c on c.k = r.k where not {_P11_BAD}""",
    ("raw_rows",),
)
def p11(spark, sf):
    good = mp.good_candidates(mp.to_candidates(fixture(spark, sf, "raw_rows"), MAPPING, AS_OF_ORDERS))
    return good.select(
        "k", "customer_id", F.col("subject.type").alias("subject_type"), F.col("subject.id").alias("subject_id"),
        F.coalesce(mp.context_id("marketplace"), F.lit("-")).alias("marketplace"), F.col("attributes.order_value").alias("order_value"),
    )


@query(
    "p11_bad_rows",
    f"select r.k from raw_rows r where {_P11_BAD}",
    ("raw_rows",),
)
def p11_bad(spark, sf):
    return mp.bad_rows(mp.to_candidates(fixture(spark, sf, "raw_rows"), MAPPING, AS_OF_ORDERS)).select("k")


@query(
    "p12_candidates_from_events",
    """select event_id, 'CUST-' || user_id as customer_id, 'US' as marketplace, 'prog-' || (1 + event_id % 5) as program_id, 'S-' || (event_id % 20) as subject_id,
    case when event_id % 4 = 0 then null else value end as order_value, 3 as n_channels, 'reactive-workflow' as source, '2024-03-01 00:00:00' as expires_at
    from events where event_id % 31 <> 0 and event_id % 37 <> 0""",
)
def p12(spark, sf):
    parsed = parse_customer_events(fixture(spark, sf, "event_json").drop("ts"), as_of=AS_OF_EVENTS).filter("parse_error is null").drop("parse_error")
    out = mp.candidates_from_events(parsed, AS_OF_EVENTS)
    return out.select(
        "event_id", "customer_id", mp.context_id("marketplace").alias("marketplace"), mp.context_id("program").alias("program_id"), F.col("subject.id").alias("subject_id"),
        F.col("attributes.order_value").alias("order_value"), F.size("attributes.channel_eligibility").alias("n_channels"),
        F.col("metadata.source_connector_id").alias("source"), iso(F.col("metadata.expires_at")).alias("expires_at"),
    )


@query(
    "p13_storage_keys",
    """select k, 'CUSTOMER#' || customer_id || '#PROGRAM#' || program_id || '#MARKETPLACE#' || marketplace as pk, 'SUBJECT#' || subject_type || '#' || subject_id as sk,
    'PROGRAM#' || program_id || '#CHANNEL#' || case when email then 'email' when in_app then 'in-app' when push then 'push' when sms then 'sms' else 'none' end as gsi1_pk,
    'SCORE#' || printf('%.6f', coalesce(quality, 0)) || '#CUSTOMER#' || customer_id as gsi1_sk,
    'PROGRAM#' || program_id || '#DATE#' || strftime(created_at, '%Y-%m-%d') as gsi2_pk,
    'CREATED#' || @EPOCH{created_at} || '#CUSTOMER#' || customer_id as gsi2_sk, cast(@EPOCH{expires_at} as bigint) as ttl
    from cand_core""",
    ("cand_core",),
)
def p13(spark, sf):
    out = mp.storage_keys(candidates(spark, sf, delivery=False), "quality")
    return out.filter("key_error is null").select("k", "pk", "sk", "gsi1_pk", "gsi1_sk", "gsi2_pk", "gsi2_sk", "ttl")


@query(
    "p14_to_legacy_v1",
    """select customer_id, subject_type, subject_id, program_id as program, marketplace, quality as score, strftime(event_date, '%Y-%m-%dT%H:%M:%SZ') as event_date,
    strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at, strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') as expires_at from cand_core""",
    ("cand_core",),
)
def p14(spark, sf):
    return mp.to_legacy_v1(candidates(spark, sf, delivery=False), "quality")


@query(
    "p15_translate_v1_requests",
    "select request_id, customer_id, channel, program_id, marketplace, max_results, true as include_scores, false as refresh_eligibility from requests",
    ("requests",),
)
def p15(spark, sf):
    return mp.translate_v1_requests(fixture(spark, sf, "requests"))


@query(
    "p16_strip_scores",
    "select k, k % 2 = 0 as wanted, case when k % 2 = 0 then quality end as quality, k % 2 <> 0 as stripped from cand_core",
    ("cand_core",),
)
def p16(spark, sf):
    df = candidates(spark, sf, delivery=False).withColumn("wanted", F.col("k") % 2 == 0)
    return mp.strip_scores(df, "wanted").select("k", "wanted", mp.score_value("quality").alias("quality"), F.col("scores").isNull().alias("stripped"))


@query("p17_score_cache_key", "select k, customer_id || '#' || subject_id || '#quality' as cache_key from cand_core", ("cand_core",))
def p17(spark, sf):
    key = mp.score_cache_key(F.col("customer_id"), F.col("subject_id"), F.lit("quality"))
    return fixture(spark, sf, "cand_core").select("k", key.alias("cache_key"))
