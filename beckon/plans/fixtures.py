"""Engine tables derived from the given Parquet tables, as SQL both engines run.

Each fixture is one SELECT over base tables and other fixtures.  Spark reads it
through temporary views; the oracle gets the same text as CTEs.  The few spots
where the dialects differ are written as ``@NAME{..}`` macros.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon.schema import CANDIDATE, ddl
from beckon.sources.tables import TABLES, table

AS_OF_ORDERS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

# macro -> (Spark text, DuckDB text); {0} is the argument
MACROS = {
    "EPOCH": ("unix_seconds({0})", "(epoch_us({0}) // 1000000)"),
    "MILLIS": ("unix_millis({0})", "(epoch_us({0}) // 1000)"),
    "ISO": ("date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime({0}, '%Y-%m-%dT%H:%M:%S')"),
    "JSONSTR": ("get_json_object({0}, '$.k')", "json_extract_string({0}, '$.k')"),
    "UPTO": ("explode(sequence(0, {0}))", "unnest(range(0, {0} + 1))"),
    "SEC": ("date_trunc('SECOND', {0})", "date_trunc('second', {0})"),
}

CAND_CORE = """
select 'CUST-' || o_custkey as customer_id, o_orderkey as k, o_custkey as ck,
  case o_orderkey % 5 when 0 then 'product' when 1 then 'video' when 2 then 'service' when 3 then 'event' else 'track' end as subject_type,
  'ORD-' || o_orderkey as subject_id,
  'prog-' || substr(o_orderpriority, 1, 1) as program_id,
  r_name as marketplace,
  o_orderdate as event_date,
  case when o_orderkey % 19 = 0 then null else o_totalprice end as order_value,
  case when o_orderkey % 7 = 0 then null else '7-14 days' end as timing_window,
  case when o_orderkey % 23 = 0 then null else o_orderkey % 3 = 0 end as media_eligible,
  o_orderkey % 2 = 0 as email, o_orderkey % 3 <> 1 as in_app, o_orderkey % 5 <> 0 as push, c_mktsegment = 'BUILDING' as sms,
  case when o_orderkey % 11 = 0 then null else cast((o_orderkey * 37) % 1000 as double) / 1000 end as trust,
  case when o_orderkey % 2 = 1 then null else cast((o_orderkey * 97) % 1000 as double) / 1000 end as fraud,
  case when o_orderkey % 13 = 0 then null else cast((o_orderkey * 53) % 1000 as double) / 1000 end as quality,
  case when o_orderkey % 17 = 0 then null else cast((o_orderkey * 71) % 1000 as double) / 1000 end as quality_conf,
  o_orderdate + interval '1' day as created_at,
  o_orderdate + interval '1' day * (1 + cast(o_orderkey % 10 as int)) as updated_at,
  o_orderdate + interval '31' day as expires_at,
  1 + o_orderkey % 3 as version
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "cand_core": ((), CAND_CORE),
    "cand": (
        ("cand_core",),
        """
select cand_core.*, delivery_date from cand_core
left join (select l_orderkey, max(l_shipdate) as delivery_date from lineitem group by l_orderkey) ship on l_orderkey = k
""",
    ),
    "raw_rows": (
        ("cand",),
        """
select k,
  case when k % 29 = 0 then '  ' when k % 29 = 1 then null else customer_id end as cust_id,
  case when k % 53 = 0 then '' else subject_type end as prod_type,
  case when k % 37 = 0 then null else subject_id end as prod_id,
  case when k % 41 = 0 then null else marketplace end as mkt,
  case when k % 41 <= 1 then null else program_id end as prog,
  case k % 31 when 0 then 'not-a-date' when 1 then '2024-13-45' when 2 then null when 3 then @ISO{event_date}
    when 4 then cast(@MILLIS{event_date} as string) when 5 then @ISO{event_date} || '+02:00'
    when 6 then substr(@ISO{event_date}, 1, 10) else @ISO{event_date} || 'Z' end as event_text,
  case when k % 47 = 0 then '12345abc' else @ISO{delivery_date} || 'Z' end as delivered_at,
  case when k % 43 = 0 then 'abc' else cast(order_value as string) end as amount,
  case k % 6 when 0 then 'TRUE' when 1 then 'yes' when 2 then 'true' when 3 then null else 'false' end as email_ok,
  case when k % 8 = 0 then cast(sms as string) else null end as sms_ok,
  case when k % 23 = 0 then null else cast(media_eligible as string) end as media_text,
  case when k % 9 = 0 then null else cast(10 + k % 50 as string) end as ttl_text,
  case when k % 10 = 0 then null else 'exec-' || (k % 4) end as exec_id,
  case k % 4 when 0 then 'a, b ,c' when 1 then 'solo' when 2 then null else ' x,y' end as tags,
  '{"customer": {"profile": ' || case when k % 5 = 0 then 'null' else '{"tier": "T' || (k % 3) || '"}' end || '}}' as nested
from cand
""",
    ),
    "raw_json": (
        ("cand_core",),
        """
select k,
  '{' || case k % 29 when 0 then '' when 1 then '"customerId": null, ' when 2 then '"customerId": " ", ' when 3 then '"customerId": 77, ' else '"customerId": "' || customer_id || '", ' end ||
  '"subjectType": "' || subject_type || '", ' || case when k % 37 = 0 then '' else '"subjectId": "' || subject_id || '", ' end ||
  '"eventDate": ' || case k % 31 when 0 then '"not-a-date"' when 1 then '"2024-13-45"' when 2 then '-5' when 3 then '"' || @ISO{event_date} || '"'
    when 4 then cast(@MILLIS{event_date} as string) when 5 then '"' || substr(@ISO{event_date}, 1, 10) || '"' else '"' || @ISO{event_date} || 'Z"' end ||
  ', "orderValue": ' || case when k % 11 = 0 then '"12"' else cast(k % 100 as string) || '.5' end ||
  ', "mediaEligible": ' || case when k % 13 = 0 then '"true"' when k % 13 = 1 then 'null' else 'true' end || '}' as record
from cand_core
""",
    ),
    "customer_event": (
        (),
        """
select event_id, 'CUST-' || user_id as customer_id, event_type, 'product' as subject_type, 'S-' || (event_id % 20) as subject_id,
  'prog-' || (1 + event_id % 5) as program_id, 'US' as marketplace, ts as event_date, props, value
from events
""",
    ),
    "event_json": (
        (),
        """
select event_id, ts,
  '{"detail": {' ||
  case when event_id % 31 = 0 then '' else '"customerId": "CUST-' || user_id || '", ' end ||
  '"eventType": "' || event_type || '", "subjectType": "product", ' ||
  case when event_id % 37 = 0 then '"subjectId": null, ' else '"subjectId": "S-' || (event_id % 20) || '", ' end ||
  '"programId": "prog-' || (1 + event_id % 5) || '", "marketplace": "US"' ||
  case when event_id % 3 = 0 then '' else ', "eventDate": "' || @ISO{ts} || 'Z"' end ||
  case when event_id % 4 = 0 then '' else ', "metadata": {"orderValue": "' || cast(value as string) || '"}' end ||
  '}}' as body
from events
""",
    ),
    "deliveries": (
        (),
        """
select event_id as delivery_id, 'CUST-' || user_id as customer_id, user_id,
  case event_id % 4 when 0 then 'email' else 'push' end as channel,
  'camp-' || (event_id % 10) as campaign_id, 'prog-' || (1 + event_id % 5) as program_id,
  case when event_id % 14 = 0 then 'failed' else 'delivered' end as status,
  case when event_id % 28 = 0 then 'FREQUENCY_CAP_EXCEEDED' when event_id % 14 = 0 then 'SEND_FAILED' else null end as error_code,
  ts as sent_at
from events
""",
    ),
    "opens": (
        (),
        """
select event_id as delivery_id, 'CUST-' || user_id as customer_id, ts + interval '1' hour as opened_at
from events where event_id % 8 = 0
union all
select event_id as delivery_id, 'CUST-' || user_id as customer_id, ts + interval '5' hour as opened_at
from events where event_id % 16 = 0
""",
    ),
    "conversions": (
        (),
        """
select event_id as conversion_id, 'CUST-' || user_id as customer_id, ts as converted_at, value as amount
from events where event_type = 'purchase'
""",
    ),
    "opt_outs": (
        (),
        """
select 'CUST-' || c_custkey as customer_id, cast(null as string) as program_id from customer where c_custkey % 13 = 0
union all
select 'CUST-' || c_custkey as customer_id, 'prog-1' as program_id from customer where c_custkey % 17 = 0
""",
    ),
    "device_tokens": (
        (),
        """
select 'CUST-' || c_custkey as customer_id, 'tok-' || c_custkey || '-' || n as token
from (select c_custkey, @UPTO{2} as n from customer)
where c_custkey % 3 <> 0 and n <= c_custkey % 3
""",
    ),
    "voice_ids": ((), "select 'CUST-' || c_custkey as customer_id, 'voice-' || c_custkey as voice_user_id from customer where c_custkey % 4 = 0"),
    "features": (
        (),
        """
select 'CUST-' || o_custkey as customer_id, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as lifetime_value, count(*) as order_count,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) / cast(count(*) as double) as avg_order_value, max(o_orderdate) as last_purchase
from orders group by o_custkey
""",
    ),
    "feature_history": (
        (),
        """
select 'CUST-' || o_custkey as customer_id, o_orderdate as feature_time, count(*) as orders_that_day, max(o_orderkey) as last_key
from orders where o_orderkey % 3 = 0 group by o_custkey, o_orderdate
""",
    ),
    "score_cache": (
        ("cand_core",),
        """
select customer_id, subject_id, case k % 8 when 0 then 'trust' else 'quality' end as model_id,
  cast((k * 29) % 1000 as double) / 1000 as score_value, case when k % 12 = 0 then null else 0.8e0 end as confidence,
  timestamp '2001-08-02 00:00:00' - interval '1' hour * cast(k % 3 as int) as scored_at,
  timestamp '2001-08-02 00:00:00' - interval '1' hour * cast(k % 3 as int) + interval '3600' second as expires_at
from cand_core where k % 4 = 0
""",
    ),
    "customer_context": (
        ("cand_core",),
        """
select customer_id, ck, subject_type, count(*) as engagements,
  cast(ck % 10 as double) / 10 as channel_pref, ck % 2 = 0 as likes_high_value, ck % 3 = 0 as likes_media,
  case when ck % 4 = 0 then null else 1000 + ck % 5 end as preferred_window
from cand_core group by customer_id, ck, subject_type
""",
    ),
    "requests": (
        (),
        """
select 'req-' || c_custkey as request_id, 'CUST-' || c_custkey as customer_id,
  case c_custkey % 3 when 0 then 'email' when 1 then 'push' else null end as channel,
  case when c_custkey % 4 = 0 then null else 'prog-' || (1 + c_custkey % 5) end as program_id,
  r_name as marketplace, cast(3 as int) as max_results, c_custkey % 20 = 0 as include_scores
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""",
    ),
    "usage_log": (
        (),
        """
select event_id, ts, 'CUST-' || user_id as customer_id, user_id,
  case event_type when 'view' then 'getCandidates' when 'click' then 'getBatch' when 'purchase' then 'markConsumed' when 'signup' then 'refresh' else 'legacy' end as endpoint,
  case event_id % 3 when 0 then 'email' when 1 then 'push' else null end as channel,
  case when event_id % 7 = 0 then null else 'prog-' || (1 + event_id % 5) end as program_id,
  value as duration_ms, event_type = 'error' as is_error
from events
""",
    ),
    "cost_log": (
        (),
        """
select 'prog-' || (1 + user_id % 5) as program_id, event_id % 40 as read_units, event_id % 17 as write_units,
  cast(1 as bigint) as invocations, cast(floor(value) as bigint) as duration_ms, event_id % 3 as external_calls, event_id * 1000 as bytes_out
from events
""",
    ),
    "stage_log": (
        (),
        """
select event_id, 'exec-' || (user_id % 7) as execution_id, 'prog-' || (1 + user_id % 5) as program_id,
  case user_id % 3 when 0 then 'US' when 1 then 'UK' else 'DE' end as marketplace,
  case event_type when 'view' then 'etl' when 'click' then 'filter' when 'purchase' then 'score' when 'signup' then 'store' else 'filter' end as stage,
  case when event_id % 11 = 0 then 'error' when event_id % 7 = 0 then 'fallback' when event_id % 5 = 0 then 'rejected' else 'ok' end as outcome,
  case event_id % 3 when 0 then 'TRUST_SCORE_LOW' when 1 then 'CHANNEL_INELIGIBLE' else 'EVENT_TOO_OLD' end as reason_code,
  case event_id % 3 when 0 then 'trust' when 1 then 'eligibility' else 'business-rule' end as filter_type,
  'item-' || event_id as item_id, ts, value
from events
""",
    ),
    "sms_messages": (
        (),
        """
select 'CUST-' || (conv_id % 100) as customer_id, turn,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(conv_id * 60 + turn as int) as received_at,
  case conv_id % 17 when 0 then ' stop ' when 1 then 'Unsubscribe' when 2 then 'START' when 3 then 'quit' when 4 then 'please stop' else text end as body
from conversations where role = 'user'
""",
    ),
    "stock": (
        (),
        """
select p_partkey, p_name, p_brand, p_size, p_retailprice, p_partkey % 10 <> 0 as active from part
""",
    ),
    "stock_shadow": (
        (),
        """
select p_partkey, p_name, p_brand, case when p_partkey % 97 = 0 then p_size + 1 else p_size end as p_size,
  case when p_partkey % 101 = 0 then null else p_retailprice end as p_retailprice, p_partkey % 10 <> 0 as active
from part where p_partkey % 53 <> 0
union all
select p_partkey + 1000000 as p_partkey, p_name, p_brand, p_size, p_retailprice, true as active from part where p_partkey % 71 = 0
""",
    ),
    "travel": (
        (),
        """
select event_id, user_id, ts, cast(30 + (user_id + event_id * 7) % 20 as double) as lat, cast(-120 + (event_id * 13) % 50 as double) as lon
from events
""",
    ),
    "versions": (
        (),
        """
select 'CUST-' || (o_custkey % 50) as entity_id, o_orderkey as row_id,
  o_orderdate as updated_at,
  row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) + case when o_orderkey % 97 = 0 then 1 else 0 end as version
from orders
""",
    ),
    "program_runs": (
        (),
        """
select event_id as run_id, 'prog-' || (1 + user_id % 12) as program_id, ts as started_at,
  case event_type when 'error' then 'failure' when 'signup' then 'timeout' else case when user_id % 12 = 5 then 'failure' else 'success' end end as status
from events
""",
    ),
    # fixed configuration rows
    "program_config": (
        (),
        """
select 'prog-1' as program_id, 'Reviews' as program_name, true as enabled, 'US,EUROPE,ASIA' as marketplaces, '0 6 * * *' as schedule, true as reactive, 30 as ttl_days, 7 as window_days
union all select 'prog-2', 'Video', true, 'AMERICA,ASIA', '0 7 * * *', false, 14, cast(null as int)
union all select 'prog-3', 'Service', true, 'AFRICA,EUROPE', '', true, 0, 10
union all select 'prog-4', ' ', true, 'ASIA', '0 8 * * *', false, 30, 0
union all select 'prog-5', 'Events', false, '', '0 9 * * 1', false, 60, 3
""",
    ),
    "overrides": (
        (),
        """
select 'prog-1' as program_id, 'EUROPE' as marketplace, cast(null as boolean) as o_enabled, '0 5 * * *' as o_schedule, cast(null as boolean) as o_reactive, 45 as o_ttl_days, cast(null as int) as o_window_days
union all select 'prog-2', 'ASIA', false, cast(null as string), true, cast(null as int), 5
""",
    ),
    "templates": (
        (),
        """
select 'prog-1' as program_id, 'tmpl-reviews' as template_id
union all select 'prog-2', 'tmpl-video' union all select 'prog-3', 'tmpl-service' union all select 'prog-5', 'tmpl-events'
""",
    ),
    "experiment_groups": (
        (),
        """
select 'exp-1' as experiment_id, true as enabled, 0 as pos, 'control' as treatment_id, 50 as allocation
union all select 'exp-1', true, 1, 'variant', 50
union all select 'exp-2', true, 0, 'a', 40 union all select 'exp-2', true, 1, 'b', 30 union all select 'exp-2', true, 2, 'c', 30
union all select 'exp-3', false, 0, 'control', 100
union all select 'exp-4', true, 0, 'control', 45 union all select 'exp-4', true, 1, 'variant', 45
""",
    ),
    "clients": (
        (),
        """
select 'client-a' as client_id, 'prog-1' as program_id, 50 as daily_quota, 'America/New_York' as zone, 'US' as country
union all select 'client-a', 'prog-2', 50, 'America/New_York', 'US'
union all select 'client-b', 'prog-3', 20, 'Europe/Berlin', 'DE'
union all select 'client-b', 'prog-4', 20, 'Europe/Berlin', 'DE'
union all select 'client-c', 'prog-5', 10, 'Asia/Tokyo', 'JP'
""",
    ),
    "country_settings": (
        (),
        """
select 'US' as country, 'CEN-US' as sender_id, 0.05e0 as max_price
union all select 'DE', 'CEN-DE', 0.08e0
""",
    ),
}

_MACRO = re.compile(r"@([A-Z]+)\{([^{}]*)\}")


def _expand(text: str, engine: int) -> str:
    while _MACRO.search(text):
        text = _MACRO.sub(lambda m: MACROS[m.group(1)][engine].format(m.group(2)), text)
    return text


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in FIXTURES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _with_prefix(names: tuple[str, ...], engine: int) -> str:
    ctes = [f"{n} as ({_expand(FIXTURES[n][1], engine).strip()})" for n in _closure(names)]
    return ",\n".join(ctes)


def duckdb_text(oracle: str, uses: tuple[str, ...]) -> str:
    """Oracle SQL with its fixtures in front as CTEs."""
    body = _expand(oracle, 1).strip()
    if not uses:
        return body
    prefix = _with_prefix(uses, 1)
    lowered = body.lower()
    if lowered.startswith("with recursive"):
        return f"with recursive {prefix},\n{body[len('with recursive'):]}"
    if lowered.startswith("with"):
        return f"with {prefix},\n{body[len('with'):]}"
    return f"with {prefix}\n{body}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture table ``name`` as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = f"with {_with_prefix((name,), 0)} select * from {name}"
    for base in TABLES:
        if re.search(rf"\b(from|join) {base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)


def _score(model: str, value: str, confidence: Column) -> Column:
    return F.struct(
        F.lit(model).alias("model_id"),
        F.col(value).alias("value"),
        confidence.cast("double").alias("confidence"),
        F.col("updated_at").alias("timestamp"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def candidates(spark: SparkSession, sf_dir: str, delivery: bool = True) -> DataFrame:
    """Nested candidate rows over ``cand``; ``delivery=False`` leaves the shipment join out."""
    flat = fixture(spark, sf_dir, "cand" if delivery else "cand_core")
    if not delivery:
        flat = flat.withColumn("delivery_date", F.lit(None).cast("timestamp"))
    # every model has an entry; an absent score is a null struct
    scored = [("trust", F.lit(0.9)), ("fraud", F.lit(None)), ("quality", F.col("quality_conf"))]
    scores = F.create_map(*[x for m, c in scored for x in (F.lit(m), F.when(F.col(m).isNotNull(), _score(m, m, c)))])
    names = [f.name for f in CANDIDATE.fields]
    columns = {
        "customer_id": F.col("customer_id"),
        "context": F.array(
            F.struct(F.lit("marketplace").alias("type"), F.col("marketplace").alias("id")),
            F.struct(F.lit("program").alias("type"), F.col("program_id").alias("id")),
        ),
        "subject": F.struct(F.col("subject_type").alias("type"), F.col("subject_id").alias("id"), F.lit(None).cast("map<string,string>").alias("metadata")),
        "scores": scores,
        "attributes": F.struct(
            "event_date", "delivery_date", "timing_window", "order_value", "media_eligible",
            F.create_map(
                F.lit("email"), F.col("email"), F.lit("in-app"), F.col("in_app"), F.lit("push"), F.col("push"), F.lit("sms"), F.col("sms")
            ).alias("channel_eligibility"),
            F.lit(False).alias("consumed"),
            F.lit(None).cast("timestamp").alias("consumed_at"),
            F.lit(None).cast("string").alias("consumed_channel"),
        ),
        "metadata": F.struct(
            "created_at", "updated_at", "expires_at", "version",
            F.lit("warehouse").alias("source_connector_id"), F.lit("exec-1").alias("workflow_execution_id"),
            F.lit(None).cast("struct<experiment_id:string,treatment_id:string>").alias("experiment_treatment"),
        ),
        "rejection_history": F.lit(None).cast(ddl(CANDIDATE["rejection_history"].dataType)),
    }
    return flat.select("k", *[columns[n].alias(n) for n in names])
