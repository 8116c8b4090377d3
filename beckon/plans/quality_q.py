"""Queries for V1-V15."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.operators import quality as qa
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query

JOINED = lambda c: F.array_join(c, "; ")

V1_SQL = """concat_ws('; ', case k % 29 when 0 then 'Required field ''customerId'' is missing' when 1 then 'Required field ''customerId'' is null' when 2 then 'Required field ''customerId'' is blank' end,
  case when k % 37 = 0 then 'Required field ''subjectId'' is missing' end)"""
V2_SQL = """concat_ws('; ', case k % 31 when 0 then 'Field ''eventDate'' has invalid date format: not-a-date' when 1 then 'Field ''eventDate'' has invalid date format: 2024-13-45'
  when 2 then 'Field ''eventDate'' has invalid date format: -5' end)"""
V3_SQL = """concat_ws('; ', case when k % 29 = 3 then 'Field ''customerId'' must be a string, got Number' end,
  case when k % 11 = 0 then 'Field ''orderValue'' must be numeric, got String' end, case when k % 13 = 0 then 'Field ''mediaEligible'' must be boolean, got String' end)"""
SCHEMA = {
    "required": ["customerId", "subjectId"],
    "properties": {
        "subjectType": {"type": "string", "enum": ["product", "video", "service", "event"]},
        "orderValue": {"type": "number", "minimum": 5, "maximum": 90},
        "customerId": {"type": "string", "pattern": "^CUST-[0-9]+$"},
    },
}


def records(spark, sf):
    return qa.parse_records(fixture(spark, sf, "raw_json"), "record")


@query("v1_validate_required", f"select k, {V1_SQL} as errors from cand_core", ("cand_core",))
def v1(spark, sf):
    return records(spark, sf).select("k", JOINED(qa.required_errors()).alias("errors"))


@query("v2_validate_dates", f"select k, {V2_SQL} as errors from cand_core", ("cand_core",))
def v2(spark, sf):
    return records(spark, sf).select("k", JOINED(qa.date_errors(AS_OF_ORDERS)).alias("errors"))


@query("v3_validate_types", f"select k, {V3_SQL} as errors from cand_core", ("cand_core",))
def v3(spark, sf):
    return records(spark, sf).select("k", JOINED(qa.type_errors()).alias("errors"))


@query(
    "v4_validate_schema",
    """with d as (select k, record, json_type(record, '$.customerId') ct, json_extract_string(record, '$.customerId') cv, json_type(record, '$.subjectId') st,
      json_extract_string(record, '$.subjectType') sv, json_type(record, '$.orderValue') ot, try_cast(json_extract_string(record, '$.orderValue') as double) ov from raw_json)
    select k, cast((ct is null)::int + (st is null)::int + (sv = 'track')::int + (ot = 'VARCHAR')::int + (ot <> 'VARCHAR' and ov < 5)::int + (ot <> 'VARCHAR' and ov > 90)::int
      + coalesce((ct <> 'VARCHAR')::int, 0) + coalesce((ct = 'VARCHAR' and not regexp_matches(cv, '^CUST-[0-9]+$'))::int, 0) as bigint) as n_errors from d""",
    ("raw_json",),
)
def v4(spark, sf):
    errors = qa.schema_errors(SCHEMA)
    return records(spark, sf).select("k", F.size(errors).cast("bigint").alias("n_errors"))


@query(
    "v5_validate_row",
    f"with e as (select k, concat_ws('; ', nullif({V1_SQL}, ''), nullif({V2_SQL}, ''), nullif({V3_SQL}, '')) as errors from cand_core) select k, errors, errors = '' as valid from e",
    ("cand_core",),
)
def v5(spark, sf):
    out = qa.validate_rows(fixture(spark, sf, "raw_json"), "record", AS_OF_ORDERS)
    return out.select("k", JOINED("errors").alias("errors"), "valid")


@query(
    "v6_typed_rules",
    """select k, concat_ws('; ', case when not regexp_matches(subject_id, '^ORD-[0-9]*[02468]$') then 'subject_id: pattern' end,
    case when order_value < 50000 then 'order_value: below min' end, case when order_value > 400000 then 'order_value: above max' end,
    case when expires_at < timestamp '1996-01-01' then 'expires_at: below min' end, case when expires_at > timestamp '2001-08-09' then 'expires_at: above max' end,
    case when marketplace not in ('ASIA', 'EUROPE') then 'marketplace: not allowed' end) as errors from cand_core""",
    ("cand_core",),
)
def v6(spark, sf):
    rules = [
        {"field": "subject_id", "pattern": "^ORD-[0-9]*[02468]$"},
        {"field": "order_value", "min": 50000, "max": 400000},
        {"field": "expires_at", "type": "date", "min": "1996-01-01", "max": "now+7d"},
        {"field": "marketplace", "enum": ["ASIA", "EUROPE"]},
    ]
    return qa.typed_rules(fixture(spark, sf, "cand_core"), rules, AS_OF_ORDERS).select("k", JOINED("rule_errors").alias("errors"))


@query(
    "v7_business_rules",
    """select k, concat_ws('; ', case when order_value is null or order_value <= 10000 then 'value too low' end, case when not (delivery_date >= event_date) then 'delivered before event' end) as rejects,
    concat_ws('; ', case when not email then 'no email' end) as warnings from cand""",
    ("cand",),
)
def v7(spark, sf):
    rules = [
        {"condition": "order_value > 10000", "onFailure": "reject", "message": "value too low"},
        {"condition": "email", "onFailure": "warn", "message": "no email"},
        {"condition": "delivery_date >= event_date or delivery_date is null", "onFailure": "reject", "message": "delivered before event"},
    ]
    out = qa.business_rules(fixture(spark, sf, "cand"), rules)
    return out.select("k", JOINED("rejects").alias("rejects"), JOINED("warnings").alias("warnings"))


DEDUP_SQL = """with recursive e as (select event_id, {key} as dkey, @EPOCH{{ts}} as sec from events),
    k as (select dkey, min(sec) as sec from e group by dkey
      union all select k.dkey, (select min(e.sec) from e where e.dkey = k.dkey and e.sec >= k.sec + {gap}) from k
      where (select min(e.sec) from e where e.dkey = k.dkey and e.sec >= k.sec + {gap}) is not null)
    select event_id, not coalesce(event_id = first_id, false) as is_duplicate from e
    left join (select e.dkey as d2, e.sec as s2, min(event_id) as first_id from e join k on e.dkey = k.dkey and e.sec = k.sec group by all) f on f.d2 = dkey and f.s2 = sec"""


@query("v8_detect_duplicates", DEDUP_SQL.format(key="user_id", gap=86400))
def v8(spark, sf):
    return qa.detect_duplicates(fixture(spark, sf, "events"), ["user_id"], "ts", "event_id").select("event_id", "is_duplicate")


@query(
    "v8_detect_duplicates_7d",
    DEDUP_SQL.format(key="user_id || '|' || event_type", gap=604800),
)
def v8b(spark, sf):
    return qa.detect_duplicates(fixture(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", 7 * 86400).select("event_id", "is_duplicate")


@query("v9_dead_letters", f"select k, {V1_SQL} as errors from cand_core where {V1_SQL} <> ''", ("cand_core",))
def v9(spark, sf):
    df = records(spark, sf).withColumn("errors", qa.required_errors())
    _, dead = qa.dead_letter_split(df)
    return dead.select("k", JOINED("errors").alias("errors"))


@query(
    "v9_error_rate_gate",
    """select count(*) as total, count(*) filter (where k % 29 <= 2 or k % 37 = 0) as failed,
    round(count(*) filter (where k % 29 <= 2 or k % 37 = 0) / count(*)::double, 6) as error_rate, count(*) filter (where k % 29 <= 2 or k % 37 = 0) / count(*)::double > 0.05 as batch_failed from cand_core""",
    ("cand_core",),
)
def v9_gate(spark, sf):
    df = records(spark, sf)
    return qa.error_rate_gate(df, F.size(qa.required_errors()) > 0)


def config_rows(spark, sf):
    """One configuration per customer, with the faults of ``c_custkey`` moduli."""
    one = "array(named_struct('id', 'x'))"
    none = "cast(array() as array<struct<id:string>>)"
    return fixture(spark, sf, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 5 = 0 then ' ' else concat('prog-', c_custkey) end as programId",
        "case when c_custkey % 7 = 0 then '' else c_name end as programName",
        "case when c_custkey % 11 = 0 then cast(array() as array<string>) else array('US') end as marketplaces",
        f"case when c_custkey % 3 = 0 then {none} else {one} end as dataConnectors",
        f"case when c_custkey % 13 = 0 then {none} else {one} end as scoringModels",
        f"{one} as filters", f"{one} as channels",
        "cast(c_custkey % 4 as int) as candidateTTLDays",
        "cast(case when c_custkey % 6 = 0 then null else c_custkey % 6 - 1 end as int) as timingWindowDays",
        "case when c_custkey % 9 = 0 then ' ' when c_custkey % 9 = 1 then null else '0 6 * * *' end as batchSchedule",
    )


@query(
    "v10_validate_program_configs",
    """select c_custkey, concat_ws('; ', case when c_custkey % 5 = 0 then 'programId: blank' end, case when c_custkey % 7 = 0 then 'programName: blank' end,
    case when c_custkey % 3 = 0 then 'dataConnectors: names no data connector' end, case when c_custkey % 13 = 0 then 'scoringModels: names no scoring model' end,
    case when c_custkey % 11 = 0 then 'marketplaces: names no marketplace' end, case when c_custkey % 4 = 0 then 'candidateTTLDays: not above zero' end,
    case when c_custkey % 6 = 1 then 'timingWindowDays: given but not above zero' end, case when c_custkey % 9 = 0 then 'batchSchedule: given but blank' end) as errors from customer""",
)
def v10(spark, sf):
    return config_rows(spark, sf).select("c_custkey", JOINED(qa.program_config_errors()).alias("errors"))


@query(
    "v11_validate_connector_configs",
    """select s_suppkey, concat_ws('; ', case when s_suppkey % 5 = 0 then 'connectorId: blank' end,
    case when s_suppkey % 4 = 0 then 'connectorType: csv is not data-warehouse' end,
    case when s_suppkey % 7 = 0 then 'sourceConfig: empty for data-warehouse; sourceConfig: absent'
      else nullif(concat_ws('; ', case when s_suppkey % 3 = 0 then 'sourceConfig: database missing' end, case when s_suppkey % 2 = 0 then 'sourceConfig: query missing' end), '') end) as errors
    from supplier""",
)
def v11(spark, sf):
    df = fixture(spark, sf, "supplier").selectExpr(
        "s_suppkey", "case when s_suppkey % 5 = 0 then '' else s_name end as connectorId", "case when s_suppkey % 4 = 0 then 'csv' else 'data-warehouse' end as connectorType",
        """case when s_suppkey % 7 <> 0 then map_filter(map('database', case when s_suppkey % 3 <> 0 then 'db' end, 'query', case when s_suppkey % 2 = 0 then ' ' else 'select 1' end,
        'resultsBucket', 'results'), (k, v) -> v is not null) end as sourceConfig""",
    )
    return df.select("s_suppkey", JOINED(qa.connector_config_errors("data-warehouse")).alias("errors"))


@query(
    "v12_validate_features",
    """select customer_id, case when ck % 5 = 0 then 'segment' else '' end as missing,
    case when ck % 5 = 0 then '' else concat_ws(';', case when ck % 4 = 0 then 'lifetime_value' end, case when ck % 3 = 0 then 'segment' end) end as invalid,
    ck % 5 <> 0 and ck % 4 <> 0 and ck % 3 <> 0 as valid from (select 'CUST-' || c_custkey as customer_id, c_custkey as ck from customer)""",
)
def v12(spark, sf):
    long = fixture(spark, sf, "customer").selectExpr(
        "concat('CUST-', c_custkey) as customer_id", "c_custkey as ck",
        """explode(array(named_struct('feature', 'lifetime_value', 'type', 'NUMERIC', 'num', case when c_custkey % 4 = 0 then double('NaN') else c_acctbal end, 'str', cast(null as string), 'bool', cast(null as boolean)),
        named_struct('feature', case when c_custkey % 5 = 0 then 'other' else 'segment' end, 'type', 'STRING', 'num', cast(null as double), 'str', case when c_custkey % 3 = 0 then ' ' else c_mktsegment end, 'bool', cast(null as boolean)))) as f""",
    ).selectExpr("customer_id", "f.*")
    out = qa.validate_features(long, ["customer_id"], ["lifetime_value", "segment"])
    return out.select("customer_id", F.array_join("missing", ";").alias("missing"), F.array_join("invalid", ";").alias("invalid"), "valid")


@query(
    "v13_check_allocation",
    """select 'exp-' || (p_partkey // 4) as experiment_id, cast(sum(case p_size % 4 when 0 then 25 when 1 then 50 when 2 then 15 else 10 end) as bigint) as total_allocation,
    sum(case p_size % 4 when 0 then 25 when 1 then 50 when 2 then 15 else 10 end) = 100 as valid from part group by p_partkey // 4""",
)
def v13(spark, sf):
    groups = fixture(spark, sf, "part").selectExpr(
        "concat('exp-', p_partkey div 4) as experiment_id", "case p_size % 4 when 0 then 25 when 1 then 50 when 2 then 15 else 10 end as allocation"
    )
    return qa.check_allocation(groups)


@query(
    "v14_candidate_invariants",
    """select k, concat_ws('; ', case when k % 10 = 0 then 'customer id blank' end, case when k % 12 = 0 then 'version not positive' end,
    case when k % 17 <> 0 and k % 13 <> 0 and quality_conf + (k % 2) > 1 then 'confidence outside 0..1' end) as violations from cand_core""",
    ("cand_core",),
)
def v14(spark, sf):
    c = candidates(spark, sf, delivery=False)
    shifted = F.transform_values("scores", lambda m, s: F.when(m == "quality", s.withField("confidence", s["confidence"] + F.col("k") % 2)).otherwise(s))
    c = c.withColumns(
        {
            "customer_id": F.when(F.col("k") % 10 == 0, F.lit(" ")).otherwise(F.col("customer_id")),
            "metadata": F.col("metadata").withField("version", F.when(F.col("k") % 12 == 0, F.lit(0)).otherwise(F.col("metadata.version"))),
            "scores": shifted,
        }
    )
    return c.select("k", JOINED(qa.candidate_violations()).alias("violations"))


@query(
    "v15_validate_serving_requests",
    """select c_custkey, concat_ws('; ', case when c_custkey % 9 = 0 then 'customer id blank' end, case when c_custkey % 8 = 0 then 'marketplace blank' end,
    case when c_custkey % 130 = 0 then 'limit must be positive' end, case when c_custkey % 130 > 100 then 'limit too large' end, case when c_custkey % 120 > 100 then 'batch too large' end) as errors from customer""",
)
def v15(spark, sf):
    df = fixture(spark, sf, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 9 = 0 then '' else c_name end as customer_id", "case when c_custkey % 8 = 0 then null else 'US' end as marketplace",
        "c_custkey % 130 as max_results", "c_custkey % 120 as batch",
    )
    return df.select("c_custkey", JOINED(qa.serving_request_errors(F.col("batch"))).alias("errors"))
