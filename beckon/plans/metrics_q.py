"""Queries for A1-A24."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.operators import enrichment as en
from beckon.operators import filters as fl
from beckon.operators import metrics as me
from beckon.operators.mapping import context_id
from beckon.plans.filters_q import CHAIN, CHAIN_SQL
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query


@query(
    "a1_rejection_counts",
    f"select filter_id as filter_type, reason_code, program_id, marketplace, count(*) as rejections from ({CHAIN_SQL}) where reason_code is not null group by all",
    ("cand",),
)
def a1(spark, sf):
    out = fl.filter_chain(candidates(spark, sf), CHAIN, AS_OF_ORDERS).filter("rejection is not null")
    rows = out.select(F.col("rejection.filter_id").alias("filter_type"), "rejection.reason_code", context_id("program").alias("program_id"), context_id("marketplace").alias("marketplace"))
    return me.rejection_counts(rows, ["filter_type", "reason_code", "program_id", "marketplace"])


@query(
    "a2_etl_metrics",
    "select execution_id, count(*) as processed, count(*) filter (where outcome <> 'error') as transformed, count(*) filter (where outcome = 'error') as errors from stage_log where stage = 'etl' group by 1",
    ("stage_log",),
)
def a2(spark, sf):
    return me.etl_metrics(fixture(spark, sf, "stage_log").filter("stage = 'etl'"), ["execution_id"])


@query(
    "a3_filter_metrics",
    """select program_id, marketplace, null as reason_code, count(*) as input, count(*) filter (where outcome = 'rejected') as rejected, 'program' as grain, count(*) filter (where outcome <> 'rejected') as passed from stage_log where stage = 'filter' group by 1, 2
    union all select program_id, marketplace, reason_code, count(*), count(*), 'reason', 0 from stage_log where stage = 'filter' and outcome = 'rejected' group by 1, 2, 3""",
    ("stage_log",),
)
def a3(spark, sf):
    return me.filter_metrics(fixture(spark, sf, "stage_log").filter("stage = 'filter'"))


@query(
    "a4_score_metrics",
    """select execution_id, count(*) as input, count(*) filter (where outcome <> 'error') as scored, count(*) filter (where outcome = 'fallback') as fallback, count(*) filter (where outcome = 'error') as errors
    from stage_log where stage = 'score' group by 1""",
    ("stage_log",),
)
def a4(spark, sf):
    return me.score_metrics(fixture(spark, sf, "stage_log").filter("stage = 'score'"), ["execution_id"])


@query(
    "a5_store_metrics",
    """select program_id, execution_id, count(*) as input, count(*) filter (where outcome <> 'error') as stored, count(*) filter (where outcome = 'error') as failed, count(*) filter (where outcome = 'error') = 0 as success
    from stage_log where stage = 'store' group by 1, 2""",
    ("stage_log",),
)
def a5(spark, sf):
    return me.store_metrics(fixture(spark, sf, "stage_log").filter("stage = 'store'"), ["program_id", "execution_id"])


@query("a5_failed_items", "select execution_id, item_id from stage_log where stage = 'store' and outcome = 'error'", ("stage_log",))
def a5_items(spark, sf):
    return me.failed_items(fixture(spark, sf, "stage_log").filter("stage = 'store'"), ["execution_id"], "item_id")


@query(
    "a6_workflow_summary",
    """with s as (select execution_id, count(*) filter (where stage = 'etl') as etl_processed, count(*) filter (where stage = 'etl' and outcome = 'error') as etl_errors,
      count(*) filter (where stage = 'filter') as filter_input, count(*) filter (where stage = 'filter' and outcome = 'rejected') as filter_rejected,
      count(*) filter (where stage = 'score' and outcome <> 'error') as scored, count(*) filter (where stage = 'score' and outcome = 'error') as score_errors,
      count(*) filter (where stage = 'store' and outcome <> 'error') as stored, count(*) filter (where stage = 'store' and outcome = 'error') as store_failed from stage_log group by 1)
    select *, etl_errors + score_errors + store_failed as total_errors, store_failed = 0 and etl_errors + score_errors + store_failed = 0 as success from s""",
    ("stage_log",),
)
def a6(spark, sf):
    return me.workflow_summary(fixture(spark, sf, "stage_log"))


EXP_ROWS = "(select 'exp-' || (event_id % 3) as experiment_id, 't' || (user_id % 3) as treatment_id, event_id % 5 <> 0 and user_id % 3 <> 2 as delivered, event_id % 5 <> 0 and user_id % 3 <> 2 and value > 60 - 20 * (user_id % 3) as responded from events)"
EXP_METRICS = f"""select experiment_id, treatment_id, count(*) as created, count(*) filter (where delivered) as delivered, count(*) filter (where responded) as responses,
  case when count(*) filter (where delivered) > 0 then count(*) filter (where responded) / count(*) filter (where delivered)::double end as conversion_rate from {EXP_ROWS} group by 1, 2"""


def experiment_rows(spark, sf):
    return fixture(spark, sf, "events").selectExpr(
        "concat('exp-', event_id % 3) as experiment_id", "concat('t', user_id % 3) as treatment_id", "event_id % 5 <> 0 and user_id % 3 <> 2 as delivered",
        "event_id % 5 <> 0 and user_id % 3 <> 2 and value > 60 - 20 * (user_id % 3) as responded",
    )


@query("a7_experiment_metrics", f"select * replace (round(conversion_rate, 6) as conversion_rate) from ({EXP_METRICS})")
def a7(spark, sf):
    return me.experiment_metrics(experiment_rows(spark, sf)).withColumn("conversion_rate", F.round("conversion_rate", 6))


@query(
    "a8_compare_treatments",
    f"select experiment_id, treatment_id, row_number() over (partition by experiment_id order by coalesce(conversion_rate, 0) desc, treatment_id) as place from ({EXP_METRICS})",
)
def a8(spark, sf):
    return me.compare_treatments(me.experiment_metrics(experiment_rows(spark, sf))).select("experiment_id", "treatment_id", "place")


@query(
    "a9_auto_promote",
    f"""with m as ({EXP_METRICS}), d as (select v.experiment_id, v.treatment_id, v.responses::double x1, v.delivered::double n1, c.responses::double x0, c.delivered::double n0
      from m v join m c on c.experiment_id = v.experiment_id and c.treatment_id = 't0' and v.treatment_id <> 't0' where v.delivered > 0 and c.delivered > 0),
    s as (select *, x1 / n1 - x0 / n0 as lift, (x0 + x1) / (n0 + n1) as p from d)
    select experiment_id, treatment_id, round(lift, 6) as lift, round(lift / sqrt(p * (1 - p) * (1 / n0 + 1 / n1)), 6) as z_score,
    lift >= 0.05 and abs(lift / sqrt(p * (1 - p) * (1 / n0 + 1 / n1))) >= 1.959963984540054 as promote from s""",
)
def a9(spark, sf):
    out = me.auto_promote(me.experiment_metrics(experiment_rows(spark, sf)), "t0")
    return out.withColumns({"lift": F.round("lift", 6), "z_score": F.round("z_score", 6)})


@query(
    "a10_campaign_metrics",
    """select campaign_id, count(*) as sent, count(*) filter (where delivery_id in (select delivery_id from opens)) as opened,
    round(count(*) filter (where delivery_id in (select delivery_id from opens)) / count(*)::double, 6) as open_rate from deliveries group by 1""",
    ("deliveries", "opens"),
)
def a10(spark, sf):
    return me.campaign_metrics(fixture(spark, sf, "deliveries"), fixture(spark, sf, "opens")).withColumn("open_rate", F.round("open_rate", 6))


@query(
    "a11_delivery_metrics",
    """select program_id, count(*) as total, count(*) filter (where status = 'delivered') as delivered, count(*) filter (where status = 'failed') as failed,
    count(*) filter (where error_code = 'FREQUENCY_CAP_EXCEEDED') as rate_limited from deliveries group by 1""",
    ("deliveries",),
)
def a11(spark, sf):
    return me.delivery_metrics(fixture(spark, sf, "deliveries"), ["program_id"])


@query(
    "a12_funnel_rates",
    """with f as (select user_id % 7 as grp, count(*) filter (where event_type in ('view')) as sent, count(*) filter (where event_type = 'click') as opened, count(*) filter (where event_type = 'signup') as clicked,
      count(*) filter (where event_type = 'purchase') as responded from events group by 1)
    select *, round(opened / sent::double, 6) as opened_rate, round(clicked / sent::double, 6) as clicked_rate, round(responded / sent::double, 6) as responded_rate from f""",
)
def a12(spark, sf):
    stages = F.create_map(*[F.lit(x) for x in ("view", "sent", "click", "opened", "signup", "clicked", "purchase", "responded")])
    df = fixture(spark, sf, "events").select((F.col("user_id") % 7).alias("grp"), stages[F.col("event_type")].alias("stage"))
    out = me.funnel_rates(df, ["grp"])
    return out.withColumns({f"{n}_rate": F.round(f"{n}_rate", 6) for n in ("opened", "clicked", "responded")})


@query(
    "a13_cost_summary",
    """with s as (select program_id, sum(read_units)::bigint as read_units, sum(write_units)::bigint as write_units, sum(invocations)::bigint as invocations, sum(duration_ms)::bigint as duration_ms,
      sum(external_calls)::bigint as external_calls, sum(bytes_out)::bigint as bytes_out from cost_log group by 1)
    select *, round(read_units * 2.5e-7 + write_units * 1.25e-6 + invocations * 1.66667e-8 + external_calls * 1e-3 + bytes_out * (9e-2 / 1073741824), 6) as estimated_cost from s""",
    ("cost_log",),
)
def a13(spark, sf):
    return me.cost_summary(fixture(spark, sf, "cost_log")).withColumn("estimated_cost", F.round("estimated_cost", 6))


_USAGE = """with r as (select endpoint, channel, program_id, ts, case when endpoint = 'getBatch' then [customer_id, 'CUST-' || (user_id + 1)] else [customer_id] end as ids from usage_log),
  d as (select 'total' as dimension, 'all' as value, ts, ids from r union all select 'endpoint', endpoint, ts, ids from r union all select 'channel', channel, ts, ids from r where channel is not null
    union all select 'program_id', program_id, ts, ids from r where program_id is not null),
  c as (select dimension, value, count(distinct id) as customers from (select dimension, value, unnest(ids) as id from d) group by 1, 2)
  select d.dimension, d.value, count(*) as requests, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_request, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_request,
  any_value(customers) as customers from d join c on c.dimension = d.dimension and c.value = d.value group by d.dimension, d.value"""


@query("a14_legacy_usage", _USAGE, ("usage_log",))
def a14(spark, sf):
    df = fixture(spark, sf, "usage_log").withColumn(
        "customer_ids", F.expr("case when endpoint = 'getBatch' then array(customer_id, concat('CUST-', user_id + 1)) else array(customer_id) end")
    )
    out = me.legacy_usage(df)
    return out.withColumns({c: iso(F.col(c)) for c in ("first_request", "last_request")})


@query(
    "a14_customers_by_month",
    """with u as (select date_trunc('month', ts) as m, unnest([['total', 'all'], ['endpoint', endpoint], ['channel', channel], ['program_id', program_id]]) as d, customer_id, user_id, endpoint from usage_log),
    c as (select m, d[1] as dimension, d[2] as value, unnest(case when endpoint = 'getBatch' then [customer_id, 'CUST-' || (user_id + 1)] else [customer_id] end) as c from u where d[2] is not null)
    select dimension, value, strftime(m, '%Y-%m') as month, count(c) as mentions, true as within_2_percent from c where c is not null group by all""",
    ("usage_log",),
)
def a14_months(spark, sf):
    df = fixture(spark, sf, "usage_log").withColumn(
        "customer_ids", F.expr("case when endpoint = 'getBatch' then array(customer_id, concat('CUST-', user_id + 1)) else array(customer_id) end")
    )
    month = F.date_format("day", "yyyy-MM")
    merged = me.merge_customer_sketches(me.daily_customer_sketches(df), month)
    exact = me.legacy_usage(df.withColumn("__m", F.date_format("ts", "yyyy-MM")).withColumn("endpoint", F.concat_ws("@", "endpoint", "__m")).withColumn("channel", F.concat_ws("@", "channel", "__m")).withColumn("program_id", F.concat_ws("@", "program_id", "__m")))
    truth = exact.filter("dimension != 'total'").select("dimension", F.substring_index("value", "@", 1).alias("value"), F.substring_index("value", "@", -1).alias("period"), F.col("customers").alias("exact"))
    total = df.select(F.date_format("ts", "yyyy-MM").alias("period"), F.explode("customer_ids").alias("c")).groupBy("period").agg(F.count_distinct("c").alias("exact"))
    truth = truth.unionByName(total.select(F.lit("total").alias("dimension"), F.lit("all").alias("value"), "period", "exact"))
    both = merged.join(truth, ["dimension", "value", "period"])
    return both.select("dimension", "value", F.col("period").alias("month"), "mentions", (F.abs(F.col("customers") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_2_percent"))


@query(
    "a15_customer_features",
    """select o_custkey, cast(sum(cast(o_totalprice as decimal(28,6))) as double) as lifetime_value, count(*) as purchase_frequency, cast(sum(cast(o_totalprice as decimal(28,6))) as double) / count(*)::double as avg_order_value,
    strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as last_purchase, cast(datediff('day', max(o_orderdate), timestamp '2001-08-02') as bigint) as days_since_purchase from orders group by 1""",
)
def a15(spark, sf):
    out = me.customer_features(fixture(spark, sf, "orders"), AS_OF_ORDERS, "o_custkey", "o_totalprice", "o_orderdate")
    return out.withColumn("last_purchase", iso(F.col("last_purchase")))


@query(
    "a16_category_affinity",
    "select customer_id, subject_type, count(*) as engagements, round(count(*) / sum(count(*)) over (partition by customer_id)::double, 6) as affinity from cand_core group by 1, 2",
    ("cand_core",),
)
def a16(spark, sf):
    return me.category_affinity(fixture(spark, sf, "cand_core"), "customer_id", "subject_type").withColumn("affinity", F.round("affinity", 6))


_ROLL = "select endpoint, time_bucket(interval '5 minutes', ts) as period, sum(duration_ms) as total, count(*) as samples, quantile_cont(duration_ms, 0.99) as p99 from usage_log group by 1, 2"


@query(
    "a17_metric_rollup",
    f"select endpoint, strftime(period, '%Y-%m-%d %H:%M:%S') as period, round(total, 4) as total, samples, round(p99, 6) as p99 from ({_ROLL})",
    ("usage_log",),
)
def a17(spark, sf):
    out = me.metric_rollup(fixture(spark, sf, "usage_log"), ["endpoint"], "ts", "duration_ms")
    return out.withColumns({"period": iso(F.col("period")), "total": F.round("total", 4), "p99": F.round("p99", 6)})


@query(
    "a17_daily_p99",
    """select endpoint, strftime(date_trunc('day', ts), '%Y-%m-%d') as period, round(sum(duration_ms), 4) as total, count(*) as samples, round(quantile_cont(duration_ms, 0.99), 6) as p99 from usage_log group by 1, 2""",
    ("usage_log",),
)
def a17_daily(spark, sf):
    out = me.metric_rollup(fixture(spark, sf, "usage_log"), ["endpoint"], "ts", "duration_ms", "1 day")
    return out.withColumns({"period": F.date_format("period", "yyyy-MM-dd"), "total": F.round("total", 4), "p99": F.round("p99", 6)})


@query(
    "a18_alarms",
    f"""with r as ({_ROLL}), b as (select *, p99 > 30 as breach from r)
    select b.endpoint, strftime(b.period, '%Y-%m-%d %H:%M:%S') as period, b.breach, b.breach and coalesce(p.breach, false) as alarm
    from b left join b p on p.endpoint = b.endpoint and p.period = b.period - interval '5 minutes'""",
    ("usage_log",),
)
def a18(spark, sf):
    roll = me.metric_rollup(fixture(spark, sf, "usage_log"), ["endpoint"], "ts", "duration_ms")
    return me.alarms(roll, ["endpoint"], "p99", 30.0, 2).select("endpoint", iso(F.col("period")).alias("period"), "breach", "alarm")


@query(
    "a19_channel_performance",
    """select channel, count(*) as attempts, count(*) filter (where status = 'delivered') as delivered, count(*) filter (where status = 'failed') as failed,
    round(count(*) filter (where status = 'delivered') / count(*)::double, 6) as success_rate from deliveries group by 1""",
    ("deliveries",),
)
def a19(spark, sf):
    return me.channel_performance(fixture(spark, sf, "deliveries")).withColumn("success_rate", F.round("success_rate", 6))


@query(
    "a19_program_health",
    "select program_id, count(*) filter (where outcome <> 'error') as successes, count(*) filter (where outcome = 'error') as errors from stage_log group by 1",
    ("stage_log",),
)
def a19_health(spark, sf):
    return me.program_health(fixture(spark, sf, "stage_log"))


@query(
    "a20_throttle_status",
    """select program_id, n as current_count, m as max_deliveries, greatest(0, m - n) as remaining, m - n <= 0 as throttled from (
      select program_id, count(*) filter (where ts > timestamp '2024-01-20' - interval '1' hour and ts <= timestamp '2024-01-20') as n, cast(case program_id when 'prog-1' then 1 when 'prog-2' then 5 else 1000 end as bigint) as m
      from usage_log where program_id is not null group by 1)""",
    ("usage_log",),
)
def a20(spark, sf):
    limits = spark.createDataFrame([("prog-1", 1), ("prog-2", 5)], "program_id string, max_deliveries int")
    usage = fixture(spark, sf, "usage_log").filter("program_id is not null")
    return me.throttle_status(usage, limits, "2024-01-20 00:00:00", 3600)


@query("a21_queue_stats", "select channel, count(*) as queued from deliveries where status = 'failed' group by 1", ("deliveries",))
def a21(spark, sf):
    return me.queue_stats(fixture(spark, sf, "deliveries").filter("status = 'failed'"))


@query(
    "a22_program_status_rollup",
    """with l as (select program_id, max((started_at, run_id)) filter (where status = 'success') as ok from program_runs group by 1)
    select r.program_id, count(*) filter (where status = 'success') as successes, count(*) filter (where status = 'failure') as failures, count(*) filter (where status = 'timeout') as timeouts,
    strftime(max(started_at), '%Y-%m-%d %H:%M:%S') as last_run, count(*) filter (where ok is null or (started_at, run_id) > ok) as consecutive_failures
    from program_runs r join l on l.program_id = r.program_id group by 1""",
    ("program_runs",),
)
def a22(spark, sf):
    return me.program_status_rollup(fixture(spark, sf, "program_runs")).withColumn("last_run", iso(F.col("last_run")))


@query(
    "a23_cache_hit_rate",
    """select (select count(*) from cand_core) as lookups, count(*) as hits, round(count(*) / (select count(*) from cand_core)::double, 6) as hit_rate
    from score_cache where model_id = 'quality' and expires_at >= timestamp '2001-08-02'""",
    ("cand_core", "score_cache"),
)
def a23(spark, sf):
    asked = fixture(spark, sf, "cand_core").withColumn("model_id", F.lit("quality"))
    return me.cache_hit_rate(en.lookup_score_cache(asked, fixture(spark, sf, "score_cache"), AS_OF_ORDERS)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "a24_usage_billing",
    """select client_id, strftime(event_date, '%Y-%m') as month, sum(200)::bigint as candidates, sum(case when email then 150 else 0 end)::bigint as messages,
    round(greatest(100.0e0, sum(200) * 1e-3 + sum(case when email then 150 else 0 end) * 1e-2), 4) as amount from cand_core join clients using (program_id) group by 1, 2""",
    ("cand_core", "clients"),
)
def a24(spark, sf):
    usage = fixture(spark, sf, "cand_core").join(fixture(spark, sf, "clients").select("client_id", "program_id"), "program_id")
    usage = usage.selectExpr("client_id", "event_date as ts", "200 as candidates", "case when email then 150 else 0 end as messages")
    return me.usage_billing(usage).withColumn("amount", F.round("amount", 4))
