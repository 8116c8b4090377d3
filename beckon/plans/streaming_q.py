"""Queries for T1-T9: streams over the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.operators.quality import detect_duplicates
from beckon.operators.scoring import Model
from beckon.plans.fixtures import AS_OF_EVENTS, _expand, FIXTURES, fixture
from beckon.plans.quality_q import DEDUP_SQL
from beckon.plans.registry import query
from beckon.plans.redact_q import all_sql
from beckon.plans.sources_q import _ROUTED, route_rules
from beckon.sources.events import parse_opt_out_events
from beckon.streaming import operators as so
from beckon.streaming.core import drain, stream_table, work_dir
from beckon.streaming.store import read_store


def stream_fixture(spark, sf, name):
    """A fixture that reads only ``events``, over the event stream."""
    stream_table(spark, sf, "events").createOrReplaceTempView("events_stream")
    return spark.sql(_expand(FIXTURES[name][1], 0).replace("from events", "from events_stream"))


T1_KEYS = ["customer_id", "subject_id", "program_id"]
T1_SQL = DEDUP_SQL.format(key="user_id || '|' || (event_id % 20)", gap=300)
KEPT_1D = f"select event_id from ({DEDUP_SQL.format(key='user_id', gap=86400)}) where not is_duplicate"


@query("t1_dedup_events_batch", T1_SQL)
def t1_batch(spark, sf):
    return detect_duplicates(fixture(spark, sf, "customer_event"), T1_KEYS, "event_date", "event_id", 300).select("event_id", "is_duplicate")


@query("t1_dedup_events_stream", KEPT_1D)
def t1_stream(spark, sf):
    src = stream_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return drain(so.dedup_events_stream(src, ["user_id"], "ts", "event_id", 86400), "t1").select("event_id")


@query(
    "t2_reactive_flow",
    """select 'CUST-' || user_id as customer_id, 'S-' || (event_id % 20) as subject_id, 'prog-' || (1 + event_id % 5) as program_id, min(event_id) as event_id, 0.4e0 as score
    from events where event_id % 31 <> 0 and event_id % 37 <> 0 group by 1, 2, 3""",
)
def t2(spark, sf):
    events = stream_fixture(spark, sf, "event_json").withColumn("received", F.col("ts")).drop("ts")
    # a missing event date is the arrival time
    candidates = so.reactive_candidates(events, F.col("received"))
    path = work_dir(spark, "t2")

    def sink(batch, batch_id):
        scored = so.reactive_batch(batch, [Model("base", F.lit(0.4), F.lit(0.7))], AS_OF_EVENTS)
        so.append_if_absent(scored, batch_id, f"{path}/store", "event_id")

    candidates.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = read_store(spark, f"{path}/store")
    return out.select("customer_id", "subject_id", "program_id", "event_id", F.col("scores")["base"]["value"].alias("score"))


@query(
    "t3_opt_out_stream",
    """select k from cand_core c where not exists (select 1 from events e where e.event_id % 31 <> 0 and e.event_type = 'error' and 'CUST-' || e.user_id = c.customer_id and 'prog-' || (1 + e.event_id % 5) = c.program_id)""",
    ("cand_core",),
)
def t3(spark, sf):
    events = parse_opt_out_events(stream_fixture(spark, sf, "event_json").drop("ts"), as_of=AS_OF_EVENTS)
    wanted = events.filter(F.col("parse_error").isNull() & (F.col("eventType") == "error"))
    tombstones = drain(so.opt_out_tombstones(wanted), "t3")
    return so.live_candidates(fixture(spark, sf, "cand_core"), tombstones).select("k")


@query(
    "t4_stream_throttle",
    """with recursive e as (select event_id, ts, event_id % 5 as dkey, epoch_us(ts) // 1000 as ms from events),
    o as (select dkey, min(ms) as ms from e group by dkey union all select o.dkey, (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) from o
      where (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) is not null),
    p as (select event_id, e.dkey, ts, o.ms as opening from e asof join o on o.dkey = e.dkey and o.ms <= e.ms)
    select event_id from (select event_id, row_number() over (partition by dkey, opening order by ts, event_id) as rn from p) where rn <= 3""",
)
def t4(spark, sf):
    src = stream_table(spark, sf, "events").select("event_id", "ts", (F.col("event_id") % 5).alias("program"))
    return drain(so.stream_throttle(src, "program", "ts", "event_id", 3, 7_200_000), "t4").select("event_id")


_WINDOWS = "select event_type, time_bucket(interval '1 hour', ts) as ws, count(*) as events, round(sum(value), 4) as total from events group by 1, 2"


@query("t5_metrics_batch", f"select event_type, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, events, total from ({_WINDOWS})")
def t5_batch(spark, sf):
    out = so.windowed_metrics(fixture(spark, sf, "events"), ["event_type"], "ts", "value", "1 hour")
    return out.withColumns({"window_start": iso(F.col("window_start")), "total": F.round("total", 4)})


@query(
    "t5_metrics_stream",
    f"""select event_type, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, events, total from ({_WINDOWS})
    where ws + interval '1' hour <= (select max(ts) from events) - interval '10' minute""",
)
def t5_stream(spark, sf):
    src = stream_table(spark, sf, "events").select("event_type", "ts", "value")
    out = drain(so.windowed_metrics(src, ["event_type"], "ts", "value", "1 hour", lateness=so.LATENESS), "t5")
    return out.withColumns({"window_start": iso(F.col("window_start")), "total": F.round("total", 4)})


_SLIDING = """select user_id % 10 as grp, w as ws, count(*) as events, round(sum(value), 4) as total
  from (select user_id, value, unnest([time_bucket(interval '5 minutes', ts) - to_minutes(cast(5 * i as int)) for i in range(12)]) as w from events) group by 1, 2"""


@query("t6_velocity_batch", f"select grp, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, events, total from ({_SLIDING})")
def t6_batch(spark, sf):
    df = fixture(spark, sf, "events").withColumn("grp", F.col("user_id") % 10)
    out = so.windowed_metrics(df, ["grp"], "ts", "value", "1 hour", "5 minutes")
    return out.withColumns({"window_start": iso(F.col("window_start")), "total": F.round("total", 4)})


@query(
    "t6_velocity_stream",
    f"""select grp, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, events, total from ({_SLIDING}) where ws + interval '1' hour <= (select max(ts) from events) - interval '10' minute""",
)
def t6_stream(spark, sf):
    src = stream_table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), "ts", "value")
    out = drain(so.windowed_metrics(src, ["grp"], "ts", "value", "1 hour", "5 minutes", so.LATENESS), "t6")
    return out.withColumns({"window_start": iso(F.col("window_start")), "total": F.round("total", 4)})


@query(
    "t6_velocity_exact_stream",
    """with e as (select event_id, user_id % 20 as grp, @EPOCH{ts} as sec, value from events),
    w as (select event_id, count(*) over r as n, sum(value) over r as s from e window r as (partition by grp order by sec range between 3600 preceding and current row))
    select event_id, n as window_count, round(s, 4) as window_amount, n <= 2 and s <= 100 as allowed from w""",
)
def t6_exact(spark, sf):
    src = stream_table(spark, sf, "events").select("event_id", "ts", "value", (F.col("user_id") % 20).alias("grp"))
    out = drain(so.velocity_alerts(src, "grp", "ts", "value", 2, 100.0), "t6x")
    return out.select("event_id", "window_count", F.round("window_amount", 4).alias("window_amount"), "allowed")


@query(
    "t6_changes_exact_stream",
    """with e as (select event_id, user_id % 20 as grp, @EPOCH{ts} as sec from events where event_type in ('click', 'signup'))
    select event_id, count(*) over r as recent_changes, count(*) over r >= 2 as alert from e window r as (partition by grp order by sec range between 600 preceding and current row)""",
)
def t6_changes(spark, sf):
    src = stream_table(spark, sf, "events").filter("event_type in ('click', 'signup')").select("event_id", "ts", (F.col("user_id") % 20).alias("grp"))
    out = drain(so.velocity_stream(src, ["grp"], "ts", window_s=600), "t6c")
    return out.select("event_id", F.col("window_count").alias("recent_changes"), (F.col("window_count") >= 2).alias("alert"))


@query(
    "t7_route_stream",
    f"""select event_id, 'order-confirmed' as rule_id from {_ROUTED} where source = 'orders' and event_type = 'purchase' and state = 'CONFIRMED'
    union all select event_id, 'renewal' from {_ROUTED} where source = 'video' and state in ('UPCOMING', 'FAILED')
    union all select event_id, 'long-view' from {_ROUTED} where event_type = 'view' and category in ('Electronics', 'Computers') and value >= 30
    union all select event_id, 'cart' from {_ROUTED} where source = 'shop' and event_type = 'click' and value >= 50""",
)
def t7(spark, sf):
    src = stream_table(spark, sf, "events").selectExpr(
        "event_id", "event_type", "value", "case event_id % 3 when 0 then 'orders' when 1 then 'video' else 'shop' end as source",
        "case event_id % 4 when 0 then 'CONFIRMED' when 1 then 'UPCOMING' when 2 then 'FAILED' else 'NEW' end as state",
        "case event_id % 5 when 0 then 'Electronics' when 1 then 'Computers' else 'Books' end as category",
    )
    return drain(so.route_stream(src, route_rules()).select("event_id", "rule_id"), "t7")


@query("t8_stream_redact", f"select conv_id, turn, md5({all_sql('text')}) as digest from conversations")
def t8(spark, sf):
    out = drain(so.stream_redact(stream_table(spark, sf, "conversations").select("conv_id", "turn", "text")), "t8")
    return out.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "t9_open_tracking_stream",
    "select d.delivery_id, strftime(opened_at, '%Y-%m-%d %H:%M:%S') as opened_at from deliveries d join opens o on o.delivery_id = d.delivery_id and opened_at between sent_at and sent_at + interval '2' hour",
    ("deliveries", "opens"),
)
def t9(spark, sf):
    d = stream_fixture(spark, sf, "deliveries").select("delivery_id", "sent_at")
    o = stream_fixture(spark, sf, "opens").select("delivery_id", "opened_at")
    return drain(so.open_tracking_stream(d, o), "t9").select("delivery_id", iso(F.col("opened_at")).alias("opened_at"))


@query(
    "t9_unopened_stream",
    """select delivery_id from deliveries d where not exists (select 1 from opens o where o.delivery_id = d.delivery_id and opened_at between sent_at and sent_at + interval '2' hour)
    and sent_at + interval '2' hour < least((select max(sent_at) from deliveries), (select max(opened_at) from opens)) - interval '1' hour""",
    ("deliveries", "opens"),
)
def t9_unopened(spark, sf):
    d = stream_fixture(spark, sf, "deliveries").select("delivery_id", "sent_at")
    o = stream_fixture(spark, sf, "opens").select("delivery_id", "opened_at")
    return drain(so.unopened_stream(d, o), "t9u").select("delivery_id")
