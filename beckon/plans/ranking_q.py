"""Queries for W1-W19 and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.operators import enrichment as en
from beckon.operators import ranking as rk
from beckon.operators import velocity as ve
from beckon.operators.mapping import context_id, score_value
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query

PUSH_PRIORITY = "case subject_type when 'event' then 0 when 'product' then 1 when 'service' then 2 else 99 end"
EMAIL_PRIORITY = "case subject_type when 'product' then 0 when 'service' then 1 when 'event' then 2 else 99 end"
BEST = "greatest(coalesce(trust, 0), coalesce(fraud, 0), coalesce(quality, 0))"


def cands(spark, sf):
    return candidates(spark, sf, delivery=False)


@query(
    "w1_rank_default",
    f"select k, row_number() over (partition by customer_id order by coalesce(quality, 0) desc, event_date desc, {PUSH_PRIORITY}, k) as rank from cand_core",
    ("cand_core",),
)
def w1(spark, sf):
    return rk.rank(cands(spark, sf), ["customer_id"], rk.by_default("push", "quality", "k")).select("k", "rank")


@query(
    "w2_rank_by_score",
    f"select k, row_number() over (partition by customer_id order by {BEST} desc, k) as rank from cand_core",
    ("cand_core",),
)
def w2(spark, sf):
    return rk.rank(cands(spark, sf), ["customer_id"], rk.by_score("k", 65536)).select("k", "rank")


@query("w3_rank_by_recency", "select k, row_number() over (partition by customer_id order by event_date desc, k) as rank from cand_core", ("cand_core",))
def w3(spark, sf):
    return rk.rank(cands(spark, sf), ["customer_id"], rk.by_recency("k")).select("k", "rank")


@query(
    "w4_rank_composite",
    f"select k, row_number() over (partition by marketplace order by event_date desc, {BEST} desc, k) as rank from cand_core",
    ("cand_core",),
)
def w4(spark, sf):
    df = cands(spark, sf).withColumn("marketplace", context_id("marketplace"))
    return rk.rank(df, ["marketplace"], rk.composite([rk.by_score("k", 65536), rk.by_recency("k")])).select("k", "rank")


PERSONAL = """select c.k, c.customer_id, coalesce(quality, 0.5e0) * 0.4e0
  + (case when t.total is null or t.total = 0 then 0.5e0 else least(coalesce(o.engagements, 0)::double / t.total * 2.0e0, 1.0e0) end) * 0.25e0
  + greatest(0.0e0, 1.0e0 - datediff('day', c.event_date, timestamp '2001-08-02')::double / coalesce(t.preferred_window, 7)) * 0.15e0
  + coalesce(t.channel_pref, 0.5e0) * 0.1e0
  + least(0.5e0 + (case when coalesce(order_value > 100 and t.likes_high_value, false) then 0.2e0 else 0.0e0 end) + (case when coalesce(media_eligible and t.likes_media, false) then 0.2e0 else 0.0e0 end), 1.0e0) * 0.1e0 as personal
  from cand_core c left join (select customer_id, sum(engagements) as total, any_value(channel_pref) as channel_pref, any_value(likes_high_value) as likes_high_value, any_value(likes_media) as likes_media,
    any_value(preferred_window) as preferred_window from customer_context group by 1) t on t.customer_id = c.customer_id
  left join customer_context o on o.customer_id = c.customer_id and o.subject_type = c.subject_type"""


@query("w5_rank_personalized", f"select k, row_number() over (partition by customer_id order by personal desc, k) as rank from ({PERSONAL})", ("cand_core", "customer_context"))
def w5(spark, sf):
    df = en.join_customer_context(cands(spark, sf), fixture(spark, sf, "customer_context"))
    scored = rk.personalized_score(df, AS_OF_ORDERS, "quality", "email")
    return rk.rank(scored, ["customer_id"], rk.by_personal_score("k")).select("k", "rank")


@query("w6_personal_scores", f"select k, round(personal, 8) as personal_score from ({PERSONAL})", ("cand_core", "customer_context"))
def w6(spark, sf):
    df = en.join_customer_context(cands(spark, sf), fixture(spark, sf, "customer_context"))
    return rk.personalized_score(df, AS_OF_ORDERS, "quality", "email").select("k", F.round("personal_score", 8).alias("personal_score"))


SERVE_SQL = f"""select request_id, k, row_number() over (partition by request_id order by coalesce(quality, 0) desc, event_date desc,
   case channel when 'email' then {EMAIL_PRIORITY} when 'push' then {PUSH_PRIORITY} else 99 end, k) as rank, include_scores, quality, max_results
  from requests r join cand_core c on c.customer_id = r.customer_id and (r.program_id is null or r.program_id = c.program_id)
  and case when channel is null then true when channel = 'email' then email else push end"""


@query(
    "w7_serve",
    f"select request_id, k, rank, case when include_scores then quality end as quality from ({SERVE_SQL}) where rank <= max_results",
    ("requests", "cand_core"),
)
def w7(spark, sf):
    out = rk.serve(fixture(spark, sf, "requests"), cands(spark, sf), "quality", "k")
    return out.select("request_id", "k", "rank", score_value("quality").alias("quality"))


@query(
    "w7_serve_refreshed",
    f"""select request_id, k, rank from ({SERVE_SQL} and expires_at > timestamp '2001-07-20' and timestamp '2001-07-20' - event_date < interval '30' day and (email or in_app or push or sms)) where rank <= max_results""",
    ("requests", "cand_core"),
)
def w7b(spark, sf):
    return rk.serve(fixture(spark, sf, "requests"), cands(spark, sf), "quality", "k", "2001-07-20 00:00:00").select("request_id", "k", "rank")


@query(
    "w8_serve_batch",
    f"select r.request_id, r.customer_id, count(s.k) as results from requests r left join (select request_id, k from ({SERVE_SQL}) where rank <= max_results) s on s.request_id = r.request_id group by 1, 2",
    ("requests", "cand_core"),
)
def w8(spark, sf):
    return rk.serve_batch(fixture(spark, sf, "requests"), cands(spark, sf), "quality", "k")


W9_KEY = "'SCORE#' || printf('%.6f', coalesce(quality, 0)) || '#CUSTOMER#' || customer_id"


@query(
    "w9_top_by_program_channel",
    f"select k, {W9_KEY} as sort_key from cand_core where program_id = 'prog-2' and email order by sort_key desc, subject_id desc limit 100",
    ("cand_core",),
)
def w9(spark, sf):
    return rk.top_by_program_channel(cands(spark, sf), "prog-2", "email", "quality").select("k", "sort_key")


@query(
    "w10_by_program_date",
    "select k from cand_core where program_id = 'prog-2' and created_at >= timestamp '1998-06-10' and created_at < timestamp '1998-06-11' order by created_at, customer_id, subject_id limit 50",
    ("cand_core",),
)
def w10(spark, sf):
    return rk.by_program_date(cands(spark, sf), "prog-2", "1998-06-10", 50).select("k")


@query(
    "w11_top_n_per_group",
    "select k, subject_type, rank from (select k, subject_type, row_number() over (partition by subject_type order by quality desc, k) as rank from cand_core where quality >= 0.1) where rank <= 1500",
    ("cand_core",),
)
def w11(spark, sf):
    return rk.top_n_per_group(fixture(spark, sf, "cand_core"), ["subject_type"], "quality", "k", 1500, 0.1, 65536).select("k", "subject_type", "rank")


@query(
    "w11_top_n_small",
    "select k, marketplace, rank from (select k, marketplace, row_number() over (partition by marketplace order by coalesce(quality, 0) desc, k) as rank from cand_core) where rank <= 20",
    ("cand_core",),
)
def w11b(spark, sf):
    return rk.top_n_per_group(fixture(spark, sf, "cand_core"), ["marketplace"], "quality", "k", 20).select("k", "marketplace", "rank")


@query(
    "w12_by_status_min_score",
    """select k, row_no, (row_no - 1) // 100 as page_no from (select k, row_number() over (order by quality desc, k) as row_no from cand_core where k % 3 = 0 and quality >= 0.4)""",
    ("cand_core",),
)
def w12(spark, sf):
    df = fixture(spark, sf, "cand_core").withColumn("status", F.when(F.col("k") % 3 == 0, "PENDING").otherwise("SENT"))
    return rk.by_status_min_score(df, "PENDING", 0.4, False, 100, "created_at", "quality", "k").select("k", "row_no", "page_no")


@query(
    "w12_newest_first",
    """select k, row_no, (row_no - 1) // 100 as page_no from (select k, row_number() over (order by created_at desc, k) as row_no from cand_core where k % 3 = 0 and quality >= 0.4)""",
    ("cand_core",),
)
def w12b(spark, sf):
    df = fixture(spark, sf, "cand_core").withColumn("status", F.when(F.col("k") % 3 == 0, "PENDING").otherwise("SENT"))
    return rk.by_status_min_score(df, "PENDING", 0.4, True, 100, "created_at", "quality", "k").select("k", "row_no", "page_no")


@query(
    "w12_keyset_page",
    "select k, quality from cand_core where quality < 0.9 or (quality = 0.9 and k > 50) order by quality desc, k limit 100",
    ("cand_core",),
)
def w12c(spark, sf):
    df = fixture(spark, sf, "cand_core").filter("quality is not null")
    return rk.keyset_page(df, "quality", "k", 100, (0.9, 50)).select("k", "quality")


@query(
    "w13_fixed_window_throttle",
    """with recursive e as (select event_id, ts, 'prog-' || (1 + event_id % 5) as dkey, epoch_us(ts) // 1000 as ms from events),
    o as (select dkey, min(ms) as ms from e group by dkey union all select o.dkey, (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) from o
      where (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) is not null),
    p as (select event_id, e.dkey, ts, o.ms as opening from e asof join o on o.dkey = e.dkey and o.ms <= e.ms)
    select event_id, opening as window_start_ms, row_number() over (partition by dkey, opening order by ts, event_id) <= 3 as allowed from p""",
)
def w13(spark, sf):
    df = fixture(spark, sf, "events").select("event_id", "ts", F.concat(F.lit("prog-"), 1 + F.col("event_id") % 5).alias("program_id"))
    return rk.fixed_window_throttle(df, "program_id", "ts", "event_id", 3, 7_200_000).select("event_id", "window_start_ms", "allowed")


@query(
    "w13_throttle_permits",
    """with recursive e as (select event_id, ts, event_id % 5 as dkey, 1 + (event_id * 7) % 3 as n, epoch_us(ts) // 1000 as ms from events),
    o as (select dkey, min(ms) as ms from e group by dkey union all select o.dkey, (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) from o
      where (select min(e.ms) from e where e.dkey = o.dkey and e.ms >= o.ms + 7200000) is not null),
    p as (select event_id, n, e.dkey || '-' || o.ms as w, row_number() over (partition by e.dkey, o.ms order by ts, event_id) as rn from e asof join o on o.dkey = e.dkey and o.ms <= e.ms),
    f as (select w, rn, event_id, n <= 4 as allowed, case when n <= 4 then n else 0 end as used from p where rn = 1
      union all select p.w, p.rn, p.event_id, f.used + p.n <= 4, case when f.used + p.n <= 4 then f.used + p.n else f.used end from f join p on p.w = f.w and p.rn = f.rn + 1)
    select event_id, allowed from f""",
)
def w13_permits(spark, sf):
    df = fixture(spark, sf, "events").select("event_id", "ts", (F.col("event_id") % 5).alias("program"), (1 + (F.col("event_id") * 7) % 3).alias("n"))
    return rk.fixed_window_throttle(df, "program", "ts", "event_id", 4, 7_200_000, permits="n").select("event_id", "allowed")


@query(
    "w14_tumbling_throttle",
    "select event_id, row_number() over (partition by event_id % 5, time_bucket(interval '1 hour', ts) order by ts, event_id) <= 2 as allowed from events",
)
def w14(spark, sf):
    df = fixture(spark, sf, "events").select("event_id", "ts", (F.col("event_id") % 5).alias("program"))
    return rk.tumbling_throttle(df, "program", "ts", "event_id", 2, "1 hour").select("event_id", "allowed")


@query(
    "w15_dequeue_fifo",
    "select delivery_id, channel, position from (select delivery_id, channel, row_number() over (partition by channel order by sent_at, delivery_id) as position from deliveries) where position <= 25",
    ("deliveries",),
)
def w15(spark, sf):
    return rk.dequeue_fifo(fixture(spark, sf, "deliveries"), 25, at="sent_at").select("delivery_id", "channel", "position")


@query(
    "w15_peek",
    "select delivery_id, channel, cast(1 as bigint) as position from deliveries where channel = 'email' order by sent_at, delivery_id limit 1",
    ("deliveries",),
)
def w15b(spark, sf):
    return rk.dequeue_fifo(fixture(spark, sf, "deliveries"), 1, "email", at="sent_at").select("delivery_id", "channel", "position")


CAP_SQL = """select event_id, allowed from (select c.event_id, count(*) filter (where s.program_id = c.program_id and s.sec >= c.sec - 604800) < 2
   and count(*) filter (where s.sec >= c.sec - 86400) < 4 and count(*) filter (where s.sec >= c.sec - 1209600) < 30 as allowed
  from (select event_id, customer_id, program_id, @EPOCH{event_date} as sec from customer_event) c
  left join (select customer_id, program_id, @EPOCH{sent_at} as sec from deliveries) s on s.customer_id = c.customer_id and s.sec < c.sec and s.sec >= c.sec - 1209600 group by c.event_id)"""


@query("w16_frequency_cap", CAP_SQL, ("customer_event", "deliveries"))
def w16(spark, sf):
    cand = fixture(spark, sf, "customer_event").select("event_id", "customer_id", "program_id", "event_date")
    sends = fixture(spark, sf, "deliveries").select("customer_id", "program_id", "sent_at")
    rules = [{"scope": "program", "max": 2, "window": "7d"}, {"scope": "global", "max": 4, "window": "24h"}, {"scope": "global", "max": 30, "window": "2w"}]
    return ve.frequency_cap(cand, sends, "event_date", "sent_at", rules).select("event_id", "allowed")


@query(
    "w17_version_monotonic_check",
    """with l as (select row_id, version, updated_at, lag(version) over w as pv, lag(updated_at) over w as pu from versions window w as (partition by entity_id order by version, row_id))
    select row_id, coalesce(version <> pv + 1 or updated_at < pu, false) as violation from l""",
    ("versions",),
)
def w17(spark, sf):
    return rk.version_monotonic_check(fixture(spark, sf, "versions"), "entity_id", "updated_at", "row_id", step=50).select("row_id", "violation")


@query(
    "w18_latest_per_key",
    "select entity_id, row_id, version from (select *, row_number() over (partition by entity_id order by version desc, row_id desc) as rn from versions) where rn = 1",
    ("versions",),
)
def w18(spark, sf):
    return rk.latest_per_key(fixture(spark, sf, "versions"), ["entity_id"], ["version", "row_id"]).select("entity_id", "row_id", "version")


@query(
    "w19_daily_quota",
    """select k, client_id, rank from (select k, client_id, daily_quota, row_number() over (partition by client_id, date_trunc('day', created_at) order by coalesce(quality, 0) desc, k) as rank
    from cand_core join clients using (program_id)) where rank <= daily_quota""",
    ("cand_core", "clients"),
)
def w19(spark, sf):
    df = fixture(spark, sf, "cand_core").join(fixture(spark, sf, "clients").select("client_id", "program_id", "daily_quota"), "program_id")
    out = rk.daily_quota(df, "client_id", F.date_trunc("day", "created_at"), "quality", "k", "daily_quota")
    return out.select("k", "client_id", "rank")
