"""Queries for D1-D21."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.operators import delivery as dl
from beckon.operators import filters as fl
from beckon.operators import metrics as me
from beckon.operators import state as st
from beckon.plans.fixtures import AS_OF_EVENTS, AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query

PLAN_SQL = """select e.event_id, e.customer_id, e.program_id, template_id, exists (select 1 from opt_outs o where o.customer_id = e.customer_id and (o.program_id is null or o.program_id = e.program_id)) as opted,
  (select count(*) from deliveries d where d.customer_id = e.customer_id and d.program_id = e.program_id and d.sent_at < timestamp '2024-01-20'
    and d.sent_at >= timestamp '2024-01-20' - case when e.program_id = 'prog-1' then interval '14' day else interval '7' day end) as prior,
  case when e.program_id = 'prog-1' then 4 else 3 end as cap from customer_event e left join templates t on t.program_id = e.program_id"""
CAPS = {"prog-1": (4, 14)}


def event_candidates(spark, sf):
    return fixture(spark, sf, "customer_event").select("event_id", "customer_id", "program_id", "marketplace", "subject_type", "subject_id", "event_date")


def email_plan(spark, sf, within_batch):
    return dl.plan_email(
        event_candidates(spark, sf), fixture(spark, sf, "templates"), fixture(spark, sf, "opt_outs"), fixture(spark, sf, "deliveries"), "2024-01-20 00:00:00", "camp-x",
        "event_id", CAPS, within_batch, F.col("event_id") % 19 == 0,
    )


@query(
    "d1_plan_email",
    f"""with p as ({PLAN_SQL}), c as (select event_id, case when template_id is null then 'NO_TEMPLATE' when opted then 'OPTED_OUT' when prior >= cap then 'FREQUENCY_CAP_EXCEEDED' when event_id % 19 = 0 then 'SEND_FAILED' end as error_code from p)
    select event_id, error_code, case when error_code is null then 'delivered' else 'failed' end as status, case when error_code is not null then error_code in ('FREQUENCY_CAP_EXCEEDED', 'SEND_FAILED') end as retryable from c""",
    ("customer_event", "templates", "opt_outs", "deliveries"),
)
def d1(spark, sf):
    return email_plan(spark, sf, False).select("event_id", "error_code", "status", "retryable")


@query(
    "d1_plan_email_within_batch",
    f"""with p as ({PLAN_SQL}), r as (select *, row_number() over (partition by customer_id, program_id, (template_id is null or opted) order by event_id) as rn from p)
    select event_id, case when template_id is null then 'NO_TEMPLATE' when opted then 'OPTED_OUT' when prior + rn > cap then 'FREQUENCY_CAP_EXCEEDED' when event_id % 19 = 0 then 'SEND_FAILED' end as error_code from r""",
    ("customer_event", "templates", "opt_outs", "deliveries"),
)
def d1_batch(spark, sf):
    return email_plan(spark, sf, True).select("event_id", "error_code")


@query(
    "d2_plan_push",
    """select event_id, case when template_id is null then 'NO_TEMPLATE' when c_custkey is null or c_custkey % 3 = 0 then 'NO_DEVICE_TOKEN' end as error_code,
    case when template_id is not null and c_custkey % 3 <> 0 then 1 + c_custkey % 3 end as payload_devices
    from customer_event e left join templates t on t.program_id = e.program_id left join customer on 'CUST-' || c_custkey = e.customer_id""",
    ("customer_event", "templates"),
)
def d2_push(spark, sf):
    out = dl.plan_push(event_candidates(spark, sf), fixture(spark, sf, "templates"), fixture(spark, sf, "device_tokens"), "camp-x")
    return out.select("event_id", "error_code", F.get_json_object("payload", "$.device_count").cast("bigint").alias("payload_devices"))


@query(
    "d2_plan_in_app",
    "select event_id, case when template_id is null then 'NO_TEMPLATE' end as error_code, case when template_id is not null then subject_id end as card_subject from customer_event left join templates using (program_id)",
    ("customer_event", "templates"),
)
def d2_in_app(spark, sf):
    out = dl.plan_in_app(event_candidates(spark, sf), fixture(spark, sf, "templates"), "camp-x")
    return out.select("event_id", "error_code", F.get_json_object("payload", "$.subject_id").alias("card_subject"))


@query(
    "d2_plan_voice",
    """select event_id, case when template_id is null then 'NO_TEMPLATE' when voice_user_id is null then 'NO_VOICE_USER_ID' end as error_code
    from customer_event e left join templates t on t.program_id = e.program_id left join voice_ids v on v.customer_id = e.customer_id""",
    ("customer_event", "templates", "voice_ids"),
)
def d2_voice(spark, sf):
    return dl.plan_voice(event_candidates(spark, sf), fixture(spark, sf, "templates"), fixture(spark, sf, "voice_ids"), "camp-x").select("event_id", "error_code")


@query(
    "d3_shadow_delivery",
    """select event_id, event_id % 4 = 0 as shadow_mode, case when event_id % 4 <> 0 and template_id is null then 'failed' else 'delivered' end as status,
    case when event_id % 4 = 0 then 'shadow-in-app-' || sha256(customer_id || '|' || subject_id || '|camp-x') when template_id is not null then sha256(customer_id || '|' || subject_id || '|' || program_id || '|in-app|camp-x') end as delivery_id
    from customer_event left join templates using (program_id)""",
    ("customer_event", "templates"),
)
def d3(spark, sf):
    plan = dl.plan_in_app(event_candidates(spark, sf), fixture(spark, sf, "templates"), "camp-x")
    return dl.shadow_delivery(plan, F.col("event_id") % 4 == 0, "in-app", "camp-x").select("event_id", "shadow_mode", "status", "delivery_id")


@query("d4_unsubscribe_link", "select k, 'https://mail.test/unsub?customerId=' || customer_id || '&programId=' || program_id as link from cand_core", ("cand_core",))
def d4(spark, sf):
    return fixture(spark, sf, "cand_core").select("k", dl.unsubscribe_link("https://mail.test/unsub", F.col("customer_id"), F.col("program_id")).alias("link"))


TRACK = """(select event_id - event_id % 4 as delivery_id, case event_id % 4 when 0 then 'DELIVERED' when 1 then 'OPENED' when 2 then 'CLICKED' else 'BOUNCED' end as event_status, ts as event_at from events where user_id % 3 <> 0)"""


@query(
    "d5_apply_tracking_events",
    f"""select d.delivery_id, coalesce(max_by(event_status, event_at), 'SENT') as tracking_status from deliveries d left join {TRACK} t on t.delivery_id = d.delivery_id group by 1""",
    ("deliveries",),
)
def d5(spark, sf):
    events = fixture(spark, sf, "events").filter("user_id % 3 <> 0").selectExpr(
        "event_id - event_id % 4 as delivery_id", "case event_id % 4 when 0 then 'DELIVERED' when 1 then 'OPENED' when 2 then 'CLICKED' else 'BOUNCED' end as event_status", "ts as event_at"
    )
    return dl.apply_tracking_events(fixture(spark, sf, "deliveries"), events).select("delivery_id", "tracking_status")


KEYS = ["customer_id", "subject_id"]


def store_rows(spark, sf):
    return fixture(spark, sf, "cand_core").selectExpr("customer_id", "subject_id", "program_id", "version", "updated_at", "order_value", "k")


NEW_SQL = "(select customer_id, subject_id, k, k + 10 as seq from cand_core where k % 8 in (0, 1) union all select customer_id, subject_id, k, k + 5 as seq from cand_core where k % 8 = 1)"


def new_rows(spark, sf):
    c = fixture(spark, sf, "cand_core").select("customer_id", "subject_id", "k")
    a = c.filter("k % 8 in (0, 1)").withColumn("seq", F.col("k") * 2)
    return a.unionByName(c.filter("k % 8 = 1").withColumn("seq", F.col("k") * 2 - 1))


@query("d6_create_if_absent", "select customer_id, subject_id from cand_core where k % 8 <> 2 and k % 8 <> 3", ("cand_core",))
def d6(spark, sf):
    store = fixture(spark, sf, "cand_core").filter("k % 8 in (0, 4, 5, 6, 7)").select(*KEYS, "k")
    return st.create_if_absent(store, new_rows(spark, sf), KEYS, "seq")[0].select(*KEYS)


@query("d6_create_conflicts", "select k * 2 as seq from cand_core where k % 8 in (0, 1)", ("cand_core",))
def d6_conflicts(spark, sf):
    store = fixture(spark, sf, "cand_core").filter("k % 8 in (0, 4, 5, 6, 7)").select(*KEYS, "k")
    return st.create_if_absent(store, new_rows(spark, sf), KEYS, "seq")[1].select("seq")


def version_updates(spark, sf):
    u = fixture(spark, sf, "cand_core").filter("k % 4 = 0").selectExpr(
        "case when k % 20 = 0 then concat(customer_id, '-x') else customer_id end as customer_id", "subject_id", "case when k % 12 = 0 then version + 1 else version end as expected_version",
        "cast(-1 as double) as order_value",
    )
    return u


@query(
    "d7_update_if_version",
    """select k, case when k % 4 = 0 and k % 20 <> 0 and k % 12 <> 0 then version + 1 else version end as version, case when k % 4 = 0 and k % 20 <> 0 and k % 12 <> 0 then -1.0e0 else order_value end as order_value,
    strftime(case when k % 4 = 0 and k % 20 <> 0 and k % 12 <> 0 then timestamp '2001-08-02' else updated_at end, '%Y-%m-%d %H:%M:%S') as updated_at from cand_core""",
    ("cand_core",),
)
def d7(spark, sf):
    after, _ = st.update_if_version(store_rows(spark, sf), version_updates(spark, sf), KEYS, ["order_value"], AS_OF_ORDERS)
    return after.select("k", "version", "order_value", iso(F.col("updated_at")).alias("updated_at"))


@query(
    "d7_conflicts",
    "select subject_id, case when k % 20 = 0 then 'NOT_FOUND' else 'VERSION_MISMATCH' end as conflict from cand_core where k % 4 = 0 and (k % 20 = 0 or k % 12 = 0)",
    ("cand_core",),
)
def d7_conflicts(spark, sf):
    _, bad = st.update_if_version(store_rows(spark, sf), version_updates(spark, sf), KEYS, ["order_value"], AS_OF_ORDERS)
    return bad.select("subject_id", "conflict")


@query("d8_delete_keys", "select k from cand_core where k % 7 <> 0", ("cand_core",))
def d8(spark, sf):
    store = store_rows(spark, sf)
    keys = store.filter("k % 7 = 0").select(*KEYS)
    return st.delete_keys(st.delete_keys(store, keys, KEYS), keys, KEYS).select("k")


@query(
    "d9_upsert",
    "select subject_id, case when k % 6 = 0 and k % 10 <> 0 then -2.0e0 else order_value end as order_value from cand_core",
    ("cand_core",),
)
def d9(spark, sf):
    store = store_rows(spark, sf)
    rows = store.filter("k % 6 = 0")
    rows = rows.withColumn("order_value", F.lit(-1.0)).unionByName(rows.withColumns({"order_value": F.lit(-2.0), "version": F.col("version") + 1}))
    ok, _ = st.upsert_report(rows, F.col("k") % 10 != 0)
    return st.upsert(store, ok, KEYS, "version").select("subject_id", "order_value")


@query("d9_failed", "select subject_id, version from cand_core where k % 6 = 0 and k % 10 = 0", ("cand_core",))
def d9_failed(spark, sf):
    return st.upsert_report(store_rows(spark, sf).filter("k % 6 = 0"), F.col("k") % 10 != 0)[1].select("subject_id", "version")


@query(
    "d10_mark_consumed",
    """select k, k % 3 = 0 as consumed, case when k % 3 = 0 then case when k % 2 = 0 then 'email' else 'push' end end as channel,
    case when k % 3 = 0 then strftime(updated_at + interval '1' day, '%Y-%m-%d') end as consumed_on, case when k % 3 = 0 then version + 1 else version end as version from cand_core""",
    ("cand_core",),
)
def d10(spark, sf):
    base = fixture(spark, sf, "cand_core").filter("k % 3 = 0")
    sent = base.selectExpr("k", "updated_at + interval '1' day as sent_at", "case when k % 2 = 0 then 'email' else 'push' end as channel")
    sent = sent.unionByName(base.selectExpr("k", "updated_at + interval '3' day as sent_at", "'late' as channel"))
    out = st.mark_consumed(candidates(spark, sf, delivery=False), sent, ["k"])
    return out.select(
        "k", "attributes.consumed", F.col("attributes.consumed_channel").alias("channel"), F.date_format("attributes.consumed_at", "yyyy-MM-dd").alias("consumed_on"), "metadata.version"
    )


@query(
    "d11_refresh_candidates",
    """select k, version + 1 as version, email and (expires_at > timestamp '1998-06-15' and timestamp '1998-06-15' - event_date < interval '30' day and (email or in_app or push or sms)) as email from cand_core""",
    ("cand_core",),
)
def d11(spark, sf):
    as_of = "1998-06-15 00:00:00"
    out = st.refresh_candidates(candidates(spark, sf, delivery=False), fl.serving_eligible(as_of), as_of)
    return out.select("k", "metadata.version", F.col("attributes.channel_eligibility")["email"].alias("email"))


@query("d12_opt_out_remaining", "select k from cand_core where ck % 13 <> 0 and not (ck % 17 = 0 and program_id = 'prog-1')", ("cand_core",))
def d12(spark, sf):
    return st.opt_out_delete(fixture(spark, sf, "cand_core"), fixture(spark, sf, "opt_outs"))[0].select("k")


@query(
    "d12_opt_out_counts",
    """select customer_id, count(k) as deleted from (select distinct customer_id from opt_outs) left join cand_core c using (customer_id)
    where k is null or ck % 13 = 0 or (ck % 17 = 0 and program_id = 'prog-1') group by 1
    union all select customer_id, 0 from (select distinct customer_id from opt_outs) o where not exists (select 1 from cand_core c where c.customer_id = o.customer_id and (ck % 13 = 0 or (ck % 17 = 0 and program_id = 'prog-1')))
      and exists (select 1 from cand_core c where c.customer_id = o.customer_id)""",
    ("cand_core", "opt_outs"),
)
def d12_counts(spark, sf):
    return st.opt_out_delete(fixture(spark, sf, "cand_core"), fixture(spark, sf, "opt_outs"))[1]


@query(
    "d13_status_lifecycle",
    """select k, case when k % 6 in (3, 4) then 'ENGAGED' when timestamp '1998-06-15' > expires_at then 'EXPIRED' when k % 6 in (1, 2) then 'SENT' else 'PENDING' end as status from cand_core""",
    ("cand_core",),
)
def d13(spark, sf):
    base = fixture(spark, sf, "cand_core")
    events = base.filter("k % 6 between 1 and 4").selectExpr("k", "'SENT' as engagement").unionByName(base.filter("k % 6 in (3, 4)").selectExpr("k", "case when k % 6 = 3 then 'OPENED' else 'RESPONDED' end as engagement"))
    return st.status_lifecycle(base, events, "1998-06-15 00:00:00", ["k"]).select("k", "status")


@query(
    "d14_engagement_history",
    "select event_id, event_type from events where ts >= timestamp '2024-01-31' + interval '75' day - interval '90' day",
)
def d14(spark, sf):
    e = fixture(spark, sf, "events").select("event_id", "event_type", "ts")
    return st.engagement_history(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "2024-04-15 00:00:00", "ts").select("event_id", "event_type")


@query(
    "d15_workflow_completed_event",
    """with s as (select execution_id, count(*) filter (where stage = 'store' and outcome <> 'error') as stored, count(*) filter (where stage in ('etl', 'score', 'store') and outcome = 'error') = 0 as ok from stage_log group by 1)
    select 'WorkflowCompleted' as detail_type, execution_id, '{"executionId":"' || execution_id || '","totalStored":' || stored || ',"success":' || ok || ',"timestamp":"2024-01-31T00:00:00Z"}' as detail from s""",
    ("stage_log",),
)
def d15(spark, sf):
    return st.workflow_completed_event(me.workflow_summary(fixture(spark, sf, "stage_log")), AS_OF_EVENTS)


@query(
    "d16_render_template",
    """select k, 'Hi ' || customer_id || ', your ' || subject_type || ' from ' || marketplace || ': ' || coalesce(timing_window, '') || ' {left}' as message, true as missing_variable,
    customer_id || ' ' || coalesce(timing_window, '') as short_message, timing_window is null as short_missing from cand_core""",
    ("cand_core",),
)
def d16(spark, sf):
    variables = {"customerName": "customer_id", "kind": "subject_type", "place": "marketplace", "window": "timing_window"}
    df = fixture(spark, sf, "cand_core").select("k", "customer_id", "subject_type", "marketplace", "timing_window")
    out = dl.render_template(df, "Hi {{customerName}}, your {kind} from {place}: {{window}} {left}", variables)
    out = out.withColumnRenamed("missing_variable", "__first")
    short = dl.render_template(out, "{customerName} {window}", variables, "short_message").withColumnRenamed("missing_variable", "short_missing")
    return short.withColumnRenamed("__first", "missing_variable").select("k", "message", "missing_variable", "short_message", "short_missing")


@query(
    "d17_schedule_local_send",
    """select event_id, strftime(case when cast(l as time) <= time '10:00:00' then date_trunc('day', l) + interval '10' hour - off else date_trunc('day', l) + interval '34' hour - off end, '%Y-%m-%d %H:%M:%S') as send_at
    from (select event_id, case event_id % 3 when 0 then interval '-5' hour when 1 then interval '1' hour else interval '9' hour end as off, ts + interval '60' minute + off as l from events)""",
)
def d17(spark, sf):
    zone = F.when(F.col("event_id") % 3 == 0, "America/New_York").when(F.col("event_id") % 3 == 1, "Europe/Berlin").otherwise("Asia/Tokyo")
    return fixture(spark, sf, "events").select("event_id", iso(dl.schedule_local_send(F.col("ts"), zone)).alias("send_at"))


@query("d18_pick_channel", "select k, case when push then 'push' when email then 'email' when sms then 'sms' end as channel from cand_core", ("cand_core",))
def d18(spark, sf):
    return candidates(spark, sf, delivery=False).select("k", dl.pick_channel(F.col("attributes.channel_eligibility"), ["push", "email", "sms"]).alias("channel"))


@query(
    "d19_bundle_top_n",
    """select customer_id, string_agg(subject_id, ',' order by rn) as subjects from (select customer_id, subject_id, row_number() over (partition by customer_id order by coalesce(quality, 0) desc, k) as rn from cand_core) where rn <= 5 group by 1""",
    ("cand_core",),
)
def d19(spark, sf):
    out = dl.bundle_top_n(fixture(spark, sf, "cand_core"), "customer_id", "subject_id", [F.coalesce("quality", F.lit(0.0)).desc(), F.asc("k")])
    return out.withColumn("subjects", F.array_join("subjects", ","))


@query("d20_enforce_max_length", "select conv_id, turn, left(text, 160) as body, length(text) > 160 as too_long from conversations")
def d20(spark, sf):
    cut, long = dl.enforce_max_length(F.col("text"))
    return fixture(spark, sf, "conversations").select("conv_id", "turn", cut.alias("body"), long.alias("too_long"))


STEPS = [("email", 3600, False), ("sms", 86400, True), ("push", 259200, True)]


@query(
    "d21_follow_up_sequence",
    """with s as (select event_id, customer_id, event_date from customer_event where event_type = 'click'), steps(channel, delay_s, cond) as (values ('email', 3600, false), ('sms', 86400, true), ('push', 259200, true))
    select event_id, channel, strftime(event_date + to_seconds(delay_s), '%Y-%m-%d %H:%M:%S') as send_at from s cross join steps
    where not (cond and exists (select 1 from conversions c where c.customer_id = s.customer_id and converted_at >= event_date and converted_at <= event_date + to_seconds(delay_s)))""",
    ("customer_event", "conversions"),
)
def d21(spark, sf):
    starts = fixture(spark, sf, "customer_event").filter("event_type = 'click'").select("event_id", "customer_id", "event_date")
    return dl.follow_up_sequence(starts, fixture(spark, sf, "conversions"), STEPS).select("event_id", "channel", iso(F.col("send_at")).alias("send_at"))
