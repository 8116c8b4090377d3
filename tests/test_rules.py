"""Hand-written edge rows: thresholds, nulls, expiry edges, conversions, masks, state conflicts."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from beckon.functions import redact as rd
from beckon.functions.convert import convert_type, days_between, is_iso_date, parse_instant
from beckon.functions.hashing import java_hash_bucket, sha_bucket
from beckon.operators import delivery as dl
from beckon.operators import experiments as ex
from beckon.operators import filters as fl
from beckon.operators import mapping as mp
from beckon.operators import metrics as me
from beckon.operators import ranking as rk
from beckon.operators import scoring as sc
from beckon.operators import state as st
from beckon.operators import velocity as ve
from beckon.schema import CANDIDATE

NOW = dt.datetime(2024, 1, 31)
AS_OF = "2024-01-31 00:00:00"
DAY = dt.timedelta(days=1)
SEC = dt.timedelta(seconds=1)


def cand(cid="c1", sid="s1", scores=None, event=NOW - DAY, window="7-14 days", value=100.0, media=True, channels=None, updated=NOW, expires=NOW + DAY, kind="product"):
    packed = {m: (m, v, c, t, None) for m, (v, c, t) in (scores or {}).items()}
    return (
        cid, [("marketplace", "US"), ("program", "p1")], (kind, sid, None), packed,
        (event, None, window, value, media, channels if channels is not None else {"email": True}, False, None, None),
        (NOW - DAY, updated, expires, 1, "w", "e", None), None,
    )


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CANDIDATE)


def codes(df, col):
    return [r[0] for r in df.select(col["reason_code"]).collect()]


def score(v, c=0.9):
    return (v, c, NOW)


def test_trust_thresholds_are_inclusive(spark):
    df = frame(
        spark, cand(scores={"trust": score(0.5)}), cand(scores={"trust": score(0.49)}), cand(), cand(scores={"trust": score(0.9), "fraud": score(0.5)}),
        cand(scores={"trust": score(0.9), "fraud": score(0.51)}),
    )
    assert codes(df, fl.filter_trust({}, "trust")) == [None, "TRUST_SCORE_LOW", "TRUST_SCORE_MISSING", None, "FRAUD_DETECTED"]


def test_quality_confidence_null_passes(spark):
    df = frame(spark, cand(scores={"quality": score(0.6, None)}), cand(scores={"quality": score(0.6, 0.7)}), cand(scores={"quality": score(0.6, 0.69)}), cand(scores={"quality": score(0.9)}, media=None))
    assert codes(df, fl.filter_quality({}, "q")) == [None, None, "CONFIDENCE_LOW", None]
    assert codes(df, fl.filter_quality({"requireMedia": True}, "q"))[3] == "MEDIA_INELIGIBLE"


def test_eligibility_order_and_empty_window(spark):
    df = frame(spark, cand(window=""), cand(window=None), cand(channels={"email": True, "sms": False}, window=None), cand())
    got = df.select(fl.filter_eligibility({"requiredChannels": ["sms", "email"]}, "e").alias("r")).select("r.*").collect()
    assert got[2].reason == "closed channels: sms"
    assert codes(df, fl.filter_eligibility({}, "e")) == ["TIMING_WINDOW_MISSING", "TIMING_WINDOW_MISSING", "TIMING_WINDOW_MISSING", None]
    assert codes(df, fl.filter_eligibility({"checkTimingWindow": False}, "e")) == [None] * 4


def test_business_rule_day_edges(spark):
    df = frame(spark, cand(event=NOW - 30 * DAY), cand(event=NOW - 31 * DAY + SEC), cand(event=NOW - 31 * DAY), cand(value=None), cand(value=50.0), cand(value=49.99))
    assert codes(df, fl.filter_business_rule({"maxDaysSinceEvent": 30}, "b", AS_OF)) == [None, None, "EVENT_TOO_OLD", None, None, None]
    assert codes(df, fl.filter_business_rule({"minOrderValue": 50.0}, "b", AS_OF))[3:] == ["ORDER_VALUE_MISSING", None, "ORDER_VALUE_LOW"]


def test_chain_first_rejection_wins_and_history_appends(spark):
    specs = [fl.FilterSpec("q", "quality", 2), fl.FilterSpec("t", "trust", 1), fl.FilterSpec("off", "eligibility", 0, False, {"requiredChannels": ["sms"]})]
    out = fl.filter_chain(frame(spark, cand(), cand(scores={"trust": score(0.9), "quality": score(0.9)})), specs, AS_OF).collect()
    assert out[0].rejection.filter_id == "t" and len(out[0].rejection_history) == 1
    assert out[1].rejection is None and out[1].rejection_history is None
    again = fl.filter_chain(frame(spark, cand()), list(reversed(specs)), AS_OF).collect()[0]
    assert again.rejection == out[0].rejection


def test_expiry_edges(spark):
    df = frame(spark, cand(expires=NOW), cand(expires=NOW + SEC), cand(expires=NOW - SEC))
    pick = lambda c: [r[0] for r in df.select(c).collect()]
    assert pick(fl.serving_eligible(AS_OF)) == [False, True, False]
    assert pick(fl.always_fresh_eligible(AS_OF)) == [True, True, False]
    assert pick(fl.is_expired(F.col("metadata.expires_at"), AS_OF)) == [False, False, True]
    assert pick(fl.remaining_seconds(F.col("metadata.expires_at"), AS_OF)) == [0, 1, -1]


def test_stale_edges(spark):
    half = dt.timedelta(hours=12)
    df = frame(spark, cand(updated=NOW - DAY), cand(updated=NOW - DAY + SEC), cand(scores={"m": (0.5, None, NOW - half)}), cand(scores={"m": (0.5, None, NOW - half + SEC)}))
    assert [r[0] for r in df.select(fl.serving_stale(AS_OF)).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(fl.rule_list_stale(AS_OF)).collect()][:2] == [False, False]


def test_event_age_exactly_thirty_days(spark):
    df = frame(spark, cand(event=NOW - 30 * DAY), cand(event=NOW - 30 * DAY + SEC), cand(channels={"email": False}))
    assert [r[0] for r in df.select(fl.serving_eligible(AS_OF)).collect()] == [False, True, False]


def test_conversions(spark):
    df = spark.createDataFrame([("TRUE",), ("yes",), ("12",), ("12.5",), (" 7",), ("a, b ,c",), ("99999999999",), (None,)], "x string")
    col = lambda kind: [r[0] for r in df.select(convert_type(F.col("x"), kind)).collect()]
    assert col("BOOLEAN")[:2] == [True, False] and col("BOOLEAN")[7] is None
    assert col("INTEGER") == [None, None, 12, None, None, None, None, None]
    assert col("LONG")[6] == 99999999999
    assert col("DOUBLE")[2:5] == [12.0, 12.5, 7.0]
    assert col("LIST")[5] == ["a", "b", "c"] and col("LIST")[7] is None
    n = spark.createDataFrame([(3.9,), (-3.9,), (0.0,)], "x double")
    kind = n.schema["x"].dataType
    assert [r[0] for r in n.select(convert_type(F.col("x"), "INTEGER", kind)).collect()] == [3, -3, 0]
    assert [r[0] for r in n.select(convert_type(F.col("x"), "BOOLEAN", kind)).collect()] == [True, True, False]


def test_zoneless_time_fails_mapping_but_passes_validation(spark):
    texts = ["2024-01-01T10:00:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00", "1704103200000", "2024-01-01", "2024-13-45", "12345abc"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.select(parse_instant(F.col("x")).alias("i"), is_iso_date(F.col("x")).alias("ok")).collect()
    assert [r.i for r in got] == [None, dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 10), None, None, None]
    assert [r.ok for r in got] == [True, True, True, False, True, False, False]


def test_nested_path_null_hop_and_defaults(spark):
    df = spark.createDataFrame([({"a": {"b": "x"}}, "5"), ({"a": None}, "zz")], "m map<string,map<string,string>>, n string")
    out = mp.map_fields(df, {"v": "m.a.b", "gone": "nope.deep", "num": {"sourceField": "n", "type": "INTEGER", "defaultValue": 9}, "must": {"sourceField": "n", "type": "INTEGER", "required": True}})
    rows = out.select("mapped.*", "mapping_errors").collect()
    assert [(r.v, r.gone, r.num, len(r.mapping_errors)) for r in rows] == [("x", None, 5, 0), (None, None, 9, 1)]


def test_context_without_entries_is_an_error(spark):
    df = spark.createDataFrame([("c", "product", "s", "2024-01-01T00:00:00Z", None, None)], "c string, t string, s string, e string, m string, p string")
    mapping = {"customerId": "c", "subjectType": "t", "subjectId": "s", "eventDate": {"sourceField": "e", "type": "INSTANT"}, "marketplace": "m", "programId": "p"}
    assert mp.bad_rows(mp.to_candidates(df, mapping, AS_OF)).select("errors").first()[0] == ["context: no entry"]


@pytest.mark.parametrize(
    "rule,text,want",
    [
        (rd.redact_email, "john.doe@example.com", "j***@e***.com"),
        (rd.redact_email, "a@b.co and x.y@mail.test.org!", "***@*** and x***@m***.org!"),
        (rd.redact_phone, "call 555-123-4567 or (555) 123-4567", "call ***-***-**** or ***-***-****"),
        (rd.redact_card, "1234-5678-9012-3456", "****-****-****-3456"),
        (rd.redact_ssn, "123-45-6789", "***-**-****"),
        (rd.redact_all, "4111-1111-1111-1111", "***-***-****-***-***-****"),
        (rd.redact_name, "Jane  van Doe ", "J*** v*** D***"),
        (rd.redact_customer_id, "CUST-12", "CUST******"),
        (rd.redact_customer_id, "abcd", "****"),
        (rd.redact_customer_id_context, "CUST-123456", "CUST****3456"),
        (rd.redact_address, "1 Main St", "[ADDRESS_REDACTED]"),
        (rd.redact_all, "", ""),
        (rd.redact_all, None, None),
    ],
)
def test_redaction(spark, rule, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(rule(F.col("x"))).first()[0] == want


def test_redact_columns_by_name(spark):
    df = spark.createDataFrame([("a@b.co", 5, "CUST-99", "Jo Li", "f.txt", "see xy@mail.com")], "userEmail string, card int, customerId string, fullName string, filename string, note string")
    assert tuple(rd.redact_columns(df).first()) == ("***@***", "[REDACTED]", "CUST******", "J*** L***", "f.txt", "see x***@m***.com")


def test_hash_buckets(spark):
    names = ["CUST-1", "CUST-42", "zoë", "顧客", ""]
    got = spark.createDataFrame([(n,) for n in names], "x string").select("x", sha_bucket(F.concat("x", F.lit(":e"))).alias("b")).collect()
    for r in got:
        raw = hashlib.sha256(f"{r.x}:e".encode()).digest()[:8]
        assert r.b == abs(int.from_bytes(raw, "big", signed=True)) % 100
    h = 0
    for ch in "CUST-42":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    h = h - 2**32 if h >= 2**31 else h
    assert spark.range(1).select(java_hash_bucket(F.lit("CUST-42"))).first()[0] == abs(h) % 100


def test_assignment_edges(spark):
    ids = spark.range(500).select(F.concat(F.lit("c"), "id").alias("customer_id"))
    one = lambda groups, on=True: {r[0] for r in ids.select(ex.assign_treatment(F.col("customer_id"), ex.Experiment("e", groups, on))).collect()}
    assert one((("a", 100),)) == {"a"}
    assert one((("a", 0), ("b", 100))) == {"b"}
    assert one((("a", 100),), False) == {None} and one(()) == {None}
    assert one((("a", 10), ("b", 10))) == {"a", "b"}


def test_ranking_ties_and_unknowns(spark):
    rows = [cand(sid="s3", kind="track"), cand(sid="s1", kind="service"), cand(sid="s2", kind="product"), cand(sid="s4", scores={"m": score(0.4)}, event=NOW - 9 * DAY)]
    df = frame(spark, *rows).withColumn("sid", F.col("subject.id"))
    order = lambda channel: [r.sid for r in rk.rank(df, ["customer_id"], rk.by_default(channel, "m", "sid")).orderBy("rank").collect()]
    assert order("email") == ["s4", "s2", "s1", "s3"]
    assert order("carrier-pigeon") == ["s4", "s1", "s2", "s3"] and order(None) == order("carrier-pigeon")


def test_recency_above_one_for_future(spark):
    got = spark.range(1).select(rk.recency_score(F.lit("2024-02-03 00:00:00").cast("timestamp"), AS_OF, F.lit(None).cast("int"))).first()[0]
    assert round(got, 6) == round(1 + 3 / 7, 6)
    assert spark.range(1).select(days_between(F.lit("2024-02-01 12:00:00").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))).first()[0] == -1


def test_update_conflicts_and_missing_keys(spark):
    store = spark.createDataFrame([("a", 1, 10.0, NOW), ("b", 2, 20.0, NOW)], "id string, version bigint, v double, updated_at timestamp")
    updates = spark.createDataFrame([("a", 1, 11.0), ("b", 1, 21.0), ("x", 1, 1.0)], "id string, expected_version bigint, v double")
    after, bad = st.update_if_version(store, updates, ["id"], ["v"], "2024-02-01 00:00:00")
    assert {(r.id, r.version, r.v) for r in after.collect()} == {("a", 2, 11.0), ("b", 2, 20.0)}
    assert {(r.id, r.conflict) for r in bad.collect()} == {("b", "VERSION_MISMATCH"), ("x", "NOT_FOUND")}
    assert st.delete_keys(after, spark.createDataFrame([("zz",)], "id string"), ["id"]).count() == 2


def test_same_key_twice_in_one_batch(spark):
    store = spark.createDataFrame([("a", 0)], "id string, seq int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "id string, seq int")
    after, refused = st.create_if_absent(store, new, ["id"], "seq")
    assert {tuple(r) for r in after.collect()} == {("a", 0), ("b", 2)}
    assert {r.seq for r in refused.collect()} == {1, 3}


def test_fallback_cascade_order(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0.2), (None, 0.1, 0.2), (None, None, 0.2), (None, None, None)], "s double, c double, p double")
    out = sc.fallback_scores(df, F.col("s"), F.lit(1.0), F.col("c"), F.lit(0.7), F.col("p")).collect()
    assert [(r.score, r.score_confidence, r.fallback_strategy) for r in out] == [(0.9, 1.0, None), (0.1, 0.7, "cached"), (0.2, 0.1, "provider"), (0.5, 0.1, "default")]


def test_frequency_cap_window_start_is_inclusive(spark):
    cands = spark.createDataFrame([("c", "p", NOW)], "customer_id string, program_id string, at timestamp")
    sends = lambda *ts: spark.createDataFrame([("c", "p", t) for t in ts], "customer_id string, program_id string, sent_at timestamp")
    rules = [{"scope": "program", "max": 1, "window": "7d"}]
    allowed = lambda s: ve.frequency_cap(cands, s, "at", "sent_at", rules).first().allowed
    assert not allowed(sends(NOW - 7 * DAY))
    assert allowed(sends(NOW - 7 * DAY - SEC)) and allowed(sends(NOW))


def test_throttle_window_resets_at_its_length(spark):
    rows = [(i, NOW + dt.timedelta(milliseconds=ms)) for i, ms in enumerate([0, 10, 20, 999, 1000, 1001, 1999, 2000])]
    df = spark.createDataFrame([(i, "k", t) for i, t in rows], "id int, key string, ts timestamp")
    got = {r.id: r.allowed for r in rk.fixed_window_throttle(df, "key", "ts", "id", 2, 1000).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}


def test_consecutive_failures_and_empty_rates(spark):
    runs = spark.createDataFrame([(i, "p", NOW + i * SEC, s) for i, s in enumerate(["failure", "success", "timeout", "failure"])], "run_id int, program_id string, started_at timestamp, status string")
    assert me.program_status_rollup(runs).first().consecutive_failures == 2
    none = spark.createDataFrame([], "experiment_id string, treatment_id string, delivered boolean, responded boolean")
    assert me.experiment_metrics(none).count() == 0


def test_follow_up_and_template(spark):
    starts = spark.createDataFrame([("a", NOW), ("b", NOW)], "customer_id string, event_date timestamp")
    conv = spark.createDataFrame([("a", NOW + 2 * DAY)], "customer_id string, converted_at timestamp")
    out = dl.follow_up_sequence(starts, conv, [("email", 3600, False), ("sms", 86400, True), ("push", 259200, True)])
    assert {(r.customer_id, r.channel) for r in out.collect()} == {("a", "email"), ("a", "sms"), ("b", "email"), ("b", "sms"), ("b", "push")}
    got = dl.render_template(starts.withColumn("n", F.lit(None).cast("string")), "Hi {customer_id} {{n}}", {"customer_id": "customer_id", "n": "n"}).first()
    assert got.message == "Hi a " and got.missing_variable
