"""Repeated and null keys, bad values under ANSI, exact window sums, late stream rows."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from beckon.functions.convert import convert_type
from beckon.functions.hashing import java_hash_bucket
from beckon.operators import quality as qa
from beckon.operators import ranking as rk
from beckon.operators import scoring as sc
from beckon.operators import state as st
from beckon.operators.enrichment import customer_history, lookup_score_cache
from beckon.operators.mapping import build_metadata, to_candidates
from beckon.operators.velocity import velocity_filter
from beckon.sources.tables import table
from beckon.streaming import operators as so
from beckon.streaming.core import drain

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_one_update_of_a_key_wins(spark):
    store = spark.createDataFrame([("a", 1, 5.0, T0), ("b", 2, 6.0, T0), ("c", 1, 7.0, T0)], "id string, version bigint, price double, updated_at timestamp")
    updates = spark.createDataFrame([("a", 1, 1.0, 2), ("a", 1, 2.0, 1), ("b", 1, 3.0, 1), ("x", 1, 4.0, 1), ("c", 9, 1.0, 0), ("c", 1, 9.0, 1)], "id string, expected_version bigint, price double, seq int")
    after, bad = st.update_if_version(store, updates, ["id"], ["price"], "2024-02-01 00:00:00", order="seq")
    assert sorted((r.id, r.version, r.price) for r in after.collect()) == [("a", 2, 2.0), ("b", 2, 6.0), ("c", 2, 9.0)]
    assert sorted((r.id, r.conflict) for r in bad.collect()) == [("a", "VERSION_MISMATCH"), ("b", "VERSION_MISMATCH"), ("c", "VERSION_MISMATCH"), ("x", "NOT_FOUND")]
    by_time = updates.select("id", F.lit(T0).cast("timestamp").alias("expected_updated_at"), "price").filter("id in ('b', 'x')")
    after, bad = st.update_if_version(store, by_time, ["id"], ["price"], "2024-02-01 00:00:00", guard="updated_at")
    assert {r.id: r.price for r in after.collect()}["b"] == 3.0 and [r.id for r in bad.collect()] == ["x"]


def test_null_keys_are_one_key_for_duplicates(spark):
    df = spark.createDataFrame([(1, None, T0), (2, None, at(10)), (3, "k", T0), (4, None, at(90_000))], "n int, key string, ts timestamp")
    got = {r.n: r.is_duplicate for r in qa.detect_duplicates(df, ["key"], "ts", "n").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_cache_holds_a_key_once(spark):
    kind = "customer_id string, subject_id string, model_id string, score_value double, confidence double, scored_at timestamp, expires_at timestamp"
    rows = spark.createDataFrame([("c", "s", "m", 1.0, 0.5, T0, at(99)), ("c", "s", "m", 2.0, 0.5, at(5), at(99))], kind)
    assert [r.score_value for r in sc.write_score_cache(rows.limit(0), rows).collect()] == [2.0]
    asked = spark.createDataFrame([("c", "s", "m")], "customer_id string, subject_id string, model_id string")
    assert [r.cached_value for r in lookup_score_cache(asked, rows, "2024-01-01 00:00:00").collect()] == [2.0]


def test_repeated_context_rows_add_up(spark):
    kind = "customer_id string, subject_type string, engagements int, channel_pref double, likes_high_value boolean, likes_media boolean, preferred_window int"
    df = spark.createDataFrame([("c", "a", 2, 0.5, True, True, 7), ("c", "a", 3, None, True, True, 7), ("c", None, 4, None, None, None, None)], kind)
    row = customer_history(df).first()
    assert row.history == {"a": 5} and row.history_total == 9


def test_java_hash_counts_surrogates(spark):
    df = spark.createDataFrame([("😀x",), ("abc",), ("",)], "t string")
    units = lambda s: [int.from_bytes(s.encode("utf-16-be")[k : k + 2], "big") for k in range(0, 2 * len(s.encode("utf-16-be")) // 2, 2)]

    def java(s):
        h = 0
        for u in units(s):
            h = (31 * h + u) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % 100

    assert [r[0] for r in df.select(java_hash_bucket(F.col("t"))).collect()] == [java("😀x"), java("abc"), 0]


def test_bad_values_end_no_job(spark):
    df = spark.createDataFrame([("c1", "not-a-date", "x", "abc"), ("c2", "2024-01-01T00:00:00Z", "3.5", "12")], "id string, at string, value string, ttl string")
    mapping = {"customerId": "id", "subjectType": "id", "subjectId": "id", "programId": "id", "eventDate": "at", "orderValue": "value", "ttlDays": "ttl"}
    got = {r.id: r for r in to_candidates(df, mapping, "2024-02-01 00:00:00").collect()}
    assert got["c1"].errors == ["eventDate: not an instant"] and got["c1"].attributes.order_value is None and got["c2"].errors == []
    assert (got["c1"].metadata.expires_at - got["c1"].metadata.created_at).days == 30 and (got["c2"].metadata.expires_at - got["c2"].metadata.created_at).days == 12
    huge = spark.createDataFrame([(2_000_000_000,)], "ttl int").select(build_metadata("2024-02-01 00:00:00", "x", F.col("ttl")).alias("m")).first()
    assert (huge.m.expires_at - huge.m.created_at).days == 30
    numbers = spark.createDataFrame([(3e9,), (7.0,)], "d double")
    assert [r[0] for r in numbers.select(convert_type(F.col("d"), "INTEGER", numbers.schema["d"].dataType)).collect()] == [None, 7]
    rules = qa.typed_rules(spark.createDataFrame([("abc",), ("5",), ("50",), (None,)], "t string"), [{"field": "t", "min": 1, "max": 10}])
    assert [r.rule_errors for r in rules.collect()] == [["t: unreadable"], [], ["t: above max"], []]
    zero = spark.createDataFrame([(T0, 0)], "d timestamp, w int").select(rk.recency_score(F.col("d"), "2024-01-02 00:00:00", F.col("w")).alias("s"))
    assert zero.first().s == 0.0


def test_a_failing_scorer_row_is_null(spark):
    def model(x):
        if (x == 0).any():
            raise ValueError("zero")
        return 1 / x

    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "x double")
    assert sorted(((r.s is None), r.s or 0.0) for r in df.select(sc.pandas_scorer(model, "x").alias("s")).collect()) == [(False, 0.25), (False, 0.5), (True, 0.0)]


def test_window_sums_are_exact(spark):
    rows = [("k", T0, 1e12), ("k", at(3601), 0.01), ("k", at(3602), 1e12), ("k", at(3603), float("nan")), ("k", at(7300), 0.02)]
    out = velocity_filter(spark.createDataFrame(rows, "key string, ts timestamp, amount double"), "key", "ts", "amount", 10, 100.0)
    got = {r.ts: (r.window_amount, r.allowed) for r in out.collect()}
    assert got[at(3601)] == (0.01, True) and got[at(3602)] == (1e12 + 0.01, False) and got[at(3603)][1] is False and got[at(7300)] == (0.02, True)


def test_tables_see_appended_files(spark):
    root = tempfile.mkdtemp(prefix="beckon-append-")
    spark.range(3).write.parquet(f"{root}/orders.parquet")
    assert table(spark, root, "orders").count() == 3
    spark.range(4).write.mode("append").parquet(f"{root}/orders.parquet")
    assert table(spark, root, "orders").count() == 7


def test_late_and_returning_rows_of_a_stream(spark):
    root = tempfile.mkdtemp(prefix="beckon-late-")
    batches = [[(1, at(100_000))], [(2, at(100_100)), (3, at(100_400))], [(4, at(200_000))], [(5, at(164_000)), (6, at(200_010))], [(7, at(200_301))]]
    for k, rows in enumerate(batches):
        folder = f"{root}/b{k}"
        spark.createDataFrame([(n, 1, ts) for n, ts in rows], "event_id bigint, user_id bigint, ts timestamp").coalesce(1).write.parquet(folder)
        for name in os.listdir(folder):
            os.utime(f"{folder}/{name}", (1_700_000_000 + 10 * k,) * 2)
    src = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)
    got = drain(so.dedup_events_stream(src, ["user_id"], "ts", "event_id"), "late")
    # 2 and 6 are too close to the last passed event, 5 is ten hours behind the watermark
    assert {r.event_id for r in got.collect()} == {1, 3, 4, 7}
