"""Streams across several micro-batches against their batch twins; sinks and hand-offs."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from beckon.operators.quality import detect_duplicates
from beckon.operators.ranking import fixed_window_throttle
from beckon.plans.fixtures import candidates, fixture
from beckon.sources import stages
from beckon.sources import warehouse as wh
from beckon.streaming import operators as so
from beckon.streaming.core import drain


@pytest.fixture(scope="module")
def parts(spark, sf):
    """The events in time order, one file per five days, each its own micro-batch."""
    root = tempfile.mkdtemp(prefix="beckon-parts-")
    events = fixture(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    for i in range(6):
        low, high = f"2024-01-{1 + 5 * i:02d}", f"2024-01-{6 + 5 * i:02d}"
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{root}/p{i}")
    for i in range(6):
        name = next(f for f in os.listdir(f"{root}/p{i}") if f.endswith(".parquet"))
        os.utime(f"{root}/p{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return root


def stream(spark, root):
    return spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


def test_dedup_stream_equals_batch_over_many_batches(spark, sf, parts):
    got = drain(so.dedup_events_stream(stream(spark, parts), ["user_id"], "ts", "event_id", 86400), "dedup").select("event_id")
    want = detect_duplicates(fixture(spark, sf, "events"), ["user_id"], "ts", "event_id", 86400).filter("not is_duplicate").select("event_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_throttle_stream_equals_batch_over_many_batches(spark, sf, parts):
    src = stream(spark, parts).withColumn("program", F.col("event_id") % 3)
    got = drain(so.stream_throttle(src, "program", "ts", "event_id", 4, 10_800_000), "throttle").select("event_id")
    events = fixture(spark, sf, "events").withColumn("program", F.col("event_id") % 3)
    want = fixed_window_throttle(events, "program", "ts", "event_id", 4, 10_800_000).filter("allowed").select("event_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_dedup_window_edge(spark):
    base = dt.datetime(2024, 1, 1)
    root = tempfile.mkdtemp(prefix="beckon-edge-")
    rows = [(0, 1, base), (1, 1, base + dt.timedelta(seconds=299)), (2, 1, base + dt.timedelta(seconds=300)), (3, 1, base)]
    spark.createDataFrame([(*r, 0.0) for r in rows], "event_id bigint, user_id bigint, ts timestamp, value double").coalesce(1).write.mode("overwrite").parquet(f"{root}/a")
    got = drain(so.dedup_events_stream(stream(spark, root), ["user_id"], "ts", "event_id"), "edge")
    assert {r.event_id for r in got.collect()} == {0, 2}


def test_append_if_absent_is_replay_safe(spark, sf):
    path = tempfile.mkdtemp(prefix="beckon-store-") + "/store"
    df = candidates(spark, sf, delivery=False)
    so.append_if_absent(df.filter("k % 2 = 0"), 0, path, "k")
    so.append_if_absent(df.filter("k % 3 = 0"), 1, path, "k")
    first = spark.read.parquet(path).count()
    so.append_if_absent(df.filter("k % 3 = 0"), 1, path, "k")
    assert spark.read.parquet(path).count() == first == df.filter("k % 2 = 0 or k % 3 = 0").count()


def test_stage_hand_off_names_the_missing_stage(spark):
    root = tempfile.mkdtemp(prefix="beckon-stage-")
    stages.write_stage(spark.range(3), root, "e1", "etl")
    stages.write_stage(spark.range(5), root, "e1", "etl")
    assert stages.read_stage(spark, root, "e1", "etl").count() == 5
    with pytest.raises(FileNotFoundError, match="score"):
        stages.read_stage(spark, root, "e1", "score")


def test_export_writes_nothing_for_an_empty_day(spark, sf):
    root = tempfile.mkdtemp(prefix="beckon-export-") + "/out"
    df = fixture(spark, sf, "cand_core")
    pick = lambda day: wh.export_day(df, "prog-2", day, F.col("program_id"), F.col("created_at"), F.col("updated_at"))
    assert wh.write_export(pick("1890-01-01"), root) == 0 and not os.path.exists(root)
    n = wh.write_export(pick("1998-06-10"), root)
    assert n == pick("1998-06-10").count() and (n == 0 or spark.read.parquet(root).count() == n)


def test_configs_drop_malformed_rows(spark):
    folder = tempfile.mkdtemp(prefix="beckon-conf-")
    with open(f"{folder}/c.json", "w") as f:
        f.write('{"programId": "p1", "enabled": true, "filters": [{"filterId": "t", "filterType": "trust", "enabled": true, "order": 1}]}\n{"programId": \n{"programName": "x"}\n')
    rows = stages.load_program_configs(spark, folder).collect()
    assert [r.programId for r in rows] == ["p1"] and rows[0].filters[0].filterId == "t"


def test_warehouse_scan_needs_its_parameters(spark, sf):
    with pytest.raises(ValueError, match="endDate"):
        wh.warehouse_scan(spark, "select * from orders where o_orderdate < '{endDate}'", {})
