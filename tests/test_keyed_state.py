"""Keyed stream folds against plain loops over several micro-batches; the growing store."""

import datetime as dt
import itertools
import os
import random
import tempfile
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.streaming import keyed, store
from beckon.streaming import operators as so
from beckon.streaming.core import drain


def batches(seed, ticks=400, count=4, size=120, keys=9):
    """Rows in time order over several micro-batches; one key has a third of them."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(ticks), n, "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}", rng.choice([-2, 0, 1, 1, 2, 3, None])) for n in range(count * size))
    frame = pd.DataFrame(rows, columns=["tick", "id", "__key", "n"])
    cuts = sorted({0, len(frame), *(int(frame["tick"].searchsorted(rng.randrange(ticks))) for _ in range(count - 1))})
    return [frame.iloc[a:b].sort_values(["__key", "tick", "id"], ignore_index=True) for a, b in zip(cuts, cuts[1:]) if b > a]


def run(fold, parts, watermark=lambda part: -1):
    held, out = None, []
    for part in parts:
        rows, held, _ = fold(held, part, watermark(part))
        held = keyed.unpacked(keyed.packed(held))
        out.append(rows)
    return pd.concat(out), held


@pytest.mark.parametrize("seed", range(6))
def test_first_per_window(seed):
    parts, last, want = batches(seed), {}, set()
    for r in pd.concat(parts).sort_values(["tick", "id"]).itertuples():
        if r[3] not in last or r.tick >= last[r[3]] + 25:
            last[r[3]] = r.tick
            want.add(r.id)
    out, held = run(keyed.first_per_window("tick", 25, 30_000, 1000), parts)
    assert set(out["id"]) == want and dict(zip(held["key"], held["at"])) == last
    out, held = run(keyed.first_per_window("tick", 25, 30_000, 1000), parts, lambda p: int(p["tick"].min()) * 1000)
    assert set(out["id"]) == want and len(held) <= len(last)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("permits", [None, "n"])
def test_first_in_window(seed, permits):
    parts, state, want = batches(seed), {}, set()
    for r in pd.concat(parts).sort_values(["tick", "id"]).itertuples():
        n = (1 if pd.isna(r.n) else int(r.n)) if permits else 1
        if n < 0:
            continue
        start, used = state.get(r[3], (None, 0))
        if start is None or r.tick - start >= 40:
            start, used = r.tick, 0
        if used + n <= 4:
            want.add(r.id)
            used += n
        state[r[3]] = (start, used)
    out, held = run(keyed.first_in_window("tick", 40, 4, permits), parts)
    assert set(out["id"]) == want and {k: (a, u) for k, a, u in held[["key", "at", "used"]].itertuples(index=False)} == state


@pytest.mark.parametrize("seed", range(4))
def test_trailing_seconds(seed):
    parts = [p.assign(__sec=p["tick"], __high=p["id"] * 10**15 - 7, __low=p["id"] * 13 % 10**12) for p in batches(seed)]
    done, want = [], {}
    for p in parts:
        done += list(p[["__key", "__sec", "id", "__high", "__low"]].itertuples(index=False, name=None))
        for k, s, i, _, _ in p[["__key", "__sec", "id", "__high", "__low"]].itertuples(index=False, name=None):
            own = [(h, low) for k2, s2, _, h, low in done if k2 == k and s - 30 <= s2 <= s]
            want[i] = (len(own), sum(h * keyed.MICRO + low for h, low in own) / 10**6)
    out, _ = run(keyed.trailing_seconds(30), parts, lambda p: int(p["tick"].min()) * 1000)
    assert {r.id: (r.window_count, r.window_amount) for r in out.itertuples()} == want


def event_stream(spark, rows):
    root = tempfile.mkdtemp(prefix="beckon-keyed-")
    schema = "event_id bigint, user_id bigint, ts timestamp, value double, got timestamp"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{root}/p{n}")
        name = next(f for f in os.listdir(f"{root}/p{n}") if f.endswith(".parquet"))
        os.utime(f"{root}/p{n}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_rows_without_time_go_to_the_side_output(spark):
    rows = [[(1, 1, at(0), 1.0, at(0)), (2, 1, None, 1.0, at(1)), (3, None, at(5), 1.0, at(5)), (4, None, at(6), 1.0, at(6))], [(5, 1, None, 1.0, at(400)), (6, 1, at(500), float("nan"), at(500))]]
    ids = lambda df: {r.event_id for r in df.collect()}
    src = lambda: event_stream(spark, rows)
    assert ids(drain(so.dedup_events_stream(src(), ["user_id"], "ts", "event_id"), "n")) == {1, 3, 6}
    assert ids(drain(so.stream_throttle(src(), "user_id", "ts", "event_id", 1, 300_000), "n")) == {1, 3, 6}
    assert ids(drain(keyed.untimed(src(), "ts"), "n")) == {2, 5}
    assert ids(drain(so.dedup_events_stream(keyed.with_arrival(src(), "ts", "got"), ["user_id"], "ts", "event_id"), "n")) == {1, 3, 5}
    got = {r.event_id: (r.window_count, r.window_amount, r.allowed) for r in drain(so.velocity_alerts(src(), "user_id", "ts", "value"), "n").collect()}
    assert got == {1: (1, 1.0, True), 3: (1, 1.0, True), 4: (2, 2.0, True), 6: (2, 1.0, False)}


def test_late_and_expired_rows(spark):
    rows = [[(1, 1, at(0), 1.0, None), (2, 2, at(10), 1.0, None)], [(3, 3, at(5000), 1.0, None)], [(4, 1, at(100), 1.0, None), (5, 2, at(4500), 1.0, None), (6, 3, at(5100), 1.0, None)]]
    got = drain(so.dedup_events_stream(event_stream(spark, rows), ["user_id"], "ts", "event_id"), "late")
    # 4 is later than the watermark, 2 is forgotten when 5 comes, 3 holds 6 back
    assert {r.event_id for r in got.collect()} == {1, 2, 3, 5}


def test_store_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(store, "FAN", 2)
    path = tempfile.mkdtemp(prefix="beckon-store-") + "/store"
    rng, seen, reads = random.Random(4), {}, []
    for b in range(6):
        rows = [(b * 1000 + k, rng.choice([None, "a", "b"]), rng.randrange(25 * b + 20)) for k in range(60)]
        for k, x, y in rows:
            seen.setdefault((x, y), {}).setdefault(b, k)
        frame = spark.createDataFrame(rows, "k long, x string, y long")
        for _ in range(2 if b % 4 == 1 else 1):  # some batches are replayed
            store.append_if_absent(frame, b, path, "k", ["x", "y"])
        reads.append(len(store.runs(spark, path)))
    want = {(min(v[min(v)], 10**9), *k) for k, v in seen.items()}
    first = defaultdict(list)
    for k, v in seen.items():
        first[k] = v[min(v)]
    got = [(r.k, r.x, r.y) for r in store.read_store(spark, path).collect()]
    assert len(got) == len(set(got)) == len(seen) and set(got) == want
    assert max(reads) <= 4 and store.runs(spark, path)[0] == (0, 3)
    assert spark.read.parquet(path).count() == len(seen)
    assert len(os.listdir(path + "/_seen")) <= 3


def test_store_asks_only_for_possible_keys(spark):
    path = tempfile.mkdtemp(prefix="beckon-store-") + "/store"
    for b in range(3):
        frame = spark.range(b * 100, b * 100 + 100).withColumn("v", F.lit(b))
        store.append_if_absent(frame, b, path, "v", ["id"])
    assert store.read_store(spark, path).count() == 300
    store.append_if_absent(spark.range(250, 350).withColumn("v", F.lit(9)), 3, path, "v", ["id"])
    got = store.read_store(spark, path)
    assert got.count() == 350 and got.filter("id < 300 and v = 9").isEmpty()


def test_slices_hold_bounded_rows_in_time_order():
    rng = random.Random(5)
    rows = pd.DataFrame([(rng.randrange(3000), n, rng.choice([None, "a", "b"]), {"n": n} if n % 3 else None) for n in range(9000)], columns=["tick", "id", "name", "tree"])
    rows["value"] = [None if n < 4000 else n / 2 for n in range(9000)]  # runs without a value come as nulls
    frames = list(keyed.in_slices((rows.iloc[k : k + 300] for k in range(0, 9000, 300)), "tick", 1000, ["tree"]))
    assert [last for _, last in frames] == [False] * (len(frames) - 1) + [True] and max(len(f) for f, _ in frames) < 2000
    assert all(a["tick"].max() < b["tick"].min() for (a, _), (b, _) in zip(frames, frames[1:]))
    got = pd.concat([f for f, _ in frames]).sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(got[["tick", "id", "value"]], rows[["tick", "id", "value"]])
    assert [x if isinstance(x, str) else None for x in got["name"]] == list(rows["name"]) and list(got["tree"]) == list(rows["tree"])
    (whole, last), = keyed.in_slices(iter([rows]), "tick", 9000, ["tree"])
    assert last and len(whole) == 9000


def busy(count):
    """Two micro-batches out of time order: late rows, equal seconds, one key with most rows."""
    rng = random.Random(8)
    first = [(n, 1 if n % 5 else n % 40, at(rng.randrange(20_000)), rng.choice([0.1, 2.5, None]), None) for n in range(count)]
    return [first, [(count + n, 1, at(19_500 + rng.randrange(2000)), 1.0, None) for n in range(count // 8)]]


def test_exact_velocity_in_slices_holds_few_rows(spark):
    src = lambda: event_stream(spark, busy(6000)).withColumns({"__sec": F.unix_seconds("ts"), "__high": F.lit(0), "__low": (F.coalesce("value", F.lit(0)) * 1_000_000).cast("bigint")}).withWatermark("ts", "10 minutes")
    fields = [T.StructField("window_count", T.LongType()), T.StructField("window_amount", T.DoubleType()), T.StructField("size", T.LongType())]

    def told(fold, state, rows, watermark):
        out, held, until = fold(state, rows, watermark)
        return out.assign(size=len(rows) + (0 if state is None else len(state))), held, until

    def answers(most):
        fold = keyed.trailing_seconds(600)
        df = keyed.fold_groups(src(), ["user_id"], "ts", ["__sec"], lambda *a: told(fold, *a), fields, 2, reach=600, most=most)
        return drain(df, "slices").select("event_id", "window_count", "window_amount", "size").toPandas()

    whole, cut = answers(10**9), answers(500)
    pd.testing.assert_frame_equal(*(x.drop(columns="size").sort_values("event_id", ignore_index=True) for x in (whole, cut)))
    assert len(cut) > 6000 and whole["size"].max() > 5000 and cut["size"].max() < 1800


def test_throttle_in_slices_holds_few_rows(spark):
    rows = [[(*r[:2], at(r[0] * 0.9 % 20_000 + 0.1 * (r[0] % 9)), *r[3:]) for r in part] for part in busy(6000)]
    src = lambda: event_stream(spark, rows).withColumn("__ms", F.unix_millis("ts")).withWatermark("ts", "10 minutes")

    def told(fold, state, rows, watermark):
        out, held, until = fold(state, rows, watermark)
        return out.assign(size=len(rows)), held, until

    for fold in (keyed.first_in_window("__ms", 90_000, 3, None), keyed.first_per_window("__ms", 70_000, 90_000, 1)):
        size = [T.StructField("size", T.LongType())]
        whole, cut = (drain(keyed.fold_groups(src(), ["user_id"], "ts", ["__ms", "event_id"], lambda *a: told(fold, *a), size, 2, most=m), "slices").toPandas() for m in (10**9, 500))
        assert set(whole["event_id"]) == set(cut["event_id"]) and len(cut) == len(whole) > 100
        assert whole["size"].max() > 5000 and cut["size"].max() < 1200


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_slices_do_not_map_what_waits_on_disk():
    rng = np.random.default_rng(6)

    def arrivals():  # 160 MB in random time order
        for n in range(0, 2_000_000, 10_000):
            frame = pd.DataFrame(rng.integers(0, 10**9, (10_000, 8)), columns=list("abcdefgh"))
            yield frame.assign(tick=rng.integers(0, 1_000_000, 10_000), id=np.arange(n, n + 10_000))

    list(keyed.in_slices(itertools.islice(arrivals(), 5), "tick", 20_000))
    before, most, count, ids, low = resident(), 0, 0, 0, -1
    for frame, _ in keyed.in_slices(arrivals(), "tick", 20_000):
        assert low < frame["tick"].min() and len(frame) < 40_000
        low, count, ids = frame["tick"].max(), count + len(frame), ids + int(frame["id"].sum())
        most = max(most, resident() - before)
    assert count == 2_000_000 and ids == 2_000_000 * 1_999_999 // 2
    assert most < 80
