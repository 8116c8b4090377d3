"""Skew-safe timeline helpers against brute force, with one hot key."""

import datetime as dt
import random

from pyspark.sql import functions as F

from beckon.operators import timeline as tl

BASE = dt.datetime(2024, 1, 1)


def _rows(n=400, seed=3, span=4000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice("abcd")
        out.append((i, key, BASE + dt.timedelta(seconds=rnd.randrange(span)), float(rnd.randrange(100))))
    return out


def test_trailing_aggregate_matches_brute_force(spark):
    data = _rows()
    df = spark.createDataFrame(data, "id int, key string, ts timestamp, v double")
    for incl_cur in (False, True):
        for incl_start in (False, True):
            got = tl.trailing_aggregate(df, ["key"], "ts", 300, {"s": "v"}, "n", incl_cur, incl_start).collect()
            assert len(got) == len(data)
            for r in got:
                def inside(t):
                    d = (r.ts - t).total_seconds()
                    low = d <= 300 if incl_start else d < 300
                    return low and (d >= 0 if incl_cur else d > 0)
                hits = [v for _, k, t, v in data if k == r.key and inside(t)]
                assert (r.n, r.s) == (len(hits), sum(hits))


def test_asof_and_previous_and_prior(spark):
    data = _rows(300, 5, 900000)
    df = spark.createDataFrame(data, "id int, key string, ts timestamp, v double")
    left = df.filter("id % 2 = 0")
    right = df.filter("id % 2 = 1").select("key", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    for strict in (False, True):
        for r in tl.asof_join(left, right, ["key"], "ts", "rts", ["rid"], tie=["rid"], strict=strict).collect():
            hits = [(t, i) for i, k, t, _ in data if i % 2 and k == r.key and (t < r.ts if strict else t <= r.ts)]
            assert r.rid == (max(hits)[1] if hits else None)
    pos = F.unix_seconds("ts")
    for r in tl.previous_row(df, ["key"], ["ts", "id"], pos, 86400, ["id"]).collect():
        hits = [(t, i) for i, k, t, _ in data if k == r.key and (t, i) < (r.ts, r.id)]
        assert r.prev_id == (max(hits)[1] if hits else None)
    for r in tl.prior_totals(df, ["key"], ["ts", "id"], pos, 86400, "v", "n", "s").collect():
        hits = [v for i, k, t, v in data if k == r.key and (t, i) < (r.ts, r.id)]
        assert (r.n, r.s) == (len(hits), sum(hits))


def _dense(n=3000, seed=11):
    """Nine in ten rows stand in one day of one key; some share an instant, some have no time or no key."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        dense = rnd.random() < 0.9
        at = BASE + dt.timedelta(seconds=rnd.randrange(80000) // 7 * 7 if dense else rnd.randrange(40 * 86400))
        out.append((i, "hot" if dense else rnd.choice(["a", "b", None]), at, float(rnd.randrange(100))))
    return out


def test_dense_days_are_cut_into_parts_of_equal_depth(spark):
    df = spark.createDataFrame([*_dense(), (9000, "hot", None, 1.0)], "id int, key string, ts timestamp, v double")
    pos = F.unix_micros("ts")
    cut = tl.equal_depth_cuts(df, ["key"], pos, 86_400_000_000, depth=200, parts=50)
    sizes = cut.groupBy("key", *tl.CUT).agg(F.count("*").alias("n"), F.min(pos).alias("low"), F.max(pos).alias("high")).collect()
    assert sum(r.n for r in sizes) == 3001
    hot = sorted((r["__part"], r.low, r.high, r.n) for r in sizes if r.key == "hot" and r["__bucket"] == 19723)
    middle = sorted(n for *_, n in hot)[len(hot) // 2]
    assert len(hot) >= 45 and max(n for *_, n in hot) <= 2 * middle
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))  # codes ascend with the position, equal positions share one
    whole = tl.equal_depth_cuts(df, ["key"], pos, 86_400_000_000)
    assert whole.filter("__part != 0").count() == 0


def test_asof_previous_and_prior_in_dense_days(spark):
    data = _dense(700, 12)
    df = spark.createDataFrame(data, "id int, key string, ts timestamp, v double")
    pos, day = F.unix_micros("ts"), 86_400_000_000
    by_key = {}
    for i, k, t, v in data:
        by_key.setdefault(k, []).append((t, i, v))
    earlier = {i: sorted((t0, i0, v0) for t0, i0, v0 in by_key[k] if (t0, i0) < (t, i)) for i, k, t, _ in data}
    got = tl.previous_row(df, ["key"], ["ts", "id"], pos, day, ["id"], depth=20).collect()
    assert len(got) == len(data)
    assert all(r.prev_id == (earlier[r.id][-1][1] if earlier[r.id] else None) for r in got)
    for r in tl.prior_totals(df, ["key"], ["ts", "id"], pos, day, "v", "n", "s", depth=20).collect():
        assert (r.n, r.s) == (len(earlier[r.id]), sum(v for *_, v in earlier[r.id]))
    left = df.filter("id % 2 = 0")
    right = df.filter("id % 2 = 1").select("key", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    for strict in (False, True):
        rows = tl.asof_join(left, right, ["key"], "ts", "rts", ["rid"], tie=["rid"], strict=strict, depth=20).collect()
        assert len(rows) == left.count()
        for r in rows:
            hits = [(t, i) for t, i, _ in by_key[r.key] if i % 2 and (t < r.ts if strict else t <= r.ts)]
            assert r.rid == (max(hits)[1] if hits else None)


def test_split_row_number(spark):
    data = _rows(300, 7)
    df = spark.createDataFrame(data, "id int, key string, ts timestamp, v double")
    order = [F.desc("v"), F.asc("id")]
    got = tl.split_row_number(df, ["key"], order, [-F.floor(F.col("v") / 10)], "rn").collect()
    for r in got:
        better = sum(1 for i, k, _, v in data if k == r.key and (-v, i) < (-r.v, r.id))
        assert r.rn == better + 1
    top = tl.split_row_number(df, ["key"], order, [-F.floor(F.col("v") / 10)], "rn", limit=7).collect()
    assert {(r.id, r.rn) for r in top} == {(r.id, r.rn) for r in got if r.rn <= 7}


def test_greedy_openings(spark):
    for span, gap in ((4000, 60), (400000, 300), (600, 300), (3000, 1)):
        data = _rows(500, span, span)
        df = spark.createDataFrame(data, "id int, key string, ts timestamp, v double")
        got = {}
        for r in tl.greedy_openings(df, ["key"], F.unix_seconds("ts"), gap, block=4, spell=3).collect():
            got.setdefault(r.key, {})[r.tick] = r.opening
        for key in {k for _, k, _, _ in data}:
            secs = sorted({int((t - dt.datetime(1970, 1, 1)).total_seconds()) for _, k, t, _ in data if k == key})
            opened = None
            for s in secs:
                if opened is None or s >= opened + gap:
                    opened = s
                assert got[key][s] == opened
            assert len(got[key]) == len(secs)


def test_first_k_flag_keeps_all_rows(spark):
    df = spark.createDataFrame(_rows(200, 9), "id int, key string, ts timestamp, v double")
    got = tl.first_k_flag(df, ["key"], [F.asc("ts"), F.asc("id")], 3, ["id"]).collect()
    assert len(got) == 200
    assert all(sum(1 for r in got if r.key == k and r.position) == 3 for k in {r.key for r in got})


def test_serving_prunes_to_the_most_asked(spark, sf):
    from beckon.operators import ranking as rk
    from beckon.plans.ranking_q import cands, fixture

    few = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(few, "1000")
    turn = F.element_at(F.array(*[F.lit(n) for n in (0, -1, 1, 2, 3, 7, 60)], F.lit(None).cast("int")), (F.abs(F.hash("request_id")) % 8 + 1).cast("int"))
    requests = fixture(spark, sf, "requests").withColumn("max_results", turn)
    candidates = cands(spark, sf)
    rows = lambda df: sorted(map(tuple, df.select("request_id", "k", "rank", "max_results").collect()))
    try:
        pruned = rk.serve(requests, candidates, "quality", "k")
        assert "WindowGroupLimit" in pruned._jdf.queryExecution().toString()
        expected = rows(pruned)
        spark.conf.set(few, "2")  # questions beyond two results go by score buckets
        assert rows(rk.serve(requests, candidates, "quality", "k")) == expected
        assert rk.serve(requests.filter("false"), candidates, "quality", "k").count() == 0
        assert rk.serve(requests.filter("max_results <= 0 or max_results is null"), candidates, "quality", "k").count() == 0
    finally:
        spark.conf.set(few, before)
    assert expected and all(1 <= rank <= most for _, _, rank, most in expected)
    at = {}
    for request, _, rank, _ in expected:
        at.setdefault(request, []).append(rank)
    assert all(sorted(ranks) == list(range(1, len(ranks) + 1)) for ranks in at.values())
