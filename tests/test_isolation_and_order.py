"""Failing rules, parameters, templates, repeated rows, global order, windows in one sweep, unopened deliveries."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from beckon.functions.isolate import ANSI, with_isolated
from beckon.operators import delivery as dl
from beckon.operators import enrichment as en
from beckon.operators import mapping as mp
from beckon.operators import metrics as me
from beckon.operators import quality as qa
from beckon.operators import ranking as rk
from beckon.operators import scoring as sc
from beckon.operators import timeline as tl
from beckon.operators import velocity as ve
from beckon.sources.warehouse import bind, warehouse_scan
from beckon.streaming import operators as so
from beckon.streaming.core import drain

T0 = dt.datetime(2024, 1, 1)


def at(second):
    return None if second is None else T0 + dt.timedelta(seconds=second)


def test_isolated_texts_lose_only_their_row(spark):
    df = spark.createDataFrame([(0, "1"), (2, "x"), (None, None)], "x int, t string")
    before = spark.conf.get(ANSI)
    out = with_isolated(df, {"a": "1 / x", "b": "cast(t as int)", "c": "element_at(array(1), x + 1)", "d": "1 div x"})
    assert spark.conf.get(ANSI) == before == "true"
    assert [tuple(r)[2:] for r in out.collect()] == [(None, 1, 1, None), (0.5, None, None, 0), (None, None, None, None)]
    with pytest.raises(Exception):
        df.select(F.expr("1 / x")).collect()
    with pytest.raises(Exception):
        with_isolated(df, {"a": "no_such_column + 1"})
    assert spark.conf.get(ANSI) == before


def test_a_failing_sql_model_loses_one_score(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 4.0)], "id int, x double")
    out = sc.score_models(df, [sc.Model("bad", "1 / x"), sc.Model("good", F.lit(0.5))], "2024-01-01")
    got = {r["id"]: {m: s["value"] for m, s in r["scores"].items()} for r in out.collect()}
    assert got == {1: {"good": 0.5}, 2: {"bad": 0.25, "good": 0.5}} and out.columns == ["id", "x", "scores"]


def test_binding_knows_literals(spark):
    assert bind("select '{a}', {b}, 'x{c}y', `{d}`, \"{e}\" -- {f}\n/* {g} '*/") == (
        "select :a, :b, concat('x', cast(:c as string), 'y'), `{d}`, :e -- {f}\n/* {g} '*/", {"a", "b", "c", "e"},
    )
    assert bind("'it''s {x}' '' '\\'{y}'")[1] == {"x", "y"}
    rows = spark.createDataFrame([("2024-01-05",), ("2024-02-05",), (None,)], "d string")
    got = warehouse_scan(spark, "select d from t where d like '{month}%'", {"month": "2024-01"}, {"t": rows})
    assert [r.d for r in got.collect()] == ["2024-01-05"]
    tricky = warehouse_scan(spark, "select '{v}' as v", {"v": "'; drop table t --"})
    assert tricky.first().v == "'; drop table t --"


def test_templates_do_not_read_values(spark):
    df = spark.createDataFrame([(1, "{kind}", "shoe"), (2, "{x}", "hat"), (3, None, "cap")], "id int, name string, kind string")
    got = {r.id: (r.message, r.missing_variable) for r in dl.render_template(df, "Hi {name}, {{kind}}!", {"name": "name", "kind": "kind"}).collect()}
    assert got == {1: ("Hi {kind}, shoe!", False), 2: ("Hi {x}, hat!", False), 3: ("Hi , cap!", True)}
    assert dl.render_template(df, "Hi {other}", {"name": "name"}).first().missing_variable


def test_normalize_survives_unreadable_times(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("soon",), (None,)], "t string")
    assert [r.t for r in mp.normalize(df, {"t": "utc"}).collect()] == [dt.datetime(2024, 1, 1, 10), None, None]


def test_duplicates_of_repeated_and_untimed_rows(spark):
    rows = [(1, "a", at(0)), (1, "a", at(0)), (2, "a", at(0)), (3, "a", at(100)), (3, "a", at(100)), (4, "a", None), (4, "a", None), (5, None, at(0)), (5, None, at(0)), (6, None, at(5))]
    out = qa.detect_duplicates(spark.createDataFrame(rows, "id int, key string, ts timestamp"), ["key"], "ts", "id", 60)
    assert out.columns == ["id", "key", "ts", "is_duplicate"]
    got = sorted((r.id, r.is_duplicate) for r in out.collect())
    assert got == [(1, False), (1, True), (2, True), (3, False), (3, True), (4, False), (4, False), (5, False), (5, True), (6, True)]


def test_permits_below_zero_never_pass(spark):
    rows = [(0, "a", at(0), -5), (1, "a", at(1), 2), (2, "a", at(2), -5), (3, "a", at(3), 4), (4, "a", at(4), None), (5, "a", at(5), 0)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp, n int")
    got = {r.id: r.allowed for r in rk.fixed_window_throttle(df, "key", "ts", "id", 3, 60_000, permits="n").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_a_hot_key_is_spread_over_spells(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(40_000)) for _ in range(3000)] + [(None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "key string, t long")
    got = {}
    for r in tl.greedy_openings(df, ["key"], F.col("t"), 20, block=2, spell=8).collect():
        got.setdefault(r.key, {})[r.tick] = r.opening
    for key in {k for k, _ in rows}:
        opened = None
        for t in sorted({t for k, t in rows if k == key}):
            opened = t if opened is None or t >= opened + 20 else opened
            assert got[key][t] == opened


def test_equal_depth_cuts_hot_values_by_their_tie(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0] * 8 + [rng.random()]), "s") for k in range(4000)] + [(5000 + k, None, "s") for k in range(5)]
    df = spark.createDataFrame(rows, "k long, score double, status string")
    outer, inner = tl.equal_depth(df, "score", 20, "k")
    sizes = [r["count"] for r in df.groupBy(outer.alias("a"), inner.alias("b")).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2.5 * len(rows) / 20
    out = rk.by_status_min_score(df, "s", 0.0, False, 100, "k", "score", "k")
    want = {k: n for n, (k, s, _) in enumerate(sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0])), 1)}
    assert {r.k: r.row_no for r in out.collect()} == want


def test_all_rules_in_one_sweep(spark):
    rng = random.Random(8)
    sends = [(f"c{rng.randrange(3)}", rng.choice(["p", "q", None]), at(rng.choice([None] + [rng.randrange(900)] * 30))) for _ in range(150)]
    asks = [(n, f"c{rng.randrange(3)}", rng.choice(["p", "q", None]), at(rng.choice([None] + [rng.randrange(900)] * 20))) for n in range(80)]
    c = spark.createDataFrame(asks, "n int, customer_id string, program_id string, created timestamp")
    s = spark.createDataFrame(sends, "customer_id string, program_id string, sent timestamp")
    windows = [(True, 60), (False, 60), (False, 300), (True, 300)]
    got = {r.n: [r[f"sends_{i}"] for i in range(4)] for r in ve.windowed_sends(c, s, "created", "sent", windows, "customer_id", "program_id").collect()}
    for n, who, what, when in asks:
        near = lambda scoped, w: sum(1 for a, b, t in sends if when and t and a == who and (b == what or not scoped) and when - dt.timedelta(seconds=w) <= t < when)
        assert got[n] == [near(*w) for w in windows]
    shuffles = []
    for some in (windows[:1], windows):
        plan = ve.windowed_sends(c, s, "created", "sent", some, "customer_id", "program_id")._jdf.queryExecution().executedPlan().toString()
        shuffles.append(plan.count("Exchange hashpartitioning"))
    assert shuffles[0] == shuffles[1]


def test_traffic_only_moves_to_the_new_source(spark):
    df = spark.range(2000).withColumn("x", F.lit(None).cast("string"))
    routes = [{r.id for r in en.split_traffic(df, ["id", "x"], share).filter("route = 'new'").collect()} for share in (0.0, 0.1, 0.5, 1.0)]
    assert not routes[0] and routes[1] < routes[2] < routes[3] and len(routes[3]) == 2000 and abs(len(routes[2]) - 1000) < 120


def test_sketches_of_days_merge(spark):
    rows = [("get", "email", "p", at(86400 * d + 60), [f"c{(d * 37 + k) % 700}" for k in range(120)] + [None]) for d in range(40)]
    df = spark.createDataFrame(rows, "endpoint string, channel string, program_id string, ts timestamp, customer_ids array<string>")
    got = me.merge_customer_sketches(me.daily_customer_sketches(df), F.lit("all")).filter("dimension = 'total'").first()
    want = len({c for r in rows for c in r[4] if c})
    assert got.mentions == 40 * 120 and abs(got.customers - want) <= 0.02 * want


def test_unopened_deliveries_over_several_batches(spark):
    root = tempfile.mkdtemp(prefix="beckon-open-")

    def parts(name, schema, batches):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}{n}")
            file = next(f for f in os.listdir(f"{root}/{name}{n}") if f.endswith(".parquet"))
            os.utime(f"{root}/{name}{n}/{file}", (1_700_000_000 + n, 1_700_000_000 + n))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}*")

    hour = 3600
    sent = parts("sent", "delivery_id string, sent_at timestamp", [[("a", at(0)), ("b", at(10)), ("n", None)], [("c", at(hour))], [("d", at(9 * hour))], [("e", at(20 * hour))]])
    opened = parts("open", "delivery_id string, opened_at timestamp", [[("a", at(60)), ("a", at(90))], [("c", at(4 * hour))], [("d", at(9 * hour + 5))], [("e", at(20 * hour + 1))]])
    got = drain(so.unopened_stream(sent, opened), "unopened")
    assert {r.delivery_id for r in got.collect()} == {"b", "c"}
