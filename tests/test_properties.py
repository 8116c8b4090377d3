"""Properties over generated rows: order independence, idempotence, determinism, totals add up."""

import random

from pyspark.sql import functions as F

from beckon.operators import enrichment as en
from beckon.operators import filters as fl
from beckon.operators import metrics as me
from beckon.operators import ranking as rk
from beckon.operators import state as st
from beckon.operators.quality import detect_duplicates
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.flagship_q import CHAIN


def test_chain_is_independent_of_spec_order_and_partitions_rows(spark, sf):
    df = candidates(spark, sf)
    shuffled = list(CHAIN)
    random.Random(1).shuffle(shuffled)
    a = fl.filter_chain(df, CHAIN, AS_OF_ORDERS).select("k", "rejection.filter_id", "rejection.reason_code")
    b = fl.filter_chain(df.repartition(7), shuffled, AS_OF_ORDERS).select("k", "rejection.filter_id", "rejection.reason_code")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    passed, rejected = fl.split_passed_rejected(fl.filter_chain(df, CHAIN, AS_OF_ORDERS))
    assert passed.count() + rejected.count() == df.count()


def test_ranks_are_dense_and_limit_is_a_prefix(spark, sf):
    df = candidates(spark, sf, delivery=False)
    full = rk.rank(df, ["customer_id"], rk.by_score("k", 100)).select("customer_id", "k", "rank")
    top = rk.rank(df, ["customer_id"], rk.by_score("k"), 3).select("customer_id", "k", "rank")
    check = full.groupBy("customer_id").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d"))
    assert check.filter("n <> m or n <> d").isEmpty()
    assert top.exceptAll(full).isEmpty() and top.count() == full.filter("rank <= 3").count()


def test_state_operators_are_idempotent(spark, sf):
    store = fixture(spark, sf, "cand_core").select("customer_id", "subject_id", "program_id", "k")
    outs = fixture(spark, sf, "opt_outs")
    once, counts = st.opt_out_delete(store, outs)
    twice, again = st.opt_out_delete(once, outs)
    assert once.exceptAll(twice).isEmpty()
    assert counts.agg(F.sum("deleted")).first()[0] == store.count() - once.count()
    assert again.agg(F.sum("deleted")).first()[0] == 0
    keys = ["customer_id", "subject_id"]
    created, _ = st.create_if_absent(store, store.filter("k % 3 = 0"), keys, "k")
    assert created.count() == store.count()
    up = st.upsert(store, store.filter("k % 3 = 0"), keys, "k")
    assert up.exceptAll(store).isEmpty() and up.count() == store.count()


def test_duplicates_keep_the_first_and_do_not_depend_on_partitioning(spark, sf):
    df = fixture(spark, sf, "events").select("event_id", "user_id", "ts")
    a = detect_duplicates(df, ["user_id"], "ts", "event_id", 86400)
    b = detect_duplicates(df.repartition(5), ["user_id"], "ts", "event_id", 86400)
    assert a.exceptAll(b).isEmpty() and a.count() == df.count()
    first = a.join(df.groupBy("user_id").agg(F.min("ts").alias("ts")), ["user_id", "ts"])
    assert first.filter("is_duplicate").isEmpty()


def test_metric_totals_add_up(spark, sf):
    log = fixture(spark, sf, "stage_log").filter("stage = 'filter'")
    out = me.filter_metrics(log)
    total = out.filter("grain = 'program'").agg(F.sum("input"), F.sum("rejected"), F.sum("passed")).first()
    assert total[0] == log.count() and total[1] + total[2] == total[0]
    assert out.filter("grain = 'reason'").agg(F.sum("rejected")).first()[0] == total[1]


def test_comparison_of_equal_sides_finds_nothing(spark, sf):
    df = fixture(spark, sf, "cand_core")
    assert en.compare_v1_v2(df, df).filter("not matches").isEmpty()
    stock = fixture(spark, sf, "stock")
    assert en.reconcile_sources(stock, stock, ["p_partkey"], ["p_size"]).filter("status <> 'same'").isEmpty()


def test_plans_prune_before_the_shuffle(spark, sf):
    top = rk.rank(candidates(spark, sf, delivery=False), ["customer_id"], rk.by_recency("k"), 3)
    plan = top.select("k", "rank")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "lineitem" not in plan
    for name in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert name not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    from beckon.plans.catalog import queries

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries()["s1_warehouse_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan
