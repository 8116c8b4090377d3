"""Queries for M1-M14."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from beckon.functions.convert import iso
from beckon.operators import enrichment as en
from beckon.operators import experiments as ex
from beckon.operators import scoring as sc
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query

def sample_models():
    return [
        sc.Model("value", F.least(F.lit(1.0), F.col("avg_order_value") / 400000.0), F.lit(0.8), "2", ("avg_order_value",)),
        sc.Model("loyalty", F.when(F.col("order_count") >= 5, F.least(F.lit(1.0), F.col("order_count") / 20.0)), None, "1", ("order_count",)),
        sc.Model("recency", F.lit(0.25), F.lit(0.6), "1", ("absent_feature",)),
    ]


def feature_rows(spark, sf):
    return fixture(spark, sf, "features").withColumn("absent_feature", F.lit(None).cast("double"))


@query(
    "m1_score_models",
    """select customer_id, 'value' as model_id, least(1.0e0, avg_order_value / 400000.0e0) as value, 0.8e0 as confidence from features
    union all select customer_id, 'loyalty', least(1.0e0, order_count / 20.0e0), cast(null as double) from features where order_count >= 5""",
    ("features",),
)
def m1(spark, sf):
    out = sc.score_models(feature_rows(spark, sf), sample_models(), AS_OF_ORDERS)
    return sc.score_long(out, ["customer_id"]).select("customer_id", "model_id", "value", "confidence")


@query(
    "m1_isolated_models",
    """select customer_id, 'rate' as model_id, case when order_count % 7 <> 0 then 1.0e0 / (order_count % 7) end as value from features where order_count % 7 <> 0
    union all select customer_id, 'text', try_cast(case when order_count % 3 = 0 then 'n/a' else order_count::varchar end as double) from features where order_count % 3 <> 0
    union all select customer_id, 'safe', 0.5e0 from features""",
    ("features",),
)
def m1_isolated(spark, sf):
    models = [
        sc.Model("rate", "1 / (order_count % 7)"),
        sc.Model("text", "cast(case when order_count % 3 = 0 then 'n/a' else cast(order_count as string) end as double)"),
        sc.Model("safe", "0.5"),
    ]
    out = sc.score_models(feature_rows(spark, sf), models, AS_OF_ORDERS)
    return sc.score_long(out, ["customer_id"]).select("customer_id", "model_id", "value")


def _linear(total: pd.Series, count: pd.Series) -> pd.Series:
    return (total / count / 400000.0).clip(upper=1.0)


@query(
    "m2_pandas_scorer",
    "select customer_id, least(1.0e0, lifetime_value / order_count / 400000.0e0) as value from features",
    ("features",),
)
def m2(spark, sf):
    def linear(total: pd.Series, count: pd.Series) -> pd.Series:
        return _linear(total, count)

    df = fixture(spark, sf, "features")
    return df.select("customer_id", sc.pandas_scorer(linear, "lifetime_value", "order_count").alias("value"))


@query(
    "m2_batch_scorer",
    "select customer_id, least(1.0e0, lifetime_value / order_count / 400000.0e0) as value from features",
    ("features",),
)
def m2_batch(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"customer_id": pdf["customer_id"], "value": (pdf["lifetime_value"] / pdf["order_count"] / 400000.0).clip(upper=1.0)})

    return sc.score_batches(fixture(spark, sf, "features").select("customer_id", "lifetime_value", "order_count"), run, "customer_id string, value double")


@query(
    "m3_feature_getters",
    "select c_custkey, case when c_custkey % 2 = 0 then c_acctbal else -1.0e0 end as num, case when c_custkey % 2 = 1 then c_mktsegment else 'none' end as txt, false as flag from customer",
)
def m3(spark, sf):
    kind = F.when(F.col("c_custkey") % 2 == 0, "NUMERIC").otherwise("STRING")
    return fixture(spark, sf, "customer").select(
        "c_custkey", sc.numeric_feature(kind, F.col("c_acctbal"), -1.0).alias("num"), sc.string_feature(kind, F.col("c_mktsegment"), "none").alias("txt"),
        sc.boolean_feature(kind, F.lit(True), False).alias("flag"),
    )


@query(
    "m4_fallback_scores",
    """select k, coalesce(case when k % 3 = 0 then quality end, s.score_value, case when k % 5 = 0 then 0.4e0 end, 0.5e0) as score,
    case when k % 3 = 0 and quality is not null then quality_conf when s.score_value is not null then coalesce(s.confidence, 0) else 0.1e0 end as score_confidence,
    case when k % 3 = 0 and quality is not null then null when s.score_value is not null then 'cached' when k % 5 = 0 then 'provider' else 'default' end as fallback_strategy
    from cand_core c left join score_cache s on s.customer_id = c.customer_id and s.subject_id = c.subject_id and s.model_id = 'quality' and s.expires_at >= timestamp '2001-08-02'""",
    ("cand_core", "score_cache"),
)
def m4(spark, sf):
    asked = fixture(spark, sf, "cand_core").withColumn("model_id", F.lit("quality"))
    df = en.lookup_score_cache(asked, fixture(spark, sf, "score_cache"), AS_OF_ORDERS)
    own = F.when(F.col("k") % 3 == 0, F.col("quality"))
    out = sc.fallback_scores(df, own, F.col("quality_conf"), F.col("cached_value"), F.col("cached_confidence"), F.when(F.col("k") % 5 == 0, F.lit(0.4)))
    return out.select("k", "score", "score_confidence", "fallback_strategy")


@query(
    "m5_fallback_flags",
    "select k, k % 4 = 0 as is_fallback, case when k % 4 = 0 then 'cached' end as strategy from cand_core",
    ("cand_core",),
)
def m5(spark, sf):
    meta = F.when(F.col("k") % 4 == 0, F.create_map(F.lit("fallback"), F.lit("true"), F.lit("fallbackStrategy"), F.lit("cached"))).otherwise(F.create_map(F.lit("v"), F.lit("1")))
    df = fixture(spark, sf, "cand_core").select("k", meta.alias("m"))
    return df.select("k", sc.is_fallback(F.col("m")).alias("is_fallback"), sc.fallback_strategy(F.col("m")).alias("strategy"))


@query(
    "m6_write_score_cache",
    """with n as (select customer_id, subject_id, 'quality' as model_id, quality as score_value, coalesce(quality_conf, 0) as confidence, timestamp '2001-08-02' + interval '900' second as expires_at from cand_core where k % 6 = 0 and quality is not null)
    select customer_id, subject_id, model_id, score_value, confidence, strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires_at from n
    union all select customer_id, subject_id, model_id, score_value, confidence, strftime(expires_at, '%Y-%m-%d %H:%M:%S') from score_cache s where not exists (select 1 from n where n.customer_id = s.customer_id and n.subject_id = s.subject_id and n.model_id = s.model_id)""",
    ("cand_core", "score_cache"),
)
def m6(spark, sf):
    new = fixture(spark, sf, "cand_core").filter("k % 6 = 0 and quality is not null").selectExpr(
        "customer_id", "subject_id", "'quality' as model_id", "quality as score_value", "quality_conf as confidence"
    )
    out = sc.write_score_cache(fixture(spark, sf, "score_cache"), sc.cache_rows(new, AS_OF_ORDERS, {"quality": 900}))
    return out.select("customer_id", "subject_id", "model_id", "score_value", "confidence", iso(F.col("expires_at")).alias("expires_at"))


@query(
    "m7_tiered_ttl",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then 300 when order_count > 5 then 1800 else 7200 end as ttl_s from customer left join features on customer_id = 'CUST-' || c_custkey",
    ("features",),
)
def m7(spark, sf):
    cust = fixture(spark, sf, "customer").withColumn("customer_id", F.concat(F.lit("CUST-"), "c_custkey"))
    df = cust.join(fixture(spark, sf, "features").select("customer_id", "order_count"), "customer_id", "left")
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "vip").otherwise("regular")
    return df.select("c_custkey", sc.tiered_ttl(tier, F.col("order_count")).alias("ttl_s"))


@query(
    "m8_invalidate_cache",
    "select customer_id, subject_id, model_id from score_cache where cast(substr(customer_id, 6) as bigint) % 5 <> 0",
    ("score_cache",),
)
def m8(spark, sf):
    keys = fixture(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.concat(F.lit("CUST-"), "c_custkey").alias("customer_id"))
    return sc.invalidate_cache(fixture(spark, sf, "score_cache"), keys).select("customer_id", "subject_id", "model_id")


@query(
    "m9_ensemble",
    """select k, case when quality is not null and (trust is not null)::int + (fraud is not null)::int >= 1
    then round((coalesce(trust * 0.5e0, 0) + coalesce(fraud * 0.3e0, 0) + quality * 0.2e0) / ((trust is not null)::int * 0.5e0 + (fraud is not null)::int * 0.3e0 + 0.2e0), 6) end as score from cand_core""",
    ("cand_core",),
)
def m9(spark, sf):
    score = sc.ensemble({"trust": (F.col("trust"), 0.5), "fraud": (F.col("fraud"), 0.3), "quality": (F.col("quality"), 0.2)}, ["quality"])
    return fixture(spark, sf, "cand_core").select("k", F.round(score, 6).alias("score"))


@query("m10_cascade", "select k, coalesce(fraud, trust, quality, 50.0e0) as score from cand_core", ("cand_core",))
def m10(spark, sf):
    return fixture(spark, sf, "cand_core").select("k", sc.cascade([F.col("fraud"), F.col("trust"), F.col("quality")]).alias("score"))


@query(
    "m11_assign_treatment",
    """with h as (select c_custkey, ('0x' || substr(sha256('CUST-' || c_custkey || ':exp-2'), 1, 16))::ubigint::hugeint as u from customer),
    b as (select c_custkey, (case when u >= 9223372036854775808::hugeint then 18446744073709551616::hugeint - u else u end) % 100 as bucket from h)
    select c_custkey, cast(bucket as int) as bucket, case when bucket < 40 then 'a' when bucket < 70 then 'b' else 'c' end as treatment_id, cast(null as string) as disabled from b""",
)
def m11(spark, sf):
    cust = F.concat(F.lit("CUST-"), F.col("c_custkey"))
    return fixture(spark, sf, "customer").select(
        "c_custkey", ex.sha_bucket(F.concat(cust, F.lit(":exp-2"))).alias("bucket"), ex.assign_treatment(cust, ex.SAMPLE_EXPERIMENTS[1]).alias("treatment_id"),
        ex.assign_treatment(cust, ex.SAMPLE_EXPERIMENTS[2]).alias("disabled"),
    )


@query(
    "m12_ab_variant_hash",
    """with recursive s as (select c_custkey, 'CUST-' || c_custkey as t, 0::bigint as h, 1 as i from customer
      union all select c_custkey, t, (h * 31 + ascii(substr(t, i, 1))) % 4294967296, i + 1 from s where i <= length(t)),
    f as (select c_custkey, h from s where i > length(t)),
    b as (select c_custkey, (case when h >= 2147483648 then 4294967296 - h else h end) % 100 as bucket from f)
    select c_custkey, case when bucket < 34 then 'control' when bucket < 67 then 'variant-a' else 'variant-b' end as variant from b""",
)
def m12(spark, sf):
    groups = (("control", 34), ("variant-a", 33), ("variant-b", 33))
    return fixture(spark, sf, "customer").select("c_custkey", ex.ab_variant(F.concat(F.lit("CUST-"), F.col("c_custkey")), groups).alias("variant"))


@query(
    "m13_record_treatment",
    """with h as (select k, created_at, ('0x' || substr(sha256(customer_id || ':exp-1'), 1, 16))::ubigint::hugeint as u from cand_core),
    b as (select k, created_at, (case when u >= 9223372036854775808::hugeint then 18446744073709551616::hugeint - u else u end) % 100 as bucket from h)
    select k, case when created_at between timestamp '1998-01-01' and timestamp '1999-12-31' then 'exp-1' end as experiment_id,
    case when created_at between timestamp '1998-01-01' and timestamp '1999-12-31' then case when bucket < 50 then 'control' else 'variant' end end as treatment_id from b""",
    ("cand_core",),
)
def m13(spark, sf):
    exp = ex.Experiment("exp-1", (("control", 50), ("variant", 50)), True, "1998-01-01 00:00:00", "1999-12-31 00:00:00")
    out = ex.record_treatment(candidates(spark, sf, delivery=False), exp)
    return out.select("k", "metadata.experiment_treatment.experiment_id", "metadata.experiment_treatment.treatment_id")


@query(
    "m14_segment_offers",
    """select k, case when quality >= 0.7 then 'premium' when quality >= 0.4 then 'standard' when quality >= 0 then 'basic' end as win_back,
    case when 600 + k % 250 >= 750 then 'excellent' when 600 + k % 250 >= 680 then 'good' when 600 + k % 250 >= 640 then 'fair' else 'declined' end as loan from cand_core""",
    ("cand_core",),
)
def m14(spark, sf):
    return fixture(spark, sf, "cand_core").select(
        "k", sc.segment_offers(F.col("quality"), sc.WIN_BACK_TIERS).alias("win_back"), sc.segment_offers(600 + F.col("k") % 250, sc.LOAN_TIERS, "declined").alias("loan")
    )
