"""The flagship: orders to scored, filtered and ranked candidates; and a stage hand-off."""

from __future__ import annotations

from pyspark.sql import functions as F

from beckon.operators import filters as fl
from beckon.operators import metrics as me
from beckon.operators import ranking as rk
from beckon.operators import scoring as sc
from beckon.operators.mapping import context_id, score_value
from beckon.plans.fixtures import AS_OF_ORDERS, candidates, fixture
from beckon.plans.registry import query
from beckon.sources.stages import read_stage, write_stage
from beckon.streaming.core import work_dir

CHAIN = [
    fl.FilterSpec("eligibility", "eligibility", 0, True, {"requiredChannels": ["email"]}),
    fl.FilterSpec("trust", "trust", 1, True, {"minTrustScore": 0.2, "maxFraudScore": 0.9}),
    fl.FilterSpec("quality", "quality", 2, True, {"minQualityScore": 0.1, "minConfidence": 0.1}),
    fl.FilterSpec("business_rule", "business_rule", 3, True, {"minOrderValue": 5000.0, "requireDeliveryDate": True}),
]


def models():
    return [
        sc.Model("trust", F.col("trust"), F.lit(0.9)),
        sc.Model("fraud", F.col("fraud")),
        sc.Model("quality", F.col("quality"), F.col("quality_conf")),
        sc.Model("engagement", F.least(F.lit(1.0), F.col("avg_order_value") / 500000.0 * 0.6 + F.least(F.lit(10), F.col("purchase_frequency")) / 10.0 * 0.4), F.lit(0.8), "1", ("avg_order_value",)),
    ]


FLAG_CODES = """case when not email then 'CHANNEL_INELIGIBLE' when timing_window is null then 'TIMING_WINDOW_MISSING' when trust is null then 'TRUST_SCORE_MISSING' when trust < 0.2 then 'TRUST_SCORE_LOW' when fraud > 0.9 then 'FRAUD_DETECTED'
  when quality is null then 'QUALITY_SCORE_MISSING' when quality < 0.1 then 'QUALITY_SCORE_LOW' when quality_conf < 0.1 then 'CONFIDENCE_LOW' when order_value is null then 'ORDER_VALUE_MISSING' when order_value < 5000 then 'ORDER_VALUE_LOW'
  when delivery_date is null then 'DELIVERY_DATE_MISSING' end"""
FLAG_SQL = f"""(select c.k, c.customer_id, c.program_id, c.event_date, c.subject_type, {FLAG_CODES} as code,
  least(1.0e0, f.avg_order_value / 500000.0e0 * 0.6e0 + least(10, f.order_count) / 10.0e0 * 0.4e0) as engagement from cand c join features f on f.customer_id = c.customer_id)"""


def filtered(spark, sf):
    features = fixture(spark, sf, "features").select("customer_id", "avg_order_value", F.col("order_count").alias("purchase_frequency"))
    df = candidates(spark, sf).join(features, "customer_id")
    own = {m: F.col("scores")[m] for m in ("trust", "fraud", "quality")}
    df = df.withColumns({"trust": own["trust"]["value"], "fraud": own["fraud"]["value"], "quality": own["quality"]["value"], "quality_conf": own["quality"]["confidence"]})
    scored = sc.score_models(df.drop("scores"), models(), AS_OF_ORDERS)
    return fl.filter_chain(scored, CHAIN, AS_OF_ORDERS)


@query(
    "flagship_top_candidates",
    f"""select customer_id, k, program_id, engagement, rank from (select *, row_number() over (partition by customer_id order by engagement desc, event_date desc,
      case subject_type when 'product' then 0 when 'service' then 1 when 'event' then 2 else 99 end, k) as rank from {FLAG_SQL} where code is null) where rank <= 3""",
    ("cand", "features"),
)
def flagship(spark, sf):
    passed = filtered(spark, sf).filter(F.col("rejection").isNull())
    top = rk.rank(passed, ["customer_id"], rk.by_default("email", "engagement", "k"), 3)
    return top.select("customer_id", "k", context_id("program").alias("program_id"), score_value("engagement").alias("engagement"), "rank")


@query(
    "flagship_rejections",
    f"select code as reason_code, count(*) as rejections from {FLAG_SQL} where code is not null group by 1",
    ("cand", "features"),
)
def flagship_rejections(spark, sf):
    return me.rejection_counts(filtered(spark, sf).filter(F.col("rejection").isNotNull()).select("rejection.reason_code"), ["reason_code"])


@query(
    "s5_stage_hand_off",
    f"select k, {FLAG_CODES} is null as passed from cand",
    ("cand",),
)
def s5(spark, sf):
    root = work_dir(spark, "stages")
    out = fl.filter_chain(candidates(spark, sf), CHAIN, AS_OF_ORDERS).select("k", F.col("rejection").isNull().alias("passed"))
    write_stage(out, root, "exec-1", "filter")
    return read_stage(spark, root, "exec-1", "filter")
