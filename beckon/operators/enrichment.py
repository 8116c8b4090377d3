"""Joins and set operations.

No broadcast hints: Spark broadcasts a side when its own size statistics allow it, and
falls back to a shuffled join (with skew splitting) beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts
from beckon.operators.timeline import asof_join


def enrich(df: DataFrame, dim: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Left join that adds ``fields`` of the dimension."""
    return df.join(dim.select(key, *fields), key, "left")


def exclude_engaged(df: DataFrame, engaged: DataFrame, keys: Sequence[str] = ("customer_id", "subject_id")) -> DataFrame:
    """Drop pairs already answered.  Unlike NOT IN, null keys never block a row."""
    return df.join(engaged.select(*keys), list(keys), "left_anti")


def exclude_opted_out(df: DataFrame, opt_outs: DataFrame) -> DataFrame:
    """Global opt-outs (no program) and per-program ones."""
    everywhere = opt_outs.filter(F.col("program_id").isNull()).select("customer_id")
    single = opt_outs.filter(F.col("program_id").isNotNull()).select("customer_id", "program_id")
    return df.join(everywhere, "customer_id", "left_anti").join(single, ["customer_id", "program_id"], "left_anti")


def opted_out_flag(df: DataFrame, opt_outs: DataFrame, name: str = "opted_out") -> DataFrame:
    """J3 as a column, for plans that keep the row with a reason."""
    everywhere = opt_outs.filter(F.col("program_id").isNull()).select("customer_id").distinct().withColumn("__g", F.lit(True))
    single = opt_outs.filter(F.col("program_id").isNotNull()).select("customer_id", "program_id").distinct().withColumn("__p", F.lit(True))
    out = df.join(everywhere, "customer_id", "left").join(single, ["customer_id", "program_id"], "left")
    return out.withColumn(name, F.col("__g").isNotNull() | F.col("__p").isNotNull()).drop("__g", "__p")


def attach_device_tokens(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """Number of device tokens; none gives NO_DEVICE_TOKEN."""
    counts = tokens.groupBy("customer_id").agg(F.count(F.lit(1)).alias("device_count"))
    out = df.join(counts, "customer_id", "left").withColumn("device_count", F.coalesce("device_count", F.lit(0)))
    return out.withColumn("device_error", F.when(F.col("device_count") == 0, "NO_DEVICE_TOKEN"))


def attach_voice_ids(df: DataFrame, voice: DataFrame) -> DataFrame:
    """Voice user id; none gives NO_VOICE_USER_ID."""
    ids = voice.groupBy("customer_id").agg(F.min("voice_user_id").alias("voice_user_id"))
    out = df.join(ids, "customer_id", "left")
    return out.withColumn("voice_error", F.when(F.col("voice_user_id").isNull(), "NO_VOICE_USER_ID"))


def attach_template(df: DataFrame, templates: DataFrame) -> DataFrame:
    """The program's template; none gives NO_TEMPLATE."""
    out = df.join(templates.select("program_id", "template_id"), "program_id", "left")
    return out.withColumn("template_error", F.when(F.col("template_id").isNull(), "NO_TEMPLATE"))


def apply_overrides(configs: DataFrame, overrides: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("program_id", "marketplace"), prefix: str = "o_") -> DataFrame:
    """Marketplace override wins field by field where it is set."""
    out = configs.join(overrides, list(keys), "left")
    merged = [F.coalesce(F.col(prefix + c), F.col(c)).alias(c) if c in fields else F.col(c) for c in configs.columns]
    return out.select(merged)


def programs_for_marketplace(configs: DataFrame, marketplace: str, column: str = "marketplaces") -> DataFrame:
    """Configs that list the marketplace (array column)."""
    return configs.filter(F.array_contains(column, marketplace))


def program_marketplaces(configs: DataFrame, column: str = "marketplaces") -> DataFrame:
    """One row per program and marketplace."""
    return configs.withColumn("marketplace", F.explode(column)).drop(column)


def enabled_programs(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows of enabled programs only."""
    return df.join(configs.filter("enabled").select("program_id"), "program_id", "left_semi")


def lookup_score_cache(df: DataFrame, cache: DataFrame, as_of, keys: Sequence[str] = ("customer_id", "subject_id", "model_id")) -> DataFrame:
    """Unexpired cached score per key (expiry equality still counts), ``cache_hit`` tells.

    Where the cache holds a key twice the last scored row counts, so rows never multiply.
    """
    value = F.struct(F.col("score_value").alias("cached_value"), F.coalesce("confidence", F.lit(0.0)).alias("cached_confidence"), F.col("scored_at").alias("cached_at"))
    live = cache.filter(F.col("expires_at") >= as_ts(as_of)).groupBy(*keys).agg(F.max_by(value, F.struct("scored_at", "score_value")).alias("__v")).select(*keys, "__v.*")
    out = df.join(live, list(keys), "left")
    return out.withColumn("cache_hit", F.col("cached_value").isNotNull())


def attach_features(df: DataFrame, features: DataFrame, required: Sequence[str], entity: str = "customer_id") -> DataFrame:
    """Pivot the required numeric features of the long table and left-join them."""
    wanted = features.filter(F.col("feature").isin(*required))
    wide = wanted.groupBy(entity).agg(*[F.max(F.when(F.col("feature") == n, F.col("num"))).alias(n) for n in required])
    return df.join(wide, entity, "left")


def point_in_time_features(df: DataFrame, history: DataFrame, at: str, feature_time: str, cols: Sequence[str], key: str = "customer_id", tie: Sequence[str] = ()) -> DataFrame:
    """Latest feature row at or before each candidate's time."""
    return asof_join(df, history, [key], at, feature_time, cols, tie=tie, bucket_s=30 * 86400)


def track_opens(deliveries: DataFrame, opens: DataFrame) -> DataFrame:
    """Status OPENED with the first open time, else SENT."""
    first = opens.groupBy("delivery_id").agg(F.min("opened_at").alias("opened_at"))
    out = deliveries.join(first, "delivery_id", "left")
    return out.withColumn("tracking_status", F.when(F.col("opened_at").isNotNull(), "OPENED").otherwise("SENT"))


def compare_v1_v2(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Per customer counts, subjects found on one side only, and whether all agrees.

    A tagged union and two aggregations stand for the full outer join; both combine
    map-side, so a hot customer is no bottleneck.
    """
    side = lambda d, n: d.select("customer_id", "subject_id", F.lit(int(n == 1)).alias("a"), F.lit(int(n == 2)).alias("b"))
    per = side(v1, 1).unionByName(side(v2, 2)).groupBy("customer_id", "subject_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = per.groupBy("customer_id").agg(
        F.sum("a").alias("v1_count"), F.sum("b").alias("v2_count"),
        F.count(F.when(F.col("b") == 0, 1)).alias("only_v1"), F.count(F.when(F.col("a") == 0, 1)).alias("only_v2"),
    )
    return out.withColumns(
        {
            "count_mismatch": F.col("v1_count") != F.col("v2_count"),
            "missing_customer": F.when(F.col("v1_count") == 0, "v1").when(F.col("v2_count") == 0, "v2"),
            "matches": (F.col("v1_count") == F.col("v2_count")) & (F.col("only_v1") == 0) & (F.col("only_v2") == 0),
        }
    )


def attribute_conversions(conversions: DataFrame, touches: DataFrame, window_s: int = 7 * 86400) -> DataFrame:
    """Each conversion with its latest prior touch inside the window (null when none)."""
    return asof_join(conversions, touches, ["customer_id"], "converted_at", "sent_at", ["delivery_id", "channel"], tie=["delivery_id"], max_age_s=window_s)


def channel_attribution(attributed: DataFrame) -> DataFrame:
    """Credited conversions and share per channel."""
    per = attributed.filter(F.col("channel").isNotNull()).groupBy("channel").agg(F.count(F.lit(1)).alias("conversions"))
    total = F.sum("conversions").over(Window.partitionBy())
    return per.withColumn("share", F.round(F.col("conversions") / total, 6))


def batch_get(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose full key is asked for."""
    return df.join(keys.select(*on), list(on), "left_semi")


def customer_history(context: DataFrame) -> DataFrame:
    """One row per customer: engagement map and total, preferences."""
    entry = F.struct(F.col("subject_type").alias("key"), F.col("engagements").alias("value"))
    prefs = ("channel_pref", "likes_high_value", "likes_media", "preferred_window")
    # repeated rows of a type add up, and a missing type counts for the total only
    context = context.groupBy("customer_id", "subject_type").agg(F.sum("engagements").alias("engagements"), *[F.first(c, ignorenulls=True).alias(c) for c in prefs])
    return context.groupBy("customer_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("subject_type").isNotNull(), entry)))).alias("history"),
        F.sum("engagements").alias("history_total"),
        *[F.first(c, ignorenulls=True).alias(c) for c in prefs],
    )


def join_customer_context(df: DataFrame, context: DataFrame) -> DataFrame:
    """The map holds one entry per subject type, so it stays small."""
    return df.join(customer_history(context), "customer_id", "left")


def reconcile_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key missing, extra, changed (with the changed columns) or same."""
    tag = lambda d, n: d.select(*keys, F.struct(*cols).alias(n))
    out = tag(a, "__a").join(tag(b, "__b"), list(keys), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in cols]))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.size("changed") > 0, "changed").otherwise("same")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = out.withColumn("changed", F.when(both, changed).otherwise(F.array().cast("array<string>")))
    return out.withColumn("status", status).drop("__a", "__b")


def split_traffic(df: DataFrame, keys: Sequence[str], share: float = 0.5, salt: str = "migration", into: str = "route") -> DataFrame:
    """J19, the step after a clean comparison: ``new`` for a stable share of the keys, ``old`` for the rest.

    A key's route depends on the key and the salt alone, and a larger share only adds keys to ``new``.
    """
    digest = F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    return df.withColumn(into, F.when(place < round(share * 10_000), "new").otherwise("old"))


def attach_country_settings(df: DataFrame, settings: DataFrame, defaults: Mapping[str, object], key: str = "country") -> DataFrame:
    """Per-country settings with defaults."""
    out = df.join(settings, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# --- set operations ---


def union_attempts(delivered: DataFrame, failed: DataFrame) -> DataFrame:
    """All attempts; columns absent on one side are null."""
    return delivered.unionByName(failed, allowMissingColumns=True)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2."""
    return a.subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3."""
    return a.intersect(b)


def union_connectors(frames: Sequence[DataFrame]) -> DataFrame:
    """U4: rows of several connectors with differing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def match_share(hit: Column) -> Column:
    """Share of rows for which ``hit`` holds, 0.0 for no rows."""
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))
