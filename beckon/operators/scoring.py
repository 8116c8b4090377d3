"""Model scoring, fallbacks, score cache, offers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts
from beckon.functions.isolate import with_isolated
from beckon.schema import SCORE, ddl

# fixed values: fallback score, cache lifetimes, ensemble and cascade defaults
FALLBACK_VALUE, FALLBACK_CONFIDENCE = 0.5, 0.1
CACHE_TTL_S = 3600
TTL_VIP_S, TTL_FREQUENT_S, TTL_OTHER_S, FREQUENT_PURCHASES = 300, 1800, 7200, 5
ENSEMBLE_MIN_MODELS, CASCADE_DEFAULT = 2, 50.0


@dataclass(frozen=True)
class Model:
    """M2, the scorer plug-in: ``value`` (and ``confidence``) are columns over the feature row.

    Use a SQL expression, a ``pandas_scorer`` column, or score by batches with
    ``score_batches``.  A null value means the model failed for that row.  A ``value`` given as SQL text is
    isolated: what cannot be evaluated is null for that row alone.
    """

    id: str
    value: Column | str
    confidence: Column | None = None
    version: str = "1"
    required: Sequence[str] = ()
    fallback: float = FALLBACK_VALUE


def pandas_scorer(fn: Callable[..., pd.Series], *cols: str) -> Column:
    """M2: a vectorised scorer over the named feature columns.

    A batch that fails is scored row by row, and rows that fail get null, so one row or
    one model never stops the others.  A model given as SQL text is isolated likewise, see ``Model``; one given as a
    column guards itself with ``try_divide``, ``try_cast`` and the like, since sessions run in ANSI mode.
    """

    def guarded(*values: pd.Series) -> pd.Series:
        try:
            return fn(*values)
        except Exception:  # the model's own failure, whatever it is, is the null of M1
            return pd.Series([_one(fn, [v.iloc[k : k + 1] for v in values]) for k in range(len(values[0]))], dtype="float64")

    return F.pandas_udf(guarded, "double")(*[F.col(c) for c in cols])


def _one(fn: Callable[..., pd.Series], values: list[pd.Series]) -> float | None:
    try:
        return float(fn(*values).iloc[0])
    except Exception:
        return None


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """M2: whole-batch scorer (loads its model once per task)."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def _usable(model: Model) -> Column:
    have = [F.col(f).isNotNull() for f in model.required]
    value = F.col(f"__sql_{model.id}") if isinstance(model.value, str) else model.value
    return F.when(reduce(lambda a, b: a & b, have, F.lit(True)), value)


def score_models(df: DataFrame, models: Sequence[Model], as_of, into: str = "scores") -> DataFrame:
    """M1: every model on its own; a failing or feature-less model has no entry."""
    texts = {f"__sql_{m.id}": f"cast({m.value} as double)" for m in models if isinstance(m.value, str)}
    staged = with_isolated(df, texts).withColumns({f"__v{i}": _usable(m).cast("double") for i, m in enumerate(models)})
    entries = []
    for i, m in enumerate(models):
        score = F.struct(
            F.lit(m.id).alias("model_id"), F.col(f"__v{i}").alias("value"), (F.lit(None) if m.confidence is None else m.confidence).cast("double").alias("confidence"),
            as_ts(as_of).alias("timestamp"), F.create_map(F.lit("modelVersion"), F.lit(m.version)).alias("metadata"),
        ).cast(ddl(SCORE))
        none = F.create_map().cast(f"map<string,{ddl(SCORE)}>")
        entries.append(F.when(F.col(f"__v{i}").isNotNull(), F.create_map(F.lit(m.id), score)).otherwise(none))
    return staged.withColumn(into, F.map_concat(*entries)).drop(*[f"__v{i}" for i in range(len(models))], *texts)


def score_long(df: DataFrame, ids: Sequence[str], scores: str = "scores") -> DataFrame:
    """One row per score."""
    return df.select(*ids, F.explode(F.map_values(scores)).alias("s")).select(*ids, "s.*")


# --- M3 ---


def numeric_feature(kind: Column, num: Column, default: float) -> Column:
    return F.coalesce(F.when(kind == "NUMERIC", num), F.lit(default))


def string_feature(kind: Column, text: Column, default: str) -> Column:
    return F.coalesce(F.when(kind == "STRING", text), F.lit(default))


def boolean_feature(kind: Column, flag: Column, default: bool) -> Column:
    return F.coalesce(F.when(kind == "BOOLEAN", flag), F.lit(default))


# --- M4, M5 ---


def fallback_scores(
    df: DataFrame, value: Column, confidence: Column, cached: Column, cached_confidence: Column, provider: Column | None = None
) -> DataFrame:
    """M4: own score, else unexpired cached one, else the provider's, else the default; with strategy."""

    def entry(v: Column, c: Column, how: str | None) -> Column:
        return F.when(v.isNotNull(), F.struct(v.cast("double").alias("value"), c.cast("double").alias("confidence"), F.lit(how).cast("string").alias("strategy")))

    low = F.lit(FALLBACK_CONFIDENCE)
    given = F.lit(None) if provider is None else provider
    pick = F.coalesce(
        entry(value, confidence, None), entry(cached, cached_confidence, "cached"), entry(given, low, "provider"), entry(F.lit(FALLBACK_VALUE), low, "default")
    )
    out = df.withColumn("__f", pick)
    return out.select(*df.columns, F.col("__f.value").alias("score"), F.col("__f.confidence").alias("score_confidence"), F.col("__f.strategy").alias("fallback_strategy"))


def is_fallback(metadata: Column) -> Column:
    """M5."""
    return F.coalesce(metadata["fallback"] == "true", F.lit(False))


def fallback_strategy(metadata: Column) -> Column:
    """M5: null for regular scores."""
    return metadata["fallbackStrategy"]


# --- M6-M8: cache ---

CACHE_KEY = ("customer_id", "subject_id", "model_id")


def cache_rows(scores: DataFrame, as_of, ttl_overrides: Mapping[str, int] | None = None, ttl: Column | None = None) -> DataFrame:
    """M6: rows to cache with their expiry; null confidence is stored as 0.0."""
    seconds = F.lit(CACHE_TTL_S)
    for model, s in (ttl_overrides or {}).items():
        seconds = F.when(F.col("model_id") == model, F.lit(s)).otherwise(seconds)
    seconds = seconds if ttl is None else ttl
    now = as_ts(as_of)
    return scores.select(
        *CACHE_KEY, "score_value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), now.alias("scored_at"),
        F.timestamp_seconds(F.unix_seconds(now) + seconds).alias("expires_at"),
    )


def write_score_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """M6: keyed overwrite, returned as the new table; of several rows of a key the last scored wins."""
    rest = [c for c in rows.columns if c not in CACHE_KEY]
    order = [c for c in ("scored_at", "expires_at") if c in rest]
    last = rows.groupBy(*CACHE_KEY).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("__v")).select(*CACHE_KEY, "__v.*")
    return cache.join(last.select(*CACHE_KEY), list(CACHE_KEY), "left_anti").unionByName(last)


def tiered_ttl(tier: Column, frequency: Column) -> Column:
    """M7: seconds."""
    return F.when(tier == "vip", TTL_VIP_S).when(frequency > FREQUENT_PURCHASES, TTL_FREQUENT_S).otherwise(TTL_OTHER_S)


def invalidate_cache(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """M8: drop the named entries; ``keys`` may hold the full key or the customer only."""
    on = [c for c in CACHE_KEY if c in keys.columns]
    return cache.join(keys.select(*on), on, "left_anti")


# --- M9, M10, M14 ---


def ensemble(weights: Mapping[str, tuple[Column, float]], required: Sequence[str] = (), min_models: int = ENSEMBLE_MIN_MODELS) -> Column:
    """M9: weighted average over present models; null with too few or a required one missing."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    have = {m: c.isNotNull() for m, (c, _) in weights.items()}
    total = add([F.when(have[m], c * w).otherwise(0.0) for m, (c, w) in weights.items()])
    weight = add([F.when(have[m], F.lit(w)).otherwise(0.0) for m, (_, w) in weights.items()])
    present = add([h.cast("int") for h in have.values()])
    ok = reduce(lambda a, b: a & b, [have[m] for m in required], present >= min_models)
    return F.when(ok, total / weight)


def cascade(by_priority: Sequence[Column], default: float = CASCADE_DEFAULT) -> Column:
    """First available score in priority order."""
    return F.coalesce(*by_priority, F.lit(default))


def segment_offers(score: Column, tiers: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """Offer of the highest tier whose floor is reached."""
    out = None
    for low, offer in sorted(tiers, key=lambda t: -t[0]):
        cond = score >= low
        out = F.when(cond, offer) if out is None else out.when(cond, offer)
    return out.otherwise(F.lit(otherwise))


# fixed values: tiers of the use cases
WIN_BACK_TIERS = ((0.7, "premium"), (0.4, "standard"), (0.0, "basic"))
LOAN_TIERS = ((750.0, "excellent"), (680.0, "good"), (640.0, "fair"))
