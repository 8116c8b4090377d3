"""T1-T9.  Watermark policy is ours: 10 minutes of lateness unless stated, late rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.functions.redact import redact_columns
from beckon.operators.filters import default_chain, filter_chain
from beckon.operators.mapping import candidates_from_events, context_id
from beckon.operators.scoring import Model, score_models
from beckon.operators.timeline import exact
from beckon.operators.velocity import MAX_AMOUNT_PER_HOUR, MAX_COUNT_PER_HOUR
from beckon.sources.events import parse_customer_events, route_events
from beckon.streaming import store
from beckon.streaming.keyed import GROUPS, first_in_window, first_per_window, fold_groups, trailing_seconds

# fixed values: duplicate window and state lifetime in seconds
DEDUP_WINDOW_S, DEDUP_STATE_S = 300, 600
LATENESS_S = 600
LATENESS = "10 minutes"


def _local_first(df: DataFrame, keys: Sequence[str], tick: str, order: Sequence[str], k: int) -> DataFrame:
    """Keep the first ``k`` rows per key and tick of each Arrow batch, before any shuffle.

    Rows beyond them can never pass the stateful step, so a hot key ships at most ``k`` rows
    per tick and batch to its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(list(order))
            if k == 1:
                yield pdf.drop_duplicates([*keys, tick])
            else:
                yield pdf[pdf.groupby([*keys, tick], sort=False, dropna=False).cumcount() < k]

    return df.mapInPandas(run, df.schema)


def dedup_events_stream(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, window_s: int = DEDUP_WINDOW_S, state_s: int = DEDUP_STATE_S, lateness_s: int = LATENESS_S, groups: int = GROUPS
) -> DataFrame:
    """Passes an event unless the key's last passed event is less than ``window_s`` old.

    Exact for ordered arrival; inside a micro-batch rows are ordered by second and tie.  Rows
    later than the watermark, ``lateness_s`` behind the latest event, are dropped; a key is
    forgotten when the watermark is ``state_s`` (at least the window) past its last passed event.
    Rows without a time are left to ``untimed``; null keys are equal to each other.
    """
    src = df.withColumn("__sec", F.unix_seconds(F.col(ts))).withWatermark(ts, f"{lateness_s} seconds")
    order = ["__sec", tie]
    fold = first_per_window("__sec", window_s, max(state_s, window_s) * 1000, 1000)
    first = lambda d: _local_first(d, ["__key"], "__sec", order, 1)
    return fold_groups(src, keys, ts, order, fold, groups=groups, prepare=first).drop("__sec")


def stream_throttle(
    df: DataFrame, key: str, ts: str, tie: str, max_requests: int, window_ms: int, lateness_s: int = LATENESS_S, permits: str | None = None, groups: int = GROUPS
) -> DataFrame:
    """T4: requests a fixed window lets pass; state is the window's start and count.

    With ``permits`` a request takes that many (null: one); one that does not fit takes nothing, and a
    smaller later one may still pass.  A request for less than none never passes and opens no window.
    Rows without a time are left to ``untimed``.
    """
    src = df.withColumn("__ms", F.unix_millis(F.col(ts))).withWatermark(ts, f"{lateness_s} seconds")
    order = list(dict.fromkeys(["__ms", ts, tie]))
    first = None if permits else lambda d: _local_first(d, ["__key"], "__ms", order, max_requests)
    return fold_groups(src, [key], ts, order, first_in_window("__ms", window_ms, max_requests, permits), groups=groups, prepare=first).drop("__ms")


def velocity_stream(df: DataFrame, keys: Sequence[str], ts: str, amount: str | None = None, window_s: int = 3600, lateness_s: int = LATENESS_S, groups: int = GROUPS) -> DataFrame:
    """T6, exact: every event with the count and sum of its key's events in the ``window_s`` seconds up to its own.

    Answers at once, from a ring of seconds per key.  Equal to the batch operators (``velocity_filter``,
    ``change_velocity``) where a key's events arrive in order; a late event counts itself in, but answers given before
    stand.  Sums are exact; NaN and infinite amounts add nothing.
    """
    value = F.coalesce(exact(F.col(amount)), F.lit(0).cast("decimal(28,6)")) if amount else F.lit(0).cast("decimal(28,6)")
    high = F.floor(value / F.lit(1_000_000))
    src = df.withColumns({"__sec": F.unix_seconds(F.col(ts)), "__high": high.cast("bigint"), "__low": ((value - high * 1_000_000) * 1_000_000).cast("bigint")})
    src = src.withWatermark(ts, f"{lateness_s} seconds")
    added = [T.StructField("window_count", T.LongType()), T.StructField("window_amount", T.DoubleType())]
    out = fold_groups(src, keys, ts, ["__sec"], trailing_seconds(window_s), added, groups, reach=window_s)
    return out.drop("__sec", "__high", "__low", *([] if amount else ["window_amount"]))


def velocity_alerts(df: DataFrame, customer: str, ts: str, amount: str, max_count: int = MAX_COUNT_PER_HOUR, max_amount: float = MAX_AMOUNT_PER_HOUR, window_s: int = 3600, lateness_s: int = LATENESS_S) -> DataFrame:
    """The trailing-hour rule of F15 on live events; a NaN amount is not allowed and comes out as null."""
    broken = F.coalesce(F.isnan(amount) | (F.abs(amount) == float("inf")), F.lit(False))
    out = velocity_stream(df.withColumn("__broken", broken), [customer], ts, amount, window_s, lateness_s)
    return out.withColumn("allowed", (F.col("window_count") <= max_count) & (F.col("window_amount") <= max_amount) & ~F.col("__broken")).drop("__broken")


def reactive_candidates(events: DataFrame, as_of=None, body: str = "body", tie: str = "event_id") -> DataFrame:
    """T2, stateless and stateful part: parse, drop bad rows and duplicates, build candidates."""
    parsed = parse_customer_events(events, body, as_of).filter(F.col("parse_error").isNull()).drop("parse_error")
    # the map travels through the keyed fold as text, which Arrow moves far cheaper
    packed = parsed.withColumn("metadata", F.to_json("metadata"))
    kept = dedup_events_stream(packed, ["customerId", "subjectType", "subjectId", "programId"], "eventDate", tie)
    return candidates_from_events(kept.withColumn("metadata", F.from_json("metadata", "map<string,string>")))


def reactive_batch(candidates: DataFrame, models: Sequence[Model], as_of) -> DataFrame:
    """T2, per micro-batch: reactive filter chain, then scores for the passed rows."""
    passed = filter_chain(candidates, default_chain("reactive"), as_of).filter(F.col("rejection").isNull()).drop("rejection")
    return score_models(passed, models, as_of)


STORE_KEYS = ("customer_id", "program_id", "marketplace", "subject_type", "subject_id")


def with_store_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"program_id": context_id("program"), "marketplace": context_id("marketplace"), "subject_type": F.col("subject.type"), "subject_id": F.col("subject.id")}
    )


def append_if_absent(batch: DataFrame, batch_id: int, path: str, order: str) -> None:
    """T2 sink for ``foreachBatch``: candidates whose key is not stored yet, see ``store``."""
    store.append_if_absent(with_store_keys(batch), batch_id, path, order, STORE_KEYS)


def opt_out_tombstones(events: DataFrame) -> DataFrame:
    """Deletions as they stream in, one small row each; the candidate table is not rewritten."""
    return events.select(F.col("customerId").alias("customer_id"), F.col("programId").alias("program_id"), F.col("timestamp").alias("opted_out_at"))


def live_candidates(candidates: DataFrame, tombstones: DataFrame, created: str = "created_at") -> DataFrame:
    """T3 read side (and compaction): rows not created before a matching opt-out."""
    every = tombstones.filter(F.col("program_id").isNull()).groupBy("customer_id").agg(F.max("opted_out_at").alias("__g"))
    single = tombstones.filter(F.col("program_id").isNotNull()).groupBy("customer_id", "program_id").agg(F.max("opted_out_at").alias("__p"))
    out = candidates.join(every, "customer_id", "left").join(single, ["customer_id", "program_id"], "left")
    dead = (F.col(created) <= F.col("__g")) | (F.col(created) <= F.col("__p"))
    return out.filter(~F.coalesce(dead, F.lit(False))).drop("__g", "__p")


def windowed_metrics(df: DataFrame, series: Sequence[str], ts: str, value: str, period: str = "5 minutes", slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts and sums per tumbling (or sliding) window; the same code in batch and stream.

    ``lateness`` sets the watermark of a stream.  Sums combine before the shuffle.
    """
    src = df if lateness is None else df.withWatermark(ts, lateness)
    win = F.window(ts, period) if slide is None else F.window(ts, period, slide)
    out = src.groupBy(win.alias("w"), *series).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(*series, F.col("w.start").alias("window_start"), "events", "total")


def route_stream(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Stateless, see ``route_events``."""
    return route_events(df, rules)


def stream_redact(df: DataFrame) -> DataFrame:
    """Stateless, see ``redact_columns``."""
    return redact_columns(df)


def open_tracking_stream(deliveries: DataFrame, opens: DataFrame, within: str = "2 hours", lateness: str = "1 hour", how: str = "inner") -> DataFrame:
    """Deliveries joined with opens inside a time bound; both states are dropped by watermark."""
    d = deliveries.withWatermark("sent_at", lateness)
    o = opens.select(F.col("delivery_id").alias("__id"), "opened_at").withWatermark("opened_at", lateness)
    bound: Column = (
        (F.col("delivery_id") == F.col("__id")) & (F.col("opened_at") >= F.col("sent_at")) & (F.col("opened_at") <= F.col("sent_at") + F.expr(f"INTERVAL {within}"))
    )
    return d.join(o, bound, how).drop("__id")



def unopened_stream(deliveries: DataFrame, opens: DataFrame, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """Deliveries that nobody opened within the bound, given out once the watermark shows that none can come.

    An outer join of the streams: its unmatched rows leave state with the watermark.  Repeated opens of one delivery
    change nothing, and a delivery without a time is not waited for.
    """
    joined = open_tracking_stream(deliveries.filter(F.col("sent_at").isNotNull()), opens, within, lateness, "leftOuter")
    return joined.filter(F.col("opened_at").isNull()).drop("opened_at")
