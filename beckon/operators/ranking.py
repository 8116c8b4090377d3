"""Ranking, top-k and throttling.

Top-k filters are written so that Spark prunes rows before the shuffle (``row_number <= k``
up to its group-limit threshold); larger cuts and full rankings go through
``split_row_number``, which spreads one key over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.functions.convert import as_ts, days_between
from beckon.operators.filters import serving_eligible
from beckon.operators.mapping import context_id, max_score, score_value, strip_scores
from beckon.operators.timeline import _null_safe, equal_depth, greedy_openings, previous_row, split_row_number

# fixed values: subject priorities per channel
CHANNEL_PRIORITIES = {
    "email": ("product", "service", "event"),
    "in-app": ("product", "video", "track"),
    "push": ("event", "product", "service"),
    "voice": ("product", "service"),
    "sms": ("event", "product"),
}
# fixed values: weights of the personalized score
W_BASE, W_AFFINITY, W_RECENCY, W_CHANNEL, W_PREFERENCE = 0.4, 0.25, 0.15, 0.1, 0.1
NEUTRAL, PREFERENCE_BOOST, HIGH_VALUE, DEFAULT_WINDOW_DAYS = 0.5, 0.2, 100.0, 7
UNKNOWN_PRIORITY = 2147483647
SCORE_STEPS = 1000  # score buckets of a split ranking


@dataclass(frozen=True)
class Strategy:
    """Sort keys, and coarse ascending codes of the leading key for split ranking."""

    order: tuple[Column, ...]
    buckets: tuple[Column, ...]


def _day(col: Column) -> Column:
    return F.floor(F.unix_seconds(col) / 86400)


def _score_buckets(score: Column, then: Column) -> tuple[Column, ...]:
    """Descending score buckets; the mass at exactly zero is split by ``then``."""
    zero = score == 0
    return F.when(zero, 1).otherwise(-F.floor(score * SCORE_STEPS)), F.when(zero, then).otherwise(F.lit(0))


def _tie_bucket(tie: str, step: int | None) -> Column:
    return F.lit(0) if step is None else F.floor(F.col(tie) / step)


def subject_priority(channel: Column | str | None, subject_type: Column) -> Column:
    """Index of the subject type in the channel's list, unknown last."""
    if channel is None:
        return F.lit(UNKNOWN_PRIORITY)
    table = F.create_map(*[x for c, kinds in CHANNEL_PRIORITIES.items() for x in (F.lit(c), F.array(*[F.lit(k) for k in kinds]))])
    kinds = table[F.lit(channel) if isinstance(channel, str) else channel]
    at = F.coalesce(F.array_position(kinds, subject_type), F.lit(0))
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.lit(UNKNOWN_PRIORITY))


def by_default(channel: Column | str | None, primary_model: str, tie: str) -> Strategy:
    """Primary score, then recency, then subject priority."""
    score = F.coalesce(score_value(primary_model), F.lit(0.0))
    at = F.col("attributes.event_date")
    return Strategy((score.desc(), at.desc(), subject_priority(channel, F.col("subject.type")).asc(), F.asc(tie)), _score_buckets(score, -_day(at)))


def by_score(tie: str, tie_step: int | None = None) -> Strategy:
    """Best score of any model.

    With a numeric ``tie``, ``tie_step`` also splits the rows that have no score at all.
    """
    score = max_score()
    return Strategy((score.desc(), F.asc(tie)), _score_buckets(score, _tie_bucket(tie, tie_step)))


def by_recency(tie: str) -> Strategy:
    """W3."""
    at = F.col("attributes.event_date")
    return Strategy((at.desc(), F.asc(tie)), (-_day(at),))


def composite(strategies: Sequence[Strategy]) -> Strategy:
    """Stable re-sorts in sequence, so the last strategy leads and the first breaks ties.

    Each strategy's own final tiebreak must be left out but for the last used one: pass
    strategies whose order ends with the same tie column.
    """
    keys: list[Column] = []
    for s in reversed(strategies):
        keys.extend(s.order[:-1])
    return Strategy((*keys, strategies[0].order[-1]), strategies[-1].buckets)


def _group_limit(df: DataFrame) -> int:
    """Largest ``row_number <= k`` that Spark prunes before the shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def rank(df: DataFrame, keys: Sequence[str], strategy: Strategy, limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rank per key, all rows or the first ``limit``."""
    if limit is not None and limit <= _group_limit(df):
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*strategy.order))
        return df.withColumn(name, rn).filter(F.col(name) <= limit).withColumn(name, F.col(name).cast("bigint"))
    return split_row_number(df, keys, strategy.order, strategy.buckets, name, limit)


# --- W5, W6: personalized ---


def affinity_score(own: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(NEUTRAL)).otherwise(F.least(F.coalesce(own, F.lit(0)) / total * 2.0, F.lit(1.0)))


def recency_score(event_date: Column, as_of, window: Column) -> Column:
    """Above one for events after ``as_of``; zero when the window is zero or the date is null."""
    days = F.coalesce(window, F.lit(DEFAULT_WINDOW_DAYS))
    age = F.try_divide(days_between(event_date, as_ts(as_of)).cast("double"), days.cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - age), F.lit(0.0))


def preference_score(order_value: Column, likes_value: Column, media: Column, likes_media: Column) -> Column:
    boost = lambda cond: F.when(F.coalesce(cond, F.lit(False)), PREFERENCE_BOOST).otherwise(0.0)
    return F.least(F.lit(NEUTRAL) + boost((order_value > HIGH_VALUE) & likes_value) + boost(media & likes_media), F.lit(1.0))


def personalized_score(df: DataFrame, as_of, primary_model: str, channel: str | None = None) -> DataFrame:
    """Needs the columns of ``join_customer_context`` beside the candidate."""
    pref = F.lit(NEUTRAL) if channel is None else F.coalesce(F.col("channel_pref"), F.lit(NEUTRAL))
    own = F.element_at("history", F.col("subject.type"))
    a = F.col("attributes")
    value = (
        F.coalesce(score_value(primary_model), F.lit(NEUTRAL)) * W_BASE
        + affinity_score(own, F.col("history_total")) * W_AFFINITY
        + recency_score(a["event_date"], as_of, F.col("preferred_window")) * W_RECENCY
        + pref * W_CHANNEL
        + preference_score(a["order_value"], F.col("likes_high_value"), a["media_eligible"], F.col("likes_media")) * W_PREFERENCE
    )
    return df.withColumn("personal_score", value)


def by_personal_score(tie: str) -> Strategy:
    score = F.col("personal_score")
    return Strategy((score.desc(), F.asc(tie)), (-F.floor(score * SCORE_STEPS),))


# --- W7, W8: serving ---


def serve(requests: DataFrame, candidates: DataFrame, primary_model: str, tie: str, as_of=None) -> DataFrame:
    """Answer a table of requests in one pass.

    A null program or channel restricts nothing.  ``as_of`` turns the eligibility refresh
    on.  Requests bring request_id, customer_id, channel, program_id, max_results (any number;
    V15 tells which the service would refuse) and include_scores.

    No question is ranked to its end: hits beyond the most that any question asks are pruned before the shuffle, up to
    Spark's group limit.  Questions that ask for more than that are ranked apart, where whole score buckets go first.
    Two numbers about the requests come to the driver.
    """
    c = candidates.filter(serving_eligible(as_of)) if as_of is not None else candidates
    asked = ["customer_id", "channel", "program_id"]
    # equal questions are answered once, so many requests of one customer do not multiply its rows
    questions = requests.groupBy(*asked).agg(F.max("max_results").alias("__most"))
    few = _group_limit(requests)
    ask_few = F.col("__most") <= few
    known = questions.agg(F.max(F.when(ask_few, F.col("__most"))).alias("few"), F.max("__most").alias("most")).first()

    def best(asking: DataFrame, limit: int) -> DataFrame:
        hit = c.join(asking, "customer_id")
        program_ok = F.col("program_id").isNull() | (context_id("program") == F.col("program_id"))
        channel_ok = F.col("channel").isNull() | F.coalesce(F.element_at("attributes.channel_eligibility", F.col("channel")), F.lit(False))
        ranked = rank(hit.filter(program_ok & channel_ok), asked, by_default(F.col("channel"), primary_model, tie), limit)
        return ranked.filter(F.col("rank") <= F.col("__most")).drop("__most")

    ranked = best(questions.filter(ask_few), max(known["few"] or 0, 0))
    if (known["most"] or 0) > few:
        ranked = ranked.unionByName(best(questions.filter(~ask_few), known["most"]))
    answers = _null_safe(ranked, requests.select("request_id", *asked, "max_results", "include_scores"), asked, "inner")
    return strip_scores(answers.filter(F.col("rank") <= F.col("max_results")), "include_scores")


def serve_batch(requests: DataFrame, candidates: DataFrame, primary_model: str, tie: str) -> DataFrame:
    """Results per request without refresh, zero for requests that found nothing."""
    found = serve(requests, candidates, primary_model, tie).groupBy("request_id").agg(F.count(F.lit(1)).alias("results"))
    out = requests.select("request_id", "customer_id").join(found, "request_id", "left")
    return out.withColumn("results", F.coalesce("results", F.lit(0)))


# --- W9-W12: index-like reads ---


def top_by_program_channel(df: DataFrame, program: str, channel: str, primary_model: str, limit: int = 100, ascending: bool = False) -> DataFrame:
    """Ordered by the text key ``SCORE#..#CUSTOMER#..``, as the sorted index would be."""
    score = F.coalesce(score_value(primary_model), F.lit(0.0))
    key = F.concat(F.lit("SCORE#"), F.format_string("%.6f", score), F.lit("#CUSTOMER#"), F.col("customer_id"))
    hit = df.filter((context_id("program") == program) & F.coalesce(F.col("attributes.channel_eligibility")[channel], F.lit(False)))
    hit = hit.withColumn("sort_key", key)
    tie = F.col("subject.id")
    order = (F.asc("sort_key"), tie.asc()) if ascending else (F.desc("sort_key"), tie.desc())
    return hit.orderBy(*order).limit(limit)


def by_program_date(df: DataFrame, program: str, date: str, limit: int) -> DataFrame:
    """Candidates created on one UTC date, oldest first."""
    day = F.lit(date).cast("timestamp")
    at = F.col("metadata.created_at")
    hit = df.filter((at >= day) & (at < day + F.expr("INTERVAL '1' DAY")) & (context_id("program") == program))
    return hit.orderBy(at.asc(), F.asc("customer_id"), F.col("subject.id").asc()).limit(limit)


def top_n_per_group(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int, floor: float | None = None, tie_step: int | None = None) -> DataFrame:
    """Best n per group above an optional score floor; any n, any group size."""
    src = df if floor is None else df.filter(F.col(score) >= floor)
    s = F.coalesce(F.col(score), F.lit(0.0))
    return rank(src, keys, Strategy((s.desc(), F.asc(tie)), _score_buckets(s, _tie_bucket(tie, tie_step))), n)


def by_status_min_score(df: DataFrame, status: str, min_score: float, newest_first: bool, page_size: int, at: str, score: str, tie: str) -> DataFrame:
    """Page number of each match in the chosen order, without one task sorting all.

    Ranges of equal depth are numbered apart; of the whole table only their counts are added up in sequence.
    """
    hit = df.filter((F.col("status") == status) & (F.col(score) >= min_score))
    lead = at if newest_first else score
    numeric = dict(df.dtypes)[tie] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    outer, inner = equal_depth(hit, lead, tie=tie if numeric else None)
    ranked = split_row_number(hit, [], [F.desc_nulls_last(lead), F.asc(tie)], [-outer, inner], "row_no")
    return ranked.withColumn("page_no", F.floor((F.col("row_no") - 1) / page_size).cast("bigint"))


def keyset_page(df: DataFrame, score: str, tie: str, size: int, after: tuple[float, object] | None = None) -> DataFrame:
    """Next page after the last (score, tie) of the previous one, highest score first."""
    if after is not None:
        df = df.filter((F.col(score) < after[0]) | ((F.col(score) == after[0]) & (F.col(tie) > after[1])))
    return df.orderBy(F.desc(score), F.asc(tie)).limit(size)


# --- W13-W15: throttles and queues ---


def fixed_window_throttle(df: DataFrame, key: str, ts: str, tie: str, max_requests: int, window_ms: int, permits: str | None = None) -> DataFrame:
    """The first request opens a window, later ones pass while the window has room.

    A window resets with the first request at or after its length; denied requests do not
    count, so the first ``max_requests`` of each window pass.  Millisecond precision.
    With ``permits`` a request takes that many (null: one); one that does not fit takes nothing,
    and a smaller later one may still pass.  A request for less than none never passes and opens no window.
    """
    tick = F.unix_millis(F.col(ts))
    opens = df if permits is None else df.filter(F.coalesce(F.col(permits) >= 0, F.lit(True)))
    opened = greedy_openings(opens, [key], tick, window_ms).select(key, F.col("tick").alias("__t"), F.col("opening").alias("window_start_ms"))
    placed = _null_safe(df.withColumn("__t", tick), opened, [key, "__t"])
    if permits is not None:
        return _take_permits(placed.drop("__t"), [key, "window_start_ms"], [ts, tie], permits, max_requests)
    return _first_in_window(placed, [key, "window_start_ms"], ts, tie, max_requests).drop("__t")


def _take_permits(df: DataFrame, window: Sequence[str], order: Sequence[str], permits: str, most: int) -> DataFrame:
    """Rows stream by in order; what a window has used is all that is held."""
    keyed = df.withColumn("__w", F.xxhash64(*window)).withColumn("__n", F.coalesce(F.col(permits).cast("bigint"), F.lit(1)))

    def run(batches):
        at, used = None, 0
        for pdf in batches:
            allowed = []
            for w, n in zip(pdf["__w"].tolist(), pdf["__n"].tolist()):
                if w != at:
                    at, used = w, 0
                fits = 0 <= n and used + n <= most
                used += n if fits else 0
                allowed.append(fits)
            yield pdf.assign(allowed=allowed)

    schema = T.StructType([*keyed.schema.fields, T.StructField("allowed", T.BooleanType())])
    sorted_rows = keyed.repartition("__w").sortWithinPartitions("__w", *order)
    return sorted_rows.mapInPandas(run, schema).drop("__w", "__n")


def _first_in_window(df: DataFrame, keys: Sequence[str], ts: str, tie: str, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(ts), F.asc(tie)))
    passed = df.withColumn("__rn", rn).filter(F.col("__rn") <= k).select(F.col(tie), F.lit(True).alias("__ok"))
    return df.join(passed, tie, "left").withColumn("allowed", F.col("__ok").isNotNull()).drop("__ok")


def tumbling_throttle(df: DataFrame, key: str, ts: str, tie: str, max_requests: int, period: str = "1 minute") -> DataFrame:
    """The same on clock-aligned windows."""
    timed = df.withColumn("window_start", F.window(ts, period)["start"])
    return _first_in_window(timed, [key, "window_start"], ts, tie, max_requests)


def dequeue_fifo(queue: DataFrame, n: int, channel: str | None = None, at: str = "enqueued_at", tie: str = "delivery_id") -> DataFrame:
    """Oldest n per channel (or of one channel); n = 1 peeks."""
    src = queue if channel is None else queue.filter(F.col("channel") == channel)
    s = Strategy((F.asc(at), F.asc(tie)), (_day(F.col(at)),))
    return rank(src, ["channel"], s, n, "position")


# --- W17-W19 ---


def version_monotonic_check(df: DataFrame, key: str, at: str, tie: str, version: str = "version", step: int = 100_000) -> DataFrame:
    """``violation`` when the version does not rise by one, or the time falls.

    Rows are ordered by version; ``step`` versions form one bucket of a key's history.
    """
    out = previous_row(df, [key], [version, tie], F.col(version), step, [version, at])
    wrong = (F.col(version) != F.col(f"prev_{version}") + 1) | (F.col(at) < F.col(f"prev_{at}"))
    return out.withColumn("violation", F.coalesce(wrong, F.lit(False)))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current state from versions; an aggregation, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v"))
    return last.select(*keys, "__v.*")


def daily_quota(df: DataFrame, client: str, day: Column, score: str, tie: str, quota: str) -> DataFrame:
    """Best candidates per client and day up to the row's own quota."""
    timed = df.withColumn("quota_day", day)
    s = F.coalesce(F.col(score), F.lit(0.0))
    ranked = rank(timed, [client, "quota_day"], Strategy((s.desc(), F.asc(tie)), _score_buckets(s, F.lit(0))))
    return ranked.filter(F.col("rank") <= F.col(quota))
