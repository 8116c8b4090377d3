"""Candidate state as pure functions old + changes -> new.

Tables are immutable inputs and outputs; a caller writes the result.  All matching is by
key joins, so no operator needs a table format with MERGE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beckon.functions.convert import as_ts

HISTORY_DAYS = 90


def _first_per_key(df: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("__v"), F.count(F.lit(1)).alias("__n")).select(*keys, "__v.*")


def create_if_absent(store: DataFrame, new: DataFrame, keys: Sequence[str], tie: str) -> tuple[DataFrame, DataFrame]:
    """(store with the new keys added, rows refused because the key exists).

    Of rows with the same key in one batch the lowest ``tie`` is inserted.
    """
    keys = list(keys)
    winners = _first_per_key(new, keys, tie)
    fresh = winners.join(store.select(*keys), keys, "left_anti")
    refused = new.join(fresh.select(tie), tie, "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True), refused


def update_if_version(store: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str], as_of, guard: str = "version", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new store, conflicts).  ``updates`` brings keys, fields and ``expected_<guard>``.

    A match raises the version by one and stamps updated_at; a wrong expectation or an unknown
    key is a conflict.  With ``guard="updated_at"`` the row must be unchanged since that time.
    Of several updates of one key that match, the first by ``order`` (else by expectation and
    fields) wins; the others come too late and are conflicts.
    """
    keys = list(keys)
    expected, actual = f"expected_{guard}", f"actual_{guard}"
    place = Window.partitionBy(*keys, expected).orderBy(*([order] if order else []), *fields)
    ranked = updates.withColumn("__place", F.row_number().over(place)).select(*keys, expected, F.struct(*fields).alias("__u"), "__place")
    u = ranked.filter("__place = 1").join(store.select(*keys, F.col(guard).alias(expected)), [*keys, expected], "left_semi")
    both = store.join(u, keys, "left")
    hit = F.coalesce(F.col(expected) == F.col(guard), F.lit(False))
    both = both.withColumn("__hit", hit)
    change = {f: F.col(f"__u.{f}") for f in fields} | {"version": F.col("version") + 1, "updated_at": as_ts(as_of)}
    after = both.select([F.when(F.col("__hit"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in store.columns])
    current = store.select(*keys, F.col(guard).alias(actual), F.lit(True).alias("__known"))
    seen = ranked.select(*keys, expected, "__place").join(current, keys, "left")
    late = F.when(F.col("__place") > 1, True).otherwise(~F.coalesce(F.col(actual) == F.col(expected), F.lit(False)))
    bad = seen.filter(late).withColumn("conflict", F.when(F.col("__known").isNull(), "NOT_FOUND").otherwise("VERSION_MISMATCH"))
    return after, bad.drop("__known", "__place")


def delete_keys(store: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Idempotent; unknown keys are ignored."""
    return store.join(keys.select(*on), list(on), "left_anti")


def upsert(store: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Put-overwrite; of several rows for one key the highest ``order`` wins."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v")).select(*keys, "__v.*")
    return store.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_report(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to store, failed rows)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def mark_consumed(candidates: DataFrame, deliveries: DataFrame, keys: Sequence[str], at: str = "sent_at", channel: str = "channel") -> DataFrame:
    """Consumed at the first delivery, version up by one; already consumed rows stay as they are.

    ``candidates`` is nested; ``deliveries`` carries the key columns also present on candidates.
    """
    keys = list(keys)
    first = deliveries.groupBy(*keys).agg(F.min_by(F.struct(F.col(at).alias("at"), F.col(channel).alias("channel")), F.struct(at, channel)).alias("__d"))
    out = candidates.join(first, keys, "left")
    on = F.col("__d").isNotNull() & ~F.coalesce(F.col("attributes.consumed"), F.lit(False))
    a, m = F.col("attributes"), F.col("metadata")
    used = a.withField("consumed", F.lit(True)).withField("consumed_at", F.col("__d.at")).withField("consumed_channel", F.col("__d.channel"))
    bumped = m.withField("version", m["version"] + 1).withField("updated_at", F.col("__d.at"))
    out = out.withColumn("__on", on)
    return out.withColumns({"attributes": F.when(F.col("__on"), used).otherwise(a), "metadata": F.when(F.col("__on"), bumped).otherwise(m)}).drop("__d", "__on")


def refresh_candidates(candidates: DataFrame, eligible: Column, as_of) -> DataFrame:
    """Ineligible rows lose all channels; version up by one for every refreshed row."""
    a, m = F.col("attributes"), F.col("metadata")
    off = F.transform_values(a["channel_eligibility"], lambda k, v: F.lit(False))
    out = candidates.withColumn("__ok", F.coalesce(eligible, F.lit(False)))
    closed = F.when(F.col("__ok"), a).otherwise(a.withField("channel_eligibility", off))
    return out.withColumns(
        {"attributes": closed, "metadata": m.withField("version", m["version"] + 1).withField("updated_at", as_ts(as_of))}
    ).drop("__ok")


def opt_out_delete(candidates: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted count per customer).  A null program deletes all programs."""
    everywhere = events.filter(F.col("program_id").isNull()).select("customer_id").distinct()
    single = events.filter(F.col("program_id").isNotNull()).select("customer_id", "program_id").distinct()
    left = candidates.join(everywhere, "customer_id", "left_anti").join(single, ["customer_id", "program_id"], "left_anti")
    asked = events.select("customer_id").distinct()
    marked = candidates.select("customer_id", "program_id").join(everywhere.withColumn("__g", F.lit(True)), "customer_id", "left")
    marked = marked.join(single.withColumn("__p", F.lit(True)), ["customer_id", "program_id"], "left")
    gone = marked.filter(F.col("__g").isNotNull() | F.col("__p").isNotNull()).groupBy("customer_id").agg(F.count(F.lit(1)).alias("deleted"))
    counts = asked.join(gone, "customer_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    return left, counts


def status_lifecycle(candidates: DataFrame, events: DataFrame, as_of, keys: Sequence[str], expires: str = "expires_at") -> DataFrame:
    """PENDING, SENT, ENGAGED from engagement events; unengaged rows past their TTL are EXPIRED."""
    stage = F.when(F.col("engagement") == "SENT", 1).when(F.col("engagement").isin("OPENED", "CLICKED", "RESPONDED"), 2).otherwise(0)
    reached = events.groupBy(*keys).agg(F.max(stage).alias("__s"))
    out = candidates.join(reached, list(keys), "left")
    s = F.coalesce(F.col("__s"), F.lit(0))
    status = F.when(s == 2, "ENGAGED").when(as_ts(as_of) > F.col(expires), "EXPIRED").when(s == 1, "SENT").otherwise("PENDING")
    return out.withColumn("status", status).drop("__s")


def engagement_history(history: DataFrame, events: DataFrame, as_of, at: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Append, then drop entries older than 90 days."""
    limit = F.unix_micros(as_ts(as_of)) - days * 86_400_000_000
    return history.unionByName(events).filter(F.unix_micros(F.col(at)) >= limit)


def workflow_completed_event(summary: DataFrame, as_of) -> DataFrame:
    """One JSON event per run from ``workflow_summary`` rows."""
    detail = F.struct(
        F.col("execution_id").alias("executionId"), F.col("stored").alias("totalStored"), F.col("success"), F.date_format(as_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    )
    return summary.select(F.lit("WorkflowCompleted").alias("detail_type"), "execution_id", F.to_json(detail).alias("detail"))
