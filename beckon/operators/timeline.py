"""Ordered per-key work that stays parallel when one key holds a large part of the rows.

A plain ``Window.partitionBy(key)`` sends a hot key to one task.  The helpers here cut a
key's timeline into buckets, work inside each bucket in parallel, and carry only one
small aggregate row per bucket across.  No helper emits pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86400
MAX_BLOCK_TICKS = 1_000_000  # distinct ticks one block may hold (one gap at least)
ORDER_PARTS = 1000  # ranges of a global order
SPELL = 1024  # blocks of a greedy window that are composed to one
DEPTH = 1_000_000  # rows of one key in one bucket beyond which the bucket is cut into parts of equal depth
CUT_PARTS = 1000  # parts of such a bucket
CUT = ("__bucket", "__part")
_ANY = np.iinfo(np.int64).max


def _bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``names`` treating null keys as equal; the right copies of the keys are dropped."""
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in right.columns])
    cond = [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return left.join(renamed, on, how).drop(*[f"__r_{n}" for n in names])


def exact(value: Column) -> Column:
    """Amounts as decimals with six places, so that sums and their differences are exact; NaN and infinity are null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e22), value).try_cast("decimal(28,6)")


def trailing_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window_s: int,
    sums: dict[str, str] | None = None,
    count_as: str = "trailing_count",
    include_current: bool = False,
    include_start: bool = True,
) -> DataFrame:
    """Per row: count (and sums) of same-key rows in the trailing window, at second precision.

    The window is ``[t - w, t)``; ``include_current`` closes the right end (rows of the same
    second count), ``include_start=False`` opens the left end.

    Rows are pre-aggregated per key and second, so a bucket holds at most ``2 * window_s``
    rows whatever the key's size.  Each second is placed in its own and the next bucket and
    adds a probe at its window start; the answer is a difference of two running sums.
    """
    keys = list(keys)
    sums = sums or {}
    base = df.withColumn("__sec", F.unix_seconds(F.col(ts)))
    parts = {"__n": F.count(F.lit(1)), **{f"__s_{o}": F.sum(exact(F.col(c))) for o, c in sums.items()}}
    per_second = base.groupBy(*keys, "__sec").agg(*[e.alias(n) for n, e in parts.items()])
    names = list(parts)
    zeros = [F.lit(0).alias(n) for n in names]
    vals = [F.col(n).alias(n) for n in names]
    b = _bucket(F.col("__sec"), window_s)
    probe_rank = F.lit(0 if include_start else 2)
    placed = per_second.select(
        *keys,
        F.explode(
            F.array(
                F.struct(b.alias("b"), F.col("__sec").alias("pos"), F.lit(1).alias("kind"), F.col("__sec").alias("home"), *vals),
                F.struct((b + 1).alias("b"), F.col("__sec").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("home"), *vals),
                F.struct(b.alias("b"), (F.col("__sec") - window_s).alias("pos"), probe_rank.alias("kind"), F.col("__sec").alias("home"), *zeros),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    w = Window.partitionBy(*keys, "b").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select(*keys, "b", "kind", "home", *[F.sum(n).over(w).alias(f"{n}_run") for n in names], *names)
    is_event = F.col("kind") == 1
    deltas = []
    for n in names:
        upper = F.col(f"{n}_run") if include_current else F.col(f"{n}_run") - F.coalesce(F.col(n), F.lit(0))
        signed = F.when(is_event, upper).otherwise(-F.col(f"{n}_run"))
        deltas.append(F.sum(F.coalesce(signed, F.lit(0))).alias(f"{n}_win"))
    stats = running.filter(F.col("home").isNotNull()).groupBy(*keys, "b", "home").agg(*deltas)
    stats = stats.drop("b").withColumnRenamed("home", "__sec")
    joined = _null_safe(base, stats, [*keys, "__sec"])
    out = {count_as: "__n_win", **{o: f"__s_{o}_win" for o in sums}}
    total = lambda o: F.coalesce(F.col(out[o]), F.lit(0))
    return joined.select(*df.columns, *[(total(o).cast("double") if o in sums else total(o)).alias(o) for o in out])


def _below(bounds: Column, x: Column, step: int = 32) -> Column:
    """How many of the ascending ``bounds`` lie below ``x``, by a look at every ``step``-th one and at those between two."""
    count = lambda some: F.size(F.filter(some, lambda b: b < x))
    heads = F.filter(bounds, lambda _, i: i % step == 0)
    chunk = F.greatest(count(heads), F.lit(1)) - 1
    return chunk * step + count(F.slice(bounds, chunk * step + 1, step))


def equal_depth_cuts(df: DataFrame, keys: Sequence[str], position: Column, width: int, depth: int | None = None, parts: int = CUT_PARTS) -> DataFrame:
    """Adds the codes ``CUT``, which ascend along ``position`` and cut each key's timeline.

    The first is the bucket of fixed ``width``.  A bucket in which one key has more than ``depth`` rows is cut by
    quantiles of its positions, so that a dense day is up to ``parts`` parts of about equal depth and not one task.
    Quantiles come from mergeable sketches, one for each dense bucket; one number, the largest depth, comes to the driver,
    and where it is small enough nothing is sketched or joined.  Rows of one position stay together, as do those without.
    """
    most = DEPTH if depth is None else depth
    keys = list(keys)
    tagged = df.withColumn("__bucket", _bucket(position, width))
    sizes = tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= most:
        return tagged.withColumn("__part", F.lit(0))
    dense = sizes.filter(F.col("__n") > most).drop("__n")
    rows = _null_safe(tagged.select(*keys, "__bucket", position.alias("__p")), dense, [*keys, "__bucket"], "left_semi")
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    bounds = rows.groupBy(*keys, "__bucket").agg(F.array_distinct(F.percentile_approx("__p", shares, 10 * parts)).alias("__bounds"))
    return _null_safe(tagged, bounds, [*keys, "__bucket"]).withColumn("__part", F.coalesce(_below(F.col("__bounds"), position), F.lit(0))).drop("__bounds")


def _carry(buckets: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last non-null value of earlier buckets; one row per key and bucket goes in and out."""
    w = Window.partitionBy(*keys).orderBy(*CUT).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select(*keys, *CUT, *[F.last(c, ignorenulls=True).over(w).alias(f"__carry_{c}") for c in cols])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    strict: bool = False,
    max_age_s: int | None = None,
    bucket_s: int = DAY,
    depth: int | None = None,
) -> DataFrame:
    """For each left row the latest right row of the same key at or before it (before, if strict).

    ``cols`` of the right row are added, null when there is none or it is older than
    ``max_age_s``.  Equal right times are settled by the highest ``tie``.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_ts).alias("__at"), *[F.col(c) for c in cols])
    rank = F.struct(F.unix_micros(F.col(right_ts)).alias("u"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)])
    r = right.select(*keys, F.unix_micros(F.col(right_ts)).alias("__pos"), F.lit(1 if strict else 0).alias("__side"), payload.alias("__hit"), rank.alias("__rank"))
    r = r.filter(F.col("__pos").isNotNull())
    lrow = F.struct(*[F.col(c) for c in left.columns])
    lside = F.lit(0 if strict else 1)
    l = left.select(*keys, F.unix_micros(F.col(left_ts)).alias("__pos"), lside.alias("__side"), lrow.alias("__row"))
    both = equal_depth_cuts(l.unionByName(r, allowMissingColumns=True), keys, F.col("__pos"), bucket_s * 1_000_000, depth)
    w = Window.partitionBy(*keys, *CUT).orderBy("__pos", "__side", "__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("__in", F.last("__hit", ignorenulls=True).over(w)).filter(F.col("__row").isNotNull())
    table = both.groupBy(*keys, *CUT).agg(F.max_by("__hit", "__rank").alias("__hit"))
    carry = _carry(table, keys, ["__hit"])
    out = _null_safe(inside.select(*keys, *CUT, "__row", "__in"), carry, [*keys, *CUT])
    out = out.withColumn("__got", F.coalesce("__in", "__carry___hit"))
    if max_age_s is not None:
        age = F.unix_micros(F.col(f"__row.{left_ts}")) - F.unix_micros(F.col("__got.__at"))
        out = out.withColumn("__got", F.when(age <= max_age_s * 1_000_000, F.col("__got")))
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in left.columns], *[F.col(f"__got.{c}").alias(c) for c in cols])


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, width: int, cols: Sequence[str], prefix: str = "prev_", depth: int | None = None
) -> DataFrame:
    """``lag(col)`` per key; ``position`` is a number that never falls along ``order``."""
    keys = list(keys)
    tagged = equal_depth_cuts(df, keys, position, width, depth)
    row = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*keys, *CUT).orderBy(*order)
    inside = tagged.withColumn("__in", F.lag(row).over(w))
    table = tagged.groupBy(*keys, *CUT).agg(F.max_by(row, F.struct(*order)).alias("__last"))
    out = _null_safe(inside, _carry(table, keys, ["__last"]), [*keys, *CUT])
    got = F.coalesce("__in", "__carry___last")
    return out.select(*df.columns, *[got[c].alias(f"{prefix}{c}") for c in cols])


def prior_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, width: int, value: str, count_as: str, sum_as: str, depth: int | None = None
) -> DataFrame:
    """Count and sum of ``value`` over all earlier rows of the key (current row excluded)."""
    keys = list(keys)
    tagged = equal_depth_cuts(df, keys, position, width, depth).withColumn("__x", exact(F.col(value)))
    w = Window.partitionBy(*keys, *CUT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = tagged.withColumn("__n", F.count("__x").over(w)).withColumn("__s", F.sum("__x").over(w))
    table = tagged.groupBy(*keys, *CUT).agg(F.count("__x").alias("n"), F.sum("__x").alias("s"))
    wb = Window.partitionBy(*keys).orderBy(*CUT).rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, *CUT, F.sum("n").over(wb).alias("__bn"), F.sum("s").over(wb).alias("__bs"))
    out = _null_safe(inside, table, [*keys, *CUT])
    zero = F.lit(0)
    return out.select(
        *df.columns,
        (F.coalesce("__n", zero) + F.coalesce("__bn", zero)).alias(count_as),
        (F.coalesce("__s", zero) + F.coalesce("__bs", zero)).cast("double").alias(sum_as),
    )


def split_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Column], name: str = "rank", limit: int | None = None
) -> DataFrame:
    """``row_number`` per key with the key's rows spread over ``buckets``.

    ``buckets`` are coarse ascending codes that agree with ``order`` (all rows of a lower
    bucket come first).  With ``limit``, buckets that start after it are dropped before the
    inner sort, which is what keeps a large top-n cheap.
    """
    keys = list(keys)
    marks = [f"__b{i}" for i in range(len(buckets))]
    tagged = df
    for m, b in zip(marks, buckets):
        tagged = tagged.withColumn(m, b)
    counts = tagged.groupBy(*keys, *marks).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *marks, F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    if limit is not None:
        offsets = offsets.filter(F.col("__off") < limit)
    placed = _null_safe(tagged, offsets, [*keys, *marks], "inner")
    rn = F.row_number().over(Window.partitionBy(*keys, *marks).orderBy(*order)) + F.col("__off")
    out = placed.withColumn(name, rn.cast("bigint")).drop(*marks, "__off")
    return out if limit is None else out.filter(F.col(name) <= limit)


def equal_depth(df: DataFrame, column: str, parts: int = ORDER_PARTS, tie: str | None = None) -> tuple[Column, Column]:
    """Two ascending codes that cut a global order by ``column`` (then a numeric ``tie``) into ranges of about equal size.

    Bounds are quantiles of one sketch pass, at most ``parts`` numbers on the driver.  A value that spans several ranges is a
    hot one; its rows are cut by quantiles of their tie.  Nulls come first.  Where ranges end changes cost only.
    """
    shares = [k / parts for k in range(1, parts)]
    exact_value = F.col(column).cast("double") if dict(df.dtypes)[column] not in ("timestamp", "date") else F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    sketch = lambda c: F.percentile_approx(c, F.array(*[F.lit(s) for s in shares]), 10 * parts)
    found = df.agg(sketch(exact_value)).first()[0] or []
    bounds = sorted(set(found))
    hot = [v for v in bounds if found.count(v) > 1]
    ties: dict[float, list[float]] = {}
    if tie is not None and hot:
        rows = df.select(exact_value.alias("v"), F.col(tie).cast("double").alias("t")).filter(F.col("v").isin(hot)).groupBy("v").agg(sketch(F.col("t")).alias("q")).collect()
        ties = {r["v"]: sorted(set(r["q"] or [])) for r in rows}

    @F.pandas_udf("long")
    def place(value: pd.Series) -> pd.Series:
        # 2k + 1 for the k-th bound itself, even numbers between bounds
        x = value.to_numpy(np.float64, na_value=-np.inf)
        return pd.Series(np.searchsorted(bounds, x, side="left") + np.searchsorted(bounds, x, side="right"))

    @F.pandas_udf("long")
    def inner(value: pd.Series, own: pd.Series) -> pd.Series:
        x, t = value.to_numpy(np.float64, na_value=np.nan), own.to_numpy(np.float64, na_value=-np.inf)
        out = np.zeros(len(x), np.int64)
        for v, cuts in ties.items():
            out[x == v] = np.searchsorted(cuts, t[x == v], side="right")
        return pd.Series(out)

    return place(exact_value), inner(exact_value, F.col(tie).cast("double")) if ties else F.lit(0)


def first_k_flag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, ids: Sequence[str], name: str = "position") -> DataFrame:
    """Adds the position of the first ``k`` rows per key, null beyond; every row is kept.

    Only the first rows travel through the window (Spark prunes ``row_number <= k`` before the
    shuffle); the positions come back by a join on the unique ``ids``.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn(name, rn).filter(F.col(name) <= k).select(*ids, F.col(name).cast("bigint").alias(name))
    return _null_safe(df, first, list(ids))


# --- greedy windows: a window opens at the first row at or after the previous opening + gap ---


def _exit_runs(gap: int):
    """For a block's sorted ticks: first and last tick, and the last opening inside per possible first opening.

    Only ticks in the first ``gap`` of the block (and the next one) can be the first opening,
    and neighbouring ones mostly share their exit, so the result is run-length coded.
    """

    @F.pandas_udf("struct<first:bigint,last:bigint,upto:array<bigint>,exit:array<bigint>>")
    def runs(ticks: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for arr, begin in zip(ticks, start):
            s = np.asarray(arr, dtype=np.int64)
            n = min(int(np.searchsorted(s, begin + gap)) + 1, len(s))
            if len(s) == 1:
                rows.append((s[0], s[0], s, s))
                continue
            nxt = np.searchsorted(s, s + gap)
            last = np.arange(len(s))
            for i in range(len(s) - 1, -1, -1):
                if nxt[i] < len(s):
                    last[i] = last[nxt[i]]
            ex = s[last[:n]]
            ends = np.append(np.flatnonzero(np.diff(ex)), n - 1)
            rows.append((s[0], s[-1], s[ends], ex[ends]))
        return pd.DataFrame(rows, columns=["first", "last", "upto", "exit"])

    return runs


def _leave(opened: np.ndarray | int, gap: int, upto: np.ndarray, exits: np.ndarray):
    """Last opening after a block that is entered with the last opening ``opened``."""
    i = np.searchsorted(upto, np.asarray(opened) + gap)
    return np.where(i < len(upto), exits[np.minimum(i, len(exits) - 1)], opened)


def _new_group(pdf: pd.DataFrame, cols: Sequence[str], before: tuple | None) -> tuple[list[bool], tuple]:
    """Which rows start another group than the row before them, and the last row's group."""
    change = np.zeros(len(pdf), dtype=bool)
    for n, c in enumerate(cols):
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
        change[0] |= before is None or before[n] != v[0]
    return change.tolist(), tuple(pdf[c].iat[-1] for c in cols)


def _compose(gap: int):
    """Rows sorted by (key, spell, block): one block for each spell, which stands for all of its blocks in sequence."""
    names = ["__key", "__spell", "first", "last", "upto", "exit"]

    def run(batches):
        before, held = None, None
        for pdf in batches:
            change, before = _new_group(pdf, names[:2], before)
            out = []
            for new, key, spell, first, last, upto, exits in zip(change, *(pdf[c] for c in names)):
                upto, exits = np.asarray(upto, dtype=np.int64), np.asarray(exits, dtype=np.int64)
                if new:
                    if held is not None:
                        out.append(held)
                    held = (key, spell, first, last, upto, exits)
                    continue
                key, spell, first0, last0, upto0, exits0 = held
                if first >= last0 + gap:  # whatever was open, this block begins anew
                    upto1, exits1 = np.array([_ANY]), _leave(exits0[:1], gap, upto, exits)
                else:
                    # entries that open nothing in the blocks so far go on to this one
                    more = upto > upto0[-1]
                    upto1 = np.concatenate([upto0, upto[more]])
                    exits1 = np.concatenate([_leave(exits0, gap, upto, exits), exits[more]])
                ends = np.append(np.flatnonzero(np.diff(exits1)), len(exits1) - 1)
                held = (key, spell, first0, last, upto1[ends], exits1[ends])
            if out:
                yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([held], columns=names)

    return run


def _chain(group: Sequence[str], gap: int, at: Sequence[str], seeded: bool):
    """Rows sorted within groups: the last opening before each; ``seeded`` groups start from their own ``prior``."""

    def run(batches):
        before, opened = None, None
        for pdf in batches:
            change, before = _new_group(pdf, group, before)
            seeds = pdf["prior"] if seeded else [None] * len(pdf)
            priors = []
            for new, seed, upto, exits in zip(change, seeds, pdf["upto"], pdf["exit"]):
                if new:
                    opened = None if pd.isna(seed) else int(seed)
                priors.append(opened)
                opened = int(exits[0]) if opened is None else int(_leave(opened, gap, np.asarray(upto, dtype=np.int64), np.asarray(exits, dtype=np.int64)))
            yield pdf[list(at)].assign(prior=pd.array(priors, dtype="Int64"))

    return run


def _opening_of(gap: int):
    @F.pandas_udf("array<bigint>")
    def assign(ticks: pd.Series, prior: pd.Series) -> pd.Series:
        out = []
        for arr, opened in zip(ticks, prior):
            s = np.asarray(arr, dtype=np.int64)
            has = opened is not None and not pd.isna(opened)
            res = np.full(len(s), int(opened) if has else 0, dtype=np.int64)
            i = int(np.searchsorted(s, int(opened) + gap)) if has else 0
            while i < len(s):
                j = int(np.searchsorted(s, s[i] + gap))
                res[i:j] = s[i]
                i = j
            out.append(res.tolist())
        return pd.Series(out)

    return assign


def greedy_openings(df: DataFrame, keys: Sequence[str], tick: Column, gap: int, block: int | None = None, spell: int = SPELL) -> DataFrame:
    """Distinct ``(keys, tick)`` with the ``opening`` of the greedy window each tick falls in.

    A tick is an opening itself when ``tick = opening``.  Blocks of ``block * gap`` ticks work
    in parallel, and each tells in one short row what it makes of the opening it is entered with.
    These rows are functions, and ``spell`` of them in sequence are composed to one, also in parallel; only
    composed ones of a key pass their state along in sequence, a row for ``spell`` blocks.  So a key that holds
    most rows is spread over its blocks and spells.
    """
    keys = list(keys)
    size = gap * (block or max(1, min(16, MAX_BLOCK_TICKS // gap)))
    ticks = df.select(*keys, tick.cast("bigint").alias("tick")).filter(F.col("tick").isNotNull())
    blocks = ticks.withColumn("__block", _bucket(F.col("tick"), size)).groupBy(*keys, "__block").agg(F.sort_array(F.collect_set("tick")).alias("__ticks"))
    blocks = blocks.withColumn("__key", F.to_json(F.struct(*keys)))
    summary = blocks.select("__key", _bucket(F.col("__block"), spell).alias("__spell"), "__block", _exit_runs(gap)("__ticks", F.col("__block") * size).alias("r"))
    summary = summary.select("__key", "__spell", "__block", "r.*").repartition("__key", "__spell")
    in_spell = ["__key", "__spell", "__block"]
    told = "first bigint, last bigint, upto array<bigint>, exit array<bigint>"
    whole = summary.sortWithinPartitions(*in_spell).mapInPandas(_compose(gap), f"__key string, __spell bigint, {told}")
    chained = whole.repartition("__key").sortWithinPartitions("__key", "__spell")
    entered = chained.mapInPandas(_chain(["__key"], gap, ["__key", "__spell"], False), "__key string, __spell bigint, prior bigint")
    seeded = summary.join(entered, ["__key", "__spell"], "left").repartition("__key", "__spell").sortWithinPartitions(*in_spell)
    priors = seeded.mapInPandas(_chain(["__key", "__spell"], gap, ["__key", "__block"], True), "__key string, __block bigint, prior bigint")
    solved = blocks.join(priors, ["__key", "__block"], "left").withColumn("__open", _opening_of(gap)("__ticks", "prior"))
    pairs = F.explode(F.arrays_zip(F.col("__ticks").alias("tick"), F.col("__open").alias("opening")))
    return solved.select(*keys, pairs.alias("z")).select(*keys, "z.tick", "z.opening")
