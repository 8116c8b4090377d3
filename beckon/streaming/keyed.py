"""State of many keys in one fold: groups of keys share a state row and are worked on as arrays.

A Python call for each key costs milliseconds, so keys are dealt to ``groups`` by a hash and one call folds all keys of
a group that a micro-batch touches.  The state of a group is one packed Arrow table with a row for each key (or key and
second); only touched groups are read and written.  Rows leave the state when the watermark has passed what could still
need them, and a group that is not touched any more times out with its last row.  ``GROUPS`` is fixed for the life of a
checkpoint; a thousand keys a group is a good size.

A task holds about ``SLICE`` rows of a group at once: what a micro-batch has beyond them waits in the task's temp folder
and is folded slice by slice, in time order.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

GROUPS = 128
SLICE = 100_000  # rows of a group that are worked on at once
STEP = 64  # one in so many ticks is looked at when slices are cut
PIECE = 1024  # rows of a file that are read at once
NONE = np.iinfo(np.int64).min  # no state yet

# (held, rows in order, watermark in ms) -> (rows out, held, ms from which held is not needed any more)
Fold = Callable[[pd.DataFrame | None, pd.DataFrame, int], tuple[pd.DataFrame, pd.DataFrame, int]]


def untimed(df: DataFrame, ts: str) -> DataFrame:
    """The side output of the keyed operators: rows without an event time, which have no place in any window."""
    return df.filter(F.col(ts).isNull())


def with_arrival(df: DataFrame, ts: str, arrival: str) -> DataFrame:
    """A missing event time is the arrival time."""
    return df.withColumn(ts, F.coalesce(ts, arrival))


def packed(table: pd.DataFrame) -> bytes:
    arrow = pa.Table.from_pandas(table, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(arrow)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def in_slices(batches: Iterator[pd.DataFrame], tick: str, most: int = SLICE, nested: Sequence[str] = ()) -> Iterator[tuple[pd.DataFrame, bool]]:
    """All rows in frames of about ``most`` rows, from low ticks to high ones, and whether a frame is the last.

    Rows of one tick stay together.  More than ``most`` rows go to a file in the temp folder, in runs sorted by tick and
    cut into pieces; each piece is read once, so that beside a slice only a piece of each run is held.  ``nested`` columns
    have values that are not plain.
    """
    held: list[pd.DataFrame] = []
    size = 0
    with tempfile.TemporaryFile(prefix="beckon-slices-") as file:
        schemas: list[pa.Schema] = []
        pieces: list[tuple[int, int, int, int]] = []  # first tick, place in the file, bytes, run
        seen: list[np.ndarray] = []

        def put_away() -> None:
            nonlocal size
            frame = pd.concat(held, ignore_index=True).sort_values(tick, kind="stable", ignore_index=True)
            frame = frame.assign(**{c: [pickle.dumps(x) for x in frame[c]] for c in nested})
            table = pa.Table.from_pandas(frame, preserve_index=False)
            seen.append(frame[tick].to_numpy()[::STEP].copy())
            for piece in table.to_batches(PIECE):
                data = piece.serialize()
                pieces.append((piece.column(tick)[0].as_py(), file.tell(), data.size, len(schemas)))
                file.write(data)
            schemas.append(table.schema)
            held.clear()
            size = 0

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > most:
                put_away()
        if not schemas:
            yield pd.concat(held, ignore_index=True), True
            return
        if held:
            put_away()
        cuts = np.unique(np.sort(np.concatenate(seen))[:: max(1, most // STEP)])
        pieces.sort(reverse=True)
        begun: dict[int, list[pa.RecordBatch]] = {}  # by run, what is read and not given out
        for k in range(len(cuts)):
            last = k + 1 == len(cuts)
            while pieces and (last or pieces[-1][0] < cuts[k + 1]):
                _, place, length, run = pieces.pop()
                file.seek(place)
                begun.setdefault(run, []).append(pa.ipc.read_record_batch(pa.py_buffer(file.read(length)), schemas[run]))
            parts = []
            for run in sorted(begun):
                table = pa.Table.from_batches(begun.pop(run))
                end = len(table) if last else int(np.searchsorted(table.column(tick).to_numpy(), cuts[k + 1]))
                if end:
                    parts.append(table.slice(0, end))
                if end < len(table):
                    begun[run] = table.slice(end).to_batches()
            frame = pa.concat_tables(parts, promote_options="permissive").to_pandas()
            del parts, table
            yield frame.assign(**{c: [pickle.loads(x) for x in frame[c]] for c in nested}), last


def fold_groups(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], fold: Fold, added: Sequence[T.StructField] = (), groups: int = GROUPS,
    prepare: Callable[[DataFrame], DataFrame] | None = None, reach: int | None = None, most: int = SLICE,
) -> DataFrame:
    """Run ``fold`` over a stream with a watermark on ``ts``; ``added`` columns follow those of ``df``.

    ``fold`` sees the key as column ``__key``.  Rows later than the watermark are dropped by Spark, rows without a time by
    ``untimed``'s condition.  The first column of ``order`` is the tick; a group's rows of a micro-batch come in slices of
    about ``most``, from low ticks to high ones, and only the last one ends state.  ``reach`` is for a state of seconds:
    what lies further back than that many waits aside, for late rows of other micro-batches.
    """
    src = df.filter(F.col(ts).isNotNull()).withColumn("__key", F.to_json(F.struct(*keys)))
    src = prepare(src) if prepare else src
    src = src.withColumn("__group", F.pmod(F.xxhash64("__key"), F.lit(groups)).cast("int"))
    schema = T.StructType([*src.schema.fields, *added])
    cols = schema.names
    tick = order[0]
    nested = [f.name for f in src.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs()
        held = unpacked(state.get[0]) if state.exists else None
        aside = []
        for rows, last in in_slices(batches, tick, most, nested):
            if reach is not None and held is not None:
                far = held["sec"] + reach < rows[tick].min()
                aside.append(held[far & ((held["sec"] + reach) * 1000 >= watermark)])
                held = held[~far] if not far.all() else None
            rows = rows.sort_values(["__key", *order], kind="stable", ignore_index=True)
            out, held, until = fold(held, rows, watermark if last else NONE)
            yield out[cols]
        if aside := [x for x in aside if len(x)]:
            held = pd.concat([*aside, held] if len(held) else aside, ignore_index=True)
            until = max(until, (int(held["sec"].max()) + reach) * 1000)
        if len(held):
            state.update((packed(held),))
            state.setTimeoutTimestamp(max(until, watermark + 1))
        elif state.exists:
            state.remove()

    out = src.groupBy("__group").applyInPandasWithState(run, schema, "packed binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.drop("__key", "__group")


class Segments:
    """Rows sorted by key and tick, with a seek for many keys at once."""

    def __init__(self, rows: pd.DataFrame, tick: str) -> None:
        self.code, names = pd.factorize(rows["__key"])
        self.names = np.asarray(names, dtype=object)
        self.tick = rows[tick].to_numpy(np.int64)
        self.first = np.searchsorted(self.code, np.arange(len(self.names)))
        self.after = np.append(self.first[1:], len(self.code))
        self.low = int(self.tick.min(initial=0)) if len(self.tick) else 0
        self.span = int(self.tick.max(initial=self.low)) - self.low + 2
        self.place = self.code * self.span + (self.tick - self.low)

    def seek(self, keys: np.ndarray, tick: np.ndarray) -> np.ndarray:
        """First row of each key at or after the tick; the key's end where there is none."""
        return np.searchsorted(self.place, keys * self.span + np.clip(tick - self.low, 0, self.span - 1))

    def held(self, state: pd.DataFrame | None, column: str, none: int) -> np.ndarray:
        if state is None:
            return np.full(len(self.names), none, np.int64)
        at = pd.Index(state["key"]).get_indexer(self.names)
        return np.where(at >= 0, state[column].to_numpy(np.int64)[at], none)


def _kept(state: pd.DataFrame | None, touched: np.ndarray, fresh: pd.DataFrame, alive: Callable[[pd.DataFrame], pd.Series]) -> pd.DataFrame:
    """The state with ``fresh`` rows of the touched keys, without rows that nothing can need."""
    if state is not None:
        fresh = pd.concat([state[~state["key"].isin(touched)], fresh], ignore_index=True)
    return fresh[alive(fresh)].reset_index(drop=True)


def first_per_window(tick: str, window: int, hold: int, tick_ms: int) -> Fold:
    """Passes a row unless its key's last passed row is less than ``window`` ticks old."""

    def fold(state, rows, watermark):
        s = Segments(rows, tick)
        last = s.held(state, "at", NONE)
        live = np.arange(len(s.names))
        keep = np.zeros(len(rows), dtype=bool)
        at = np.where(last == NONE, s.first, s.seek(live, np.where(last == NONE, 0, last) + window))
        while len(live):  # one round for each row that the busiest key lets pass
            some = at < s.after[live]
            live, at = live[some], at[some]
            keep[at] = True
            last[live] = s.tick[at]
            at = s.seek(live, last[live] + window)
        held = _kept(state, s.names, pd.DataFrame({"key": s.names, "at": last}), lambda t: t["at"] * tick_ms + hold > watermark)
        return rows[keep], held, int(held["at"].max()) * tick_ms + hold if len(held) else 0

    return fold


def first_in_window(tick: str, window: int, most: int, permits: str | None) -> Fold:
    """Fixed windows opened by their first row (ticks are ms): what fits into ``most`` passes."""

    def fold(state, rows, watermark):
        s = Segments(rows, tick)
        start, used = s.held(state, "at", NONE), s.held(state, "used", 0)
        keep = np.zeros(len(rows) + 1, np.int64)
        if permits is None:
            live, at = np.arange(len(s.names)), s.first.copy()
            while len(live):  # one round for each window of the busiest key
                fresh = (start[live] == NONE) | (s.tick[at] - start[live] >= window)
                start[live] = np.where(fresh, s.tick[at], start[live])
                used[live] = np.where(fresh, 0, used[live])
                stop = s.seek(live, start[live] + window)
                fits = np.minimum(stop - at, most - used[live])
                np.add.at(keep, at, 1)
                np.add.at(keep, at + fits, -1)
                used[live] += fits
                some = stop < s.after[live]
                live, at = live[some], stop[some]
            passed = np.cumsum(keep[:-1]) > 0
        else:
            wanted = rows[permits].fillna(1).to_numpy(np.int64)
            passed = np.zeros(len(rows), dtype=bool)
            live, at = np.arange(len(s.names)), s.first.copy()
            while len(live):  # one round for each row of the busiest key
                n, now = wanted[at], s.tick[at]
                fresh = (n >= 0) & ((start[live] == NONE) | (now - start[live] >= window))
                start[live] = np.where(fresh, now, start[live])
                used[live] = np.where(fresh, 0, used[live])
                fits = (n >= 0) & (used[live] + n <= most)
                used[live] += np.where(fits, n, 0)
                passed[at] = fits
                some = at + 1 < s.after[live]
                live, at = live[some], at[some] + 1
        fresh = pd.DataFrame({"key": s.names, "at": start, "used": used})
        held = _kept(state, s.names, fresh, lambda t: (t["at"] != NONE) & (t["at"] + window > watermark))
        return rows[passed], held, int(held["at"].max()) + window if len(held) else 0

    return fold


MICRO = 10**12  # an amount is high * 10^6 + low / 10^6


def trailing_seconds(window: int) -> Fold:
    """Adds count and exact sum over the ``window`` seconds up to and with each row's own, from a ring of seconds per key."""

    def whole(table: pd.DataFrame) -> np.ndarray:
        return table["high"].to_numpy(object) * MICRO + table["low"].to_numpy(object)

    def fold(state, rows, watermark):
        new = rows[["__key", "__sec", "__high", "__low"]].set_axis(["key", "sec", "high", "low"], axis=1).assign(n=1)
        table = new if state is None else pd.concat([state, new], ignore_index=True)
        # sums of whole numbers of any size stay exact
        codes, names = pd.factorize(table["key"])
        sec = table["sec"].to_numpy(np.int64)
        low, span = int(sec.min()), int(sec.max()) - int(sec.min()) + 2
        place = codes * span + (sec - low)
        order = np.argsort(place, kind="stable")
        spot, first = np.unique(place[order], return_index=True)
        n = np.add.reduceat(table["n"].to_numpy(np.int64)[order], first)
        total = np.add.reduceat(whole(table)[order], first)
        count, amount = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(total)))
        own = place[len(table) - len(rows) :]
        end = np.searchsorted(spot, own, side="right")
        own_sec = own % span
        begin = np.searchsorted(spot, own - np.minimum(own_sec, window))
        sums = amount[end] - amount[begin]
        out = rows.assign(window_count=count[end] - count[begin], window_amount=[x / 10**6 for x in sums])
        held = pd.DataFrame({"key": np.asarray(names, dtype=object)[spot // span], "sec": spot % span + low, "n": n, "high": [x // MICRO for x in total], "low": [x % MICRO for x in total]})
        held = held[(held["sec"] + window) * 1000 >= watermark].reset_index(drop=True)
        return out, held, (int(held["sec"].max()) + window) * 1000 if len(held) else 0

    return fold
