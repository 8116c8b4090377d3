"""Packing (6): deficit round-robin over source queues, in closed form.

Every source is a queue of tokens with an integer weight.  A window of ``size`` tokens is filled in
turns: in each turn a queue's deficit grows by its weight, and the queue served is the one whose next
token has the smallest virtual time ``(2 p + 1) / weight`` (p: its position in the queue; ties go to the
earlier queue).  Weights are rounded to as fine a unit as 64-bit products allow: about ``2**61`` over the
tokens of the largest queue, 2**40 at most and 2**16 at least.  So after any window a queue is less than one token off its share; what is left over is
carried into the next window, and when a queue runs dry the others go on in their proportions.

The turn in which a token is served is a count that integer arithmetic gives directly, so any task
computes the cuts of its own documents from the queues' totals and from where its tokens start in their
queues; deficits cross partitions without a sequential pass.  Token ids are made once, stored, and never
shuffled: only the counts by (queue, partition) are.

Edge cases: a null or empty text is its end id alone; a null source joins the queue of empty name;
repeated rows are packed each; an empty table gives no rows; other columns are ignored.  At most
``MAX_QUEUES`` queues: the driver and every task hold one row of totals for each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beckon.llm.common import Batches, materialize, slices, tidy, utf8
from beckon.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
MAX_QUEUES = 10_000
STRETCH = 512  # windows planned at once
_FINEST, _COARSEST = 1 << 40, 1 << 16  # the largest weight; the coarsest serves 3e13 tokens a queue


class Schedule:
    """Where the tokens of weighted queues go."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, size: int = WINDOW) -> None:
        self.totals, self.size = totals.astype(np.int64), size
        # as fine as products of a position and a weight stay below 2**63
        scale = min(_FINEST, max(_COARSEST, (1 << 62) // (2 * int(self.totals.max(initial=0)) + 2)))
        self.weights = np.maximum(1, np.round(weights / max(weights.max(), 1e-300) * scale)).astype(np.int64)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rank(self, queue: int, at: np.ndarray) -> np.ndarray:
        """Tokens of all queues served before token ``at`` of ``queue``."""
        own = self.weights[queue]
        out = np.zeros(len(at), dtype=np.int64)
        for other, (weight, total) in enumerate(zip(self.weights, self.totals, strict=True)):
            if other == queue:
                out += at
                continue
            before = ((2 * at + 1) * weight + own - (other > queue)) // (2 * own)
            out += np.clip(before, 0, total)
        return out

    def served(self, queue: int, windows: np.ndarray) -> np.ndarray:
        """Tokens of ``queue`` in the first ``windows`` windows."""
        goal = windows.astype(np.int64) * self.size
        total, slack = int(self.totals[queue]), len(self.totals) + 2
        # while no queue has run dry, a queue is within a few tokens of its share
        share = (goal * (self.weights[queue] / self.weights.sum())).astype(np.int64)
        low, high = np.clip(share - slack, 0, total), np.clip(share + slack, 0, total)
        low = np.where((low > 0) & (self.rank(queue, low - 1) >= goal), 0, low)
        high = np.where((high < total) & (self.rank(queue, high) < goal), total, high)
        while (low < high).any():
            mid = (low + high) // 2
            late = self.rank(queue, mid) >= goal
            high = np.where(late, mid, high)
            low = np.where(late, low, np.minimum(mid + 1, high))
        return low

    def stretch(self, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """For ``STRETCH`` windows on: ``served`` by queue at each bound, and where each queue starts in a window."""
        if chunk not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            windows = np.arange(chunk * STRETCH, (chunk + 1) * STRETCH + 1)
            served = np.stack([self.served(q, windows) for q in range(len(self.totals))])
            parts = np.diff(served, axis=1)
            self.known[chunk] = served, np.cumsum(parts, axis=0) - parts
        return self.known[chunk]

    def cut(self, queue: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the consecutive documents ``[start, end)`` of a queue: document, start, end, window, offset."""
        first, last = (int(self.rank(queue, np.array([p]))[0]) // self.size // STRETCH for p in (starts[0], ends[-1] - 1))
        chunks = [self.stretch(c) for c in range(first, last + 1)]
        served = np.concatenate([s[queue][:-1] for s, _ in chunks] + [chunks[-1][0][queue][-1:]])
        before = np.concatenate([b[queue] for _, b in chunks])
        edges = np.unique(np.concatenate([starts, served[(served > starts[0]) & (served < ends[-1])]]))
        stops = np.append(edges[1:], ends[-1])
        doc = np.searchsorted(starts, edges, side="right") - 1
        window = np.searchsorted(served, edges, side="right") - 1
        return doc, edges, stops, window + first * STRETCH, before[window] + edges - served[window]


def token_rows(docs: DataFrame, tokenizer: str, key: str, text: str, queue: str) -> DataFrame:
    """(key, queue, n, ids, part, local): every document's ids, and the tokens before it in its partition's queue."""

    def encode(batches: Batches) -> Batches:
        part, seen = TaskContext.get().partitionId(), {}
        for whole in batches:
            for b in slices(whole, "text"):
                tok = encoder(tokenizer)
                small = "<u2" if tok.vocabulary <= 1 << 16 else "<u4"
                ids, counts, local = [], [], []
                end = np.array([END_ID], "<u4").tobytes()
                for name, raw in zip(b.column("queue").to_pylist(), tok.ids([x.decode() for x in utf8(b.column("text"))]), strict=True):
                    raw += end
                    counts.append(len(raw) // 4)
                    local.append(seen.get(name, 0))
                    seen[name] = local[-1] + counts[-1]
                    ids.append(np.frombuffer(raw, "<u4").astype(small).tobytes())
                cols = [b.column("key"), b.column("queue"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "queue", "n", "ids", "part", "local"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(queue).cast("string"), F.lit("")).alias("queue"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(tidy(encode), f"key {kind}, queue string, n long, ids binary, part int, local long")


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", queue: str = "source", size: int = WINDOW) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``targets`` gives queues' shares of every window; a queue without one has its share of all tokens,
    so without targets all queues last to the end and only the last window can need padding.
    """
    rows = materialize(token_rows(docs, tokenizer, key, text, queue), "tokens")
    counts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "queue-starts")
    sums = counts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").limit(MAX_QUEUES + 1).collect()
    if len(sums) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} queues; pass a coarser queue column")
    names = {r["queue"]: k for k, r in enumerate(sums)}
    totals = np.array([r["n"] for r in sums], dtype=np.int64)
    shares = totals / max(1, totals.sum())
    weights = np.array([(targets or {}).get(r["queue"], shares[k]) for k, r in enumerate(sums)], dtype=float)
    if len(weights) and weights.min() <= 0:
        raise ValueError("target proportions must be positive")
    plan = docs.sparkSession.sparkContext.broadcast((names, totals, weights))

    def place(batches: Batches) -> Batches:
        names, totals, weights = plan.value
        schedule = Schedule(totals, weights, size) if names else None
        for whole in batches:
            for b in slices(whole, "ids", 8 << 20):
                queues = np.array([names[q] for q in b.column("queue").to_pylist()])
                n = b.column("n").to_numpy(zero_copy_only=False)
                at = b.column("first").to_numpy(zero_copy_only=False) + b.column("local").to_numpy(zero_copy_only=False)
                raw = b.column("ids").to_pylist()
                small = "<u2" if sum(map(len, raw)) == 2 * n.sum() else "<u4"
                for q in np.unique(queues):
                    own = np.flatnonzero(queues == q)
                    own = own[np.argsort(at[own], kind="stable")]
                    for run in np.split(own, np.flatnonzero(at[own][1:] != at[own][:-1] + n[own][:-1]) + 1):
                        doc, first, stop, window, offset = schedule.cut(q, at[run], at[run] + n[run])
                        ids = memoryview(np.frombuffer(b"".join(raw[k] for k in run), small).astype("<u4").tobytes())
                        base = at[run[0]]
                        crc = [zlib.crc32(ids[4 * (x - base) : 4 * (y - base)]) for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
                        rows = run[doc]
                        cols = [b.column("key").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (first - at[rows], stop - first, crc, n[rows], window, offset)), b.column("queue").take(pa.array(rows))]
                        yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.join(starts, ["queue", "part"]).mapInArrow(tidy(place), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
    return placed.withColumnRenamed("key", key)
