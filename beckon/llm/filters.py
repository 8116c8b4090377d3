"""Filter interaction audit (13): what five filters remove in every order, with exact duplicates by radix text tries.

Filters on a whole text: A too few words, B too few distinct words, C too many capitals, D symbols, E equal to the text
of a smaller id anywhere in the table.  A document's failures are a mask of five bits, and everything about the 120
orders follows from counts of masks per part: a filter removes a mask in an order if it is the first of its bits.

Equal texts: rows are cut into packs of about ``PACK_BYTES``, and within a pack only the least id of a text travels on;
its other copies are duplicates already and go without their text.  The rest is dealt to ranges of texts whose bounds
are adaptive prefixes: a sample of texts in proportion to their bytes is ordered, and a bound is the shortest prefix
that tells a sampled text from the one before it, so ranges hold about ``RANGE_BYTES`` however much texts share their
beginnings.  Rows of a range arrive by ascending id and are inserted into a compressed trie whose terminals hold the
least id; one that ends at a terminal of a smaller id is a duplicate.  A task holds the trie of one range, that is its
distinct texts, and one row; copies stream past.

Bounds: the sample has ``SAMPLES`` texts for each range by expectation, ordered on the cluster; the driver sees and
broadcasts the bounds alone, each of at most ``BOUND_BYTES`` and the shortest of them up to ``BOUNDS_BYTES`` in all.
Texts that agree for longer share a range, which changes cost only.

Edge cases: a null text is empty (fails A, equals other empty texts); a null id is never smaller nor a duplicate; rows
of one id and one text are duplicates only of smaller ids; a null part is the empty string; a document with several
labels has one if any row says so, without labels none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import Batches, materialize, slices, utf8

# The filters' limits.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
PACK_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
SAMPLES = 16
MOST_RANGES = 1 << 20
MOST_PARTITIONS = 1 << 15
BOUND_BYTES = 1 << 16
BOUNDS_BYTES = 64 << 20
DUPLICATE = 1 << LETTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    mask = 1 if len(words) < MIN_WORDS else 0
    if 100 * len(set(words)) < DISTINCT_PERCENT * len(words):
        mask |= 2
    if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITAL_PERCENT * points:
        mask |= 4
    if len(text.translate(None, _SYMBOLS)) < len(text):
        mask |= 8
    return mask


class RadixTrie:
    """Compressed trie of byte strings: an edge holds all bytes up to the next branch, a terminal the least id."""

    def __init__(self) -> None:
        self.root: list = [None, {}]  # id at this node, edges by first byte: [label, node]

    def insert(self, text: bytes, least):
        """The id at the text's terminal; ``least`` is put there if the text is new."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[1].get(text[at])
            if edge is None:
                node[1][text[at]] = [text[at:], [least, {}]]
                return least
            label = edge[0]
            if not text.startswith(label, at):
                same = shared(label, text[at : at + len(label)])
                middle: list = [None, {label[same]: [label[same:], edge[1]]}]
                edge[0], edge[1] = label[:same], middle
                node, at = middle, at + same
                continue
            node, at = edge[1], at + len(label)
        if node[0] is None:
            node[0] = least
        return node[0]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def range_bounds(docs: DataFrame, text: str, total: int) -> list[bytes]:
    """Ascending prefixes that cut the texts into ranges of about ``RANGE_BYTES``."""
    ranges = min(MOST_RANGES, total // RANGE_BYTES)
    if ranges < 2:
        return []
    wanted = ranges * SAMPLES
    # a text is drawn by its hash, so that copies are one sample and a lost task draws the same
    size = F.octet_length("text") + 1
    draw = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor(size * (wanted / total) + draw)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).filter(times >= 1)
    sample = materialize(rows.select(F.substring(F.encode("text", "UTF-8"), 1, BOUND_BYTES).alias("head"), F.least(times, F.lit(wanted)).alias("times")).groupBy("head").agg(F.max("times").alias("times")), "text-sample")
    drawn = sample.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    share = max(1, -(-drawn // ranges))

    def cut(batches: Batches) -> Batches:
        """Of one task's ascending heads: the shortest prefix that parts every ``share`` of them from the one before."""
        before, count = None, 0
        for b in batches:
            out = []
            for head, n in zip(b.column("head").to_pylist(), b.column("times").to_pylist(), strict=True):
                count += n
                if before is not None and count >= share:
                    out.append(head[: shared(before, head) + 1])
                    count = 0
                before = head
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["bound"])

    parts = max(1, ranges // 64)
    ordered = sample.repartitionByRange(parts, "head").sortWithinPartitions("head")
    found = materialize(ordered.mapInArrow(cut, "bound binary").distinct(), "text-bounds")
    longest, room = 0, BOUNDS_BYTES
    for size, n in sorted(tuple(r) for r in found.groupBy(F.octet_length("bound")).count().collect()):  # a row for each length
        room -= size * n
        longest = size if room >= 0 else longest
    return sorted(found.filter(F.octet_length("bound") <= longest).toArrow().column("bound").to_pylist())


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of every row: bits 0 to 4 are the failed filters A to E."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    bounds = spark.sparkContext.broadcast(range_bounds(docs, text, total))
    ranges = len(bounds.value) + 1
    kind = rows.schema["id"].dataType.simpleString()

    def judge(batches: Batches) -> Batches:
        """Masks of A to D, and by pack which rows have a smaller id of the same text beside them."""
        ids: list = []
        parts: list = []
        masks: list = []
        texts: list = []
        pending = 0

        def flush() -> pa.RecordBatch:
            least: dict = {}
            for i, t in zip(ids, texts, strict=True):
                if i is not None and (t not in least or i < least[t]):
                    least[t] = i
            where, sent, found = [], [], []
            for k, (i, t, m) in enumerate(zip(ids, texts, masks, strict=True)):
                done = i is None or least[t] < i
                found.append(m | DUPLICATE if done and i is not None else m)
                # rows that are done go anywhere, without their text
                where.append(k % ranges if done else bisect_right(bounds.value, t))
                sent.append(None if done else t)
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(ids, id_type), pa.array(parts, pa.string()), pa.array(found, pa.int32()), pa.array(sent, pa.binary())], names=["range", "id", "part", "mask", "text"])

        id_type = None
        for whole in batches:
            id_type = whole.column("id").type
            for b in slices(whole, "text", 4 << 20):
                own = utf8(b.column("text"))
                points = pc.utf8_length(b.column("text")).to_pylist()
                ids += b.column("id").to_pylist()
                parts += b.column("part").to_pylist()
                masks += map(text_mask, own, points)
                texts += own
                pending += sum(map(len, own)) + 64 * len(own)
                if pending >= PACK_BYTES:
                    yield flush()
                    ids, parts, masks, texts, pending = [], [], [], [], 0
        if ids:
            yield flush()

    def mark(batches: Batches) -> Batches:
        """Rows by range and ascending id past the range's trie."""
        at, trie = None, RadixTrie()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                out = []
                for r, i, m, t in zip(*(b.column(c).to_pylist() for c in ("range", "id", "mask", "text")), strict=True):
                    if r != at:
                        at, trie = r, RadixTrie()
                    out.append(m if t is None or trie.insert(t, i) == i else m | DUPLICATE)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array(out, pa.int32())], names=["id", "part", "mask"])

    judged = rows.mapInArrow(judge, f"range int, id {kind}, part string, mask int, text binary")
    dealt = judged.repartition(min(ranges, MOST_PARTITIONS), "range").sortWithinPartitions("range", "id")
    return dealt.mapInArrow(mark, f"id {kind}, part string, mask int")


def order_table() -> tuple[list[str], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every order and step: names, numbers, and 0/1 rows over the 32 masks (kept, removed, redundant, unique)."""
    masks = np.arange(1 << len(LETTERS))
    names, steps, rows = [], [], []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            fails = masks & bit > 0
            earlier = masks & before > 0
            rows.append((masks & (before | bit) == 0, fails & ~earlier, fails & earlier, masks == bit))
            names.append("".join(LETTERS[k] for k in order))
            steps.append(step)
            before |= bit
    return names, steps, *(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the five filters and step, see ``COUNTS``."""
    failed = failures(docs, key, text, part)
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    known = known.agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    marked = failed.join(known, "id", "left")
    some = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    counts = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), some("good"), some("toxic"))

    def orders(table: pa.Table) -> pa.Table:
        """At most 32 rows come in for a part; one goes out for each order and step."""
        names, steps, kept, removed, redundant, unique = order_table()
        n, good, toxic_ = (np.zeros(1 << len(LETTERS), np.int64) for _ in range(3))
        for own, column in ((n, "n"), (good, "good"), (toxic_, "toxic")):
            own[table.column("mask").to_numpy()] = table.column(column).to_numpy()
        taken = removed @ n
        letter = np.array([LETTERS.index(o[s - 1]) for o, s in zip(names, steps, strict=True)])
        value = np.bincount(letter, weights=taken, minlength=len(LETTERS)).astype(np.int64)
        columns = [kept @ n, taken, redundant @ n, unique @ n, removed @ good, removed @ toxic_, value[letter]]
        own = [pa.array([table.column("part")[0].as_py()] * len(names), pa.string()), pa.array(names), pa.array(steps, pa.int32())]
        return pa.Table.from_arrays([*own, *map(pa.array, columns)], names=["part", "filter_order", "step", *COUNTS])

    return counts.groupBy("part").applyInArrow(orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
