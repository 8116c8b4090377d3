"""LM scoring (9): Katz backoff over words.

A model of ``order`` words (two by default) over words and one end per text, with a begin mark as first history; a
text's first tokens have the shorter histories there are.  Counts of one to five are discounted by Good-Turing at each
order; n-grams seen fewer than ``MIN_COUNT`` times would be left to the backoff, and at one none is.  The backoff weight
of a history is what its n-grams leave over, divided by what their words leave over of the distribution of the next
lower order, so every conditional distribution sums to one.  Unigrams are discounted likewise; their left-over mass is
the probability of a word that training never saw.

The model lives in tables partitioned by a hash of the n-gram.  Tokens travel as packed arrays: documents are
tokenised once into batches of about ``BATCH_TOKENS`` tokens over a local dictionary, stored bucketed by batch.
Each round sends every batch's distinct n-grams, sorted, to the partitions of the table; a partition adds up the
counts of the training texts and answers in the order asked.  One round for the words and two for each higher order
(counts, backoff weights) give a batch all it needs to evaluate its tokens; the batches themselves are never shuffled.
The weight of an n-gram history that only one batch has is worked out there and not asked for; of the others, a batch
is told the weight where one of its n-grams backs off, and else only by how much the denominator differs.
Frequent words are one entry per batch, so none is a hot key, and a partition's size is fixed by their number, which
grows with the data.

Words and the n-grams of a batch are known by 64-bit hashes, n-grams inside a partition by 40 bits more than those that
choose it.

Edge cases: a null or empty text is its end alone; repeated rows train and are scored each; without training text
the unknown word has probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import Batches, materialize, mix64, scratch_dir, slices, utf8, word_hashes

BATCH_TOKENS = 1 << 20
PART_BYTES = 16 << 20
MIN_COUNT = 1
ORDER = 2
DISCOUNTED = 5
BEGIN, END = mix64(np.array([101, 102], dtype=np.uint64))
_MANY = 63  # larger counts are written apart
_SHARED = 64
_OWNER = 128
_STATS = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
ANSWER = "kind string, batch long, part int, data binary, total double, types double, " + ", ".join(f"{s} double" for s in _STATS)


def discounts(of: list[float], least: int) -> np.ndarray:
    """Good-Turing factors ``d[r]`` for counts up to ``DISCOUNTED`` (index ``DISCOUNTED + 1``: more), zero below ``least``.

    ``of[r - 1]`` types occur ``r`` times.  Where the counts of counts give no factor in (0, 1], it is one.
    """
    out = np.ones(DISCOUNTED + 2)
    out[0] = 0.0
    common = (DISCOUNTED + 1) * of[DISCOUNTED] / of[0] if of[0] else 0.0
    for r in range(1, DISCOUNTED + 1):
        if of[r - 1] and common < 1:
            factor = ((r + 1) * of[r] / (r * of[r - 1]) - common) / (1 - common)
            out[r] = factor if 0 < factor <= 1 else 1.0
    out[1:least] = 0.0
    return out


class Unigrams:
    """Discounted distribution over the training words and the unknown word."""

    def __init__(self, total: float, types: float, of: list[float]) -> None:
        self.total, self.types = total, types
        self.factor = discounts(of, 1)
        kept = total - sum((1 - self.factor[r]) * r * of[r - 1] for r in range(1, DISCOUNTED + 1))
        self.unknown = max(of[0], 0.5) / (total + 0.5) if total else 1.0
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        p = self.factor[np.minimum(counts, DISCOUNTED + 1)] * counts * self.scale
        return np.where(counts > 0, p, self.unknown)


def tokens_of(docs: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Batches: ids and lengths of documents, tokens by place in the batch's sorted distinct words, training counts."""

    def pack(batches: Batches) -> Batches:
        part, serial = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        arrays: list = []
        sizes: list = []
        helds: list = []
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal serial
            n = np.concatenate(sizes)
            marked = np.concatenate(arrays)
            tokens = np.insert(marked, np.cumsum(n), END) if len(n) else marked
            n = n + 1
            off = np.concatenate(helds)
            words, place = np.unique(np.concatenate([tokens, [BEGIN, END]]), return_inverse=True)
            place = place[:-2]
            counts = np.bincount(place, weights=np.repeat(~off, n), minlength=len(words)).astype(np.int64)
            counts[np.searchsorted(words, BEGIN)] = int((~off).sum())
            row = [pa.array([part + serial], pa.int64()), pa.array([ids], pa.list_(kind))]
            row += [pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.uint32), off.astype(np.uint8), place.astype(np.uint32), words, counts)]
            row += [pa.array([len(tokens)], pa.int64())]
            serial += 1
            return pa.RecordBatch.from_arrays(row, names=["batch", "ids", "sizes", "held", "tokens", "words", "counts", "n"])

        pending = 0
        for whole in batches:
            kind = whole.column("key").type
            for b in slices(whole, "text", 1 << 20):
                found, n = word_hashes(utf8(b.column("text")))
                ids += b.column("key").to_pylist()
                arrays.append(found)
                sizes.append(n)
                helds.append(np.array(b.column("held").to_pylist(), dtype=bool))
                pending += len(found) + len(n)
                if pending >= BATCH_TOKENS:
                    yield flush()
                    ids, arrays, sizes, helds, pending = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(pack, f"batch long, ids array<{kind}>, sizes binary, held binary, tokens binary, words binary, counts binary, n long")


def store(batches: DataFrame) -> DataFrame:
    """Write the batches bucketed, so that joins on the batch do not shuffle them."""
    spark = batches.sparkSession
    name = f"beckon_lm_{uuid.uuid4().hex}"
    buckets = max(16, batches.rdd.getNumPartitions())
    batches.write.option("compression", "zstd").option("path", f"{scratch_dir(spark)}/{name}").bucketBy(buckets, "batch").saveAsTable(name)
    return spark.table(name)


@dataclass
class Level:
    """A batch's distinct n-grams of one length, in the order of their hashes."""

    hashes: np.ndarray
    which: np.ndarray  # by token, -1 where the text has no such n-gram yet
    first: np.ndarray  # place of the history in the level below
    suffix: np.ndarray  # place of the n-gram without its first word in the level below


class Batch:
    """One stored batch with its n-grams."""

    def __init__(self, row: dict) -> None:
        read = lambda c, t: np.frombuffer(row[c], t)
        self.ids = row["ids"]
        self.sizes, self.held = read("sizes", np.uint32).astype(np.int64), read("held", np.uint8).astype(bool)
        self.tokens, self.words, self.counts = read("tokens", np.uint32).astype(np.int64), read("words", np.uint64), read("counts", np.int64)

    def levels(self, order: int) -> list[Level]:
        """Levels 1 to ``order``, from index 1 on."""
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.tokens)) - np.repeat(starts, self.sizes)
        none = np.zeros(0, np.int64)
        own = [Level(self.words, none, none, none), Level(self.words, self.tokens, none, none)]
        history = np.empty_like(self.tokens)
        for n in range(2, order + 1):
            low = own[-1]
            history[1:] = low.which[:-1]
            if n == 2:
                history[starts] = np.searchsorted(self.words, BEGIN)
            at = np.flatnonzero(place >= n - 2)
            # one sort of the occurrences by hash finds the distinct n-grams, one occurrence of each, and their order
            hashes = mix64(low.hashes[history[at]] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.tokens[at]])
            order_of = np.argsort(hashes)
            ranked = hashes[order_of]
            new = np.ones(len(ranked), dtype=bool)
            new[1:] = ranked[1:] != ranked[:-1]
            some = at[order_of[new]]
            by_token = np.full(len(self.tokens), -1)
            by_token[at[order_of]] = np.cumsum(new) - 1
            own.append(Level(ranked[new], by_token, history[some], low.which[some]))
        return own


def parts_for(bytes_total: float) -> int:
    """Bits of the partition number: partitions of about ``PART_BYTES``."""
    return max(4, int(np.ceil(np.log2(max(1.0, bytes_total / PART_BYTES)))))


def cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of each partition in sorted hashes."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(hashes, bounds), [len(hashes)]))


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def loosen(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """The first byte of each value, then the second of each, and so on: alike bytes stand together and compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def narrow(hashes: np.ndarray, bits: int) -> bytes:
    """Forty bits of each sorted hash after those that name the partition, as steps where these are short."""
    low = (hashes << np.uint64(bits)) >> np.uint64(24)
    steps = np.diff(low, prepend=np.uint64(0))
    wide = len(steps) > 0 and int(steps.max()) >= 1 << 32
    return b"8" + planes(steps) if wide else b"4" + planes(steps.astype(np.uint32))


def widen(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data[1:], np.uint64 if data[:1] == b"8" else np.uint32), dtype=np.uint64)


def pack_counts(counts: np.ndarray, owner: np.ndarray | None = None, shared: np.ndarray | None = None) -> bytes:
    """A byte for each count, with marks for owners and for what several batches have; counts from ``_MANY`` on follow in full."""
    code = np.minimum(counts, _MANY).astype(np.uint8)
    if owner is not None:
        code |= np.where(owner, _OWNER, 0).astype(np.uint8)
    if shared is not None:
        code |= np.where(shared, _SHARED, 0).astype(np.uint8)
    return np.array([len(counts)], np.uint32).tobytes() + code.tobytes() + counts[counts >= _MANY].astype(np.int64).tobytes()


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    code = np.frombuffer(data[4 : 4 + n], np.uint8)
    counts = (code & _MANY).astype(np.int64)
    counts[counts == _MANY] = np.frombuffer(data[4 + n :], np.int64)
    return counts, code >= _OWNER


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, owners, and what several batches have."""
    code = np.frombuffer(data[4 : 4 + int(np.frombuffer(data[:4], np.uint32)[0])], np.uint8)
    return *unpack_counts(data), (code & _SHARED) > 0


def pack_sums(counts: np.ndarray, mass: np.ndarray, lower: np.ndarray, need: np.ndarray) -> bytes:
    """Counts of all histories, a bit for each whose weight is needed, one for each that has sums, and these sums."""
    some, small = mass > 0, pack_counts(counts)
    bits = np.packbits(need).tobytes() + np.packbits(some).tobytes()
    return len(small).to_bytes(4, "little") + small + bits + mass[some].tobytes() + planes(lower[some])


def unpack_sums(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    counts, _ = unpack_counts(data[4:at])
    size = (len(counts) + 7) // 8
    need, some = (np.unpackbits(np.frombuffer(data[x : x + size], np.uint8), count=len(counts)).astype(bool) for x in (at, at + size))
    start, half = at + 2 * size, at + 2 * size + 8 * int(some.sum())
    mass, lower = np.zeros(len(counts)), np.zeros(len(counts))
    mass[some], lower[some] = np.frombuffer(data[start:half], np.float64), unplanes(data[half:], np.float64)
    return counts, mass, lower, need


def pack_weights(weight: np.ndarray, extra: np.ndarray) -> bytes:
    return (8 * len(weight)).to_bytes(4, "little") + planes(weight) + planes(extra)


def unpack_weights(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = 4 + int.from_bytes(data[:4], "little")
    return unplanes(data[4:half], np.float64), unplanes(data[half:], np.float64)


REQUEST = "part int, batch long, keys binary, data binary"
_REQUEST = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])
_ANSWER = pa.schema([("kind", pa.string()), ("batch", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("total", pa.float64()), ("types", pa.float64()), *((s, pa.float64()) for s in _STATS)])


def requests(batch: int, hashes: np.ndarray, keys, data: list[np.ndarray], pack, bits: int) -> pa.RecordBatch:
    """One row for each partition: the keys it has of the batch, sorted, and what goes with them."""
    bounds = cut(hashes, bits)
    rows = [(p, batch, squeeze(keys(hashes[a:b])), squeeze(pack(*(d[a:b] for d in data)))) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=_REQUEST)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _REQUEST, strict=True)], schema=_REQUEST)


def answers(kind: str, table: pa.Table, sizes: list[int], parts: list[bytes], stats: tuple | None) -> pa.Table:
    rows = len(sizes)
    tail = [(None,) * rows] * (2 + len(_STATS))
    out = pa.Table.from_arrays([pa.array([kind] * rows, pa.string()), table.column("batch").combine_chunks(), table.column("part").combine_chunks(), pa.array([squeeze(x) for x in parts], pa.binary()), *(pa.array(t, pa.float64()) for t in tail)], schema=_ANSWER)
    if stats is None:
        return out
    own = pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((kind + "-stats", -1, None, None, *stats), _ANSWER, strict=True)], schema=_ANSWER)
    return pa.concat_tables([out, own])


def of_counts(counts: np.ndarray) -> list[float]:
    return [float((counts == r).sum()) for r in range(1, DISCOUNTED + 2)]


def column(table: pa.Table, name: str) -> list[bytes]:
    return [loosen(x) for x in table.column(name).to_pylist()]


def grouped(keys: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lengths, the distinct keys, and the place of each key among them."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], distinct, place


def split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def count_words(table: pa.Table) -> pa.Table:
    sizes, words, place = grouped([np.frombuffer(k, np.uint64) for k in column(table, "keys")])
    given = np.concatenate([unpack_counts(d)[0] for d in column(table, "data")])
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, place, given)
    real = counts[(words != BEGIN) & (counts > 0)]
    return answers("words", table, sizes, [pack_counts(c) for c in split(counts[place], sizes)], (float(real.sum()), float(len(real)), *of_counts(real)))


def count_grams(table: pa.Table, kind: str) -> pa.Table:
    sizes, keys, place = grouped([widen(k) for k in column(table, "keys")])
    given = np.concatenate([unpack_counts(d)[0] for d in column(table, "data")])
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, given)
    first = np.empty(len(keys), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    owner = np.zeros(len(place), dtype=bool)
    owner[first] = True  # the batch that adds this n-gram to its history's sums
    shared = (np.bincount(place, minlength=len(keys)) > 1)[place]
    real = counts[counts > 0]
    parts = [pack_counts(*x) for x in zip(split(counts[place], sizes), split(owner, sizes), split(shared, sizes), strict=True)]
    return answers(kind, table, sizes, parts, (float(real.sum()), float(len(real)), *of_counts(real)))


def weigh(count: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Backoff weight of each history, and by how much its denominator exceeds its count."""
    whole = np.where(count > 0, np.maximum(count, mass + 0.5), 1.0)
    weight = np.where(count > 0, (1 - mass / whole) / (1 - lower), 1.0)
    return np.stack([weight, whole - np.maximum(count, 1.0)])


def back_off(table: pa.Table, kind: str, keys) -> pa.Table:
    sizes, histories, place = grouped([keys(k) for k in column(table, "keys")])
    data = [unpack_sums(d) for d in column(table, "data")]
    count, mass, lower = (np.zeros(len(histories)) for _ in range(3))
    count[place] = np.concatenate([d[0] for d in data])
    np.add.at(mass, place, np.concatenate([d[1] for d in data]))
    np.add.at(lower, place, np.concatenate([d[2] for d in data]))
    weight, extra = weigh(count, mass, lower)
    parts = [pack_weights(w[d[3]], m) for d, w, m in zip(data, split(weight[place], sizes), split(extra[place], sizes), strict=True)]
    return answers(kind, table, sizes, parts, None)


def collected(table: pa.Table, kind: str, read, none: bytes = b"") -> list[np.ndarray]:
    """The answers of a kind, in the order of the partitions; those of ``none`` where nothing was asked."""
    own = table.filter(pc.equal(table.column("kind"), kind)).select(["part", "data"]).sort_by("part")
    return [np.concatenate(x) for x in zip(*(read(d) for d in column(own, "data") or [none]), strict=True)]


def stats(answer: DataFrame, kind: str) -> tuple[float, float, list[float]]:
    row = answer.filter(F.col("kind") == kind + "-stats").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("total", "types", *_STATS)]).first()
    return row[0], row[1], list(row[2:])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: str = "held_out", order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows with ``held`` do not train.

    ``base_score`` is the additively smoothed unigram score, ``score`` the log10 probability of the Katz model of ``order``.
    """
    if order < 1:
        raise ValueError("the order must be one or more")
    kind = docs.schema[key].dataType.simpleString()
    batches = store(tokens_of(docs, key, text, held))
    tokens = batches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    word_bits, gram_bits = parts_for(2.0 * tokens), parts_for(6.0 * tokens)

    def ask_words(rows: Batches) -> Batches:
        for b in rows:
            for r in b.to_pylist():
                words = np.frombuffer(r["words"], np.uint64)
                yield requests(r["batch"], words, np.ndarray.tobytes, [np.frombuffer(r["counts"], np.int64)], pack_counts, word_bits)

    def asked(rows: DataFrame, fn, answer, label: str) -> DataFrame:
        return materialize(rows.mapInArrow(fn, REQUEST).groupBy("part").applyInArrow(answer, ANSWER), label)

    def grams(n: int) -> DataFrame:
        def ask(rows: Batches) -> Batches:
            for b in rows:
                for r in b.to_pylist():
                    batch = Batch(r | {"ids": []})
                    own = batch.levels(n)[n]
                    there = own.which >= 0
                    train = np.repeat(~batch.held, batch.sizes)[there]
                    counts = np.bincount(own.which[there], weights=train, minlength=len(own.hashes)).astype(np.int64)
                    yield requests(r["batch"], own.hashes, lambda h: narrow(h, gram_bits), [counts], pack_counts, gram_bits)

        def answer(table: pa.Table) -> pa.Table:
            return count_grams(table, f"grams{n}")

        return asked(batches.drop("ids", "n"), ask, answer, f"lm-grams{n}")

    words = asked(batches.select("batch", "words", "counts"), ask_words, count_words, "lm-words")
    total, types, of = stats(words, "words")
    unigrams = Unigrams(total, types, of)
    answers_of, factor = words.filter("batch >= 0"), {}

    def counted(own: list[Level], right: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of level ``n``, what of them its histories give directly, owners, and what several batches have."""
        if n == 1:
            counts = collected(right, "words", unpack_counts)[0]
            return counts, unigrams.probability(counts), np.ones(len(counts), dtype=bool), np.ones(len(counts), dtype=bool)
        counts, owner, shared = collected(right, f"grams{n}", unpack_grams, pack_counts(np.zeros(0, np.int64)))
        return counts, np.where(counts >= MIN_COUNT, factor[n][np.minimum(counts, DISCOUNTED + 1)] * counts, 0.0), owner, shared

    def sums(own: list[Level], n: int, kept: np.ndarray, owner: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By history: what its n-grams that this batch owns take, and what their words have at the order below."""
        level, mine = own[n], owner & (kept > 0)
        add = lambda x: np.bincount(level.first[mine], weights=x[mine], minlength=len(own[n - 1].hashes))
        return add(kept), add(lower[level.suffix])

    def wanted(own: list[Level], n: int, shared: np.ndarray) -> np.ndarray:
        """Histories of level ``n`` whose weight the batch asks for."""
        some = np.zeros(len(shared), dtype=bool)
        some[own[n].first] = True
        return np.flatnonzero(some & shared)

    def lacking(own: list[Level], n: int, kept: np.ndarray) -> np.ndarray:
        """Which histories of level ``n`` have an n-gram that backs off: no other needs its weight."""
        some = np.zeros(len(own[n - 1].hashes), dtype=bool)
        some[own[n].first[kept == 0]] = True
        return some

    def probabilities(own: list[Level], right: pa.Table, top: int) -> tuple[list[np.ndarray], tuple]:
        """Probability of each n-gram's last word given its history, for levels 1 to ``top``; ``counted`` of the last."""
        last = counted(own, right, 1)
        out = [last[1], last[1]]
        for n in range(2, top + 1):
            counts, shared = last[0], last[3]
            last = counted(own, right, n)
            _, kept, owner, _ = last
            mass, lower = sums(own, n, kept, owner, out[-1])
            weight, extra = weigh(counts, mass, lower)
            ask = wanted(own, n, shared)
            needed = ask[lacking(own, n, kept)[ask]]
            weight[needed], extra[ask] = collected(right, f"weights{n}", unpack_weights, b"")
            whole = np.maximum(counts, 1) + extra
            out.append(np.where(kept > 0, kept / whole[own[n].first], weight[own[n].first] * out[-1][own[n].suffix]))
        return out, last

    def weights(n: int) -> DataFrame:
        bits = word_bits if n == 2 else gram_bits
        pack = np.ndarray.tobytes if n == 2 else lambda h: narrow(h, bits)
        unpack = (lambda k: np.frombuffer(k, np.uint64)) if n == 2 else widen

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            own = Batch(left.to_pylist()[0]).levels(n)
            below, (counts, _, _, shared) = probabilities(own, right, n - 1)
            _, kept, owner, _ = counted(own, right, n)
            mass, lower = sums(own, n, kept, owner, below[-1])
            want = wanted(own, n, shared)
            return pa.Table.from_batches([requests(left.column("batch")[0].as_py(), own[n - 1].hashes[want], pack, [counts[want], mass[want], lower[want], lacking(own, n, kept)[want]], pack_sums, bits)])

        def answer(table: pa.Table) -> pa.Table:
            return back_off(table, f"weights{n}", unpack)

        return batches.groupBy("batch").cogroup(answers_of.groupBy("batch")).applyInArrow(ask, REQUEST).groupBy("part").applyInArrow(answer, ANSWER)

    for n in range(2, order + 1):
        found = grams(n)
        factor[n] = discounts(stats(found, f"grams{n}")[2], MIN_COUNT)
        answers_of = answers_of.unionByName(found.filter("batch >= 0"))
        answers_of = answers_of.unionByName(materialize(weights(n), f"lm-weights{n}"))
    result = pa.schema([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.to_pylist()[0])
        own = batch.levels(order)
        counts = collected(right, "words", unpack_counts)[0]
        doc = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
        given = probabilities(own, right, order)[0]
        katz = given[1][batch.tokens]
        for level, p in zip(own[2:], given[2:], strict=True):
            there = level.which >= 0
            katz[there] = p[level.which[there]]
        begin = np.searchsorted(batch.words, BEGIN)
        base = np.log10((counts + 0.1) / (total + 0.1 * (types + 1)))
        n = len(batch.sizes)
        known_words = counts > 0
        known_words[begin] = False
        add = lambda x: np.bincount(doc, weights=x, minlength=n)
        cols = [pa.array(batch.held), pa.array(batch.sizes), pa.array(add(known_words[batch.tokens]).astype(np.int64)), pa.array(np.full(n, int(total))), pa.array(add(base[batch.tokens])), pa.array(add(np.log10(katz)))]
        return pa.Table.from_arrays([left.column("ids").combine_chunks().flatten(), *cols], names=["key", *result.names])

    out = batches.groupBy("batch").cogroup(answers_of.groupBy("batch")).applyInArrow(evaluate, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
