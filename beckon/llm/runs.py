"""Periodic run detection (12): block convolution by number-theoretic transforms.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and length of at
least ``max(min_words, 4 * q)`` that no neighbouring word extends.  Words are ``[^\\x20\\x09-\\x0D]+``.

At scale ``k`` periods from ``2^k`` to ``2^(k+1) - 1`` are sought.  Words are numbers; the text is cut into blocks of
``2^k`` words, one in two, and for each block the sum of squared differences to the following window is computed at all
these distances at once by exact integer convolution.  Zeros are the block's occurrences.  A run of that scale contains
a whole block and its copy one period on, since it has four periods, so no run is missed.  Every distance found
seeds an extension to both sides; stretches that are long enough are compared word by word before they count.  A
stretch whose smallest period is smaller was found at a lower scale with the same ends.  Blocks inside a known run
can only repeat it and are passed over.

Transforms are modulo the prime ``7 * 2^20 + 1``; sums of 64 products stay below ``2^53``, so matrix products of
doubles are exact, and longer transforms are built of steps of 64.  Sums are known modulo the prime: a zero is never
missed, and a false one does not survive the comparison of words.  Extension uses polynomial hashes of all prefixes; a
stretch whose words do not agree is extended word by word instead.

Documents are worked on together, about ``SLICE_BYTES`` at a time, with a number of its own between any two; a scale
looks only at documents that can hold one of its runs.  A task holds one such slice, or one longer text.

Edge cases: a null, empty or blank text has no words, no runs and an empty text; repeated rows and null keys are rows
like any other; an empty table gives no rows; all columns are kept, and ``runs``, ``best`` and ``collapsed`` replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from beckon.llm.common import Batches, mix64, slices, utf8

MIN_WORDS = 6
EXPONENT = 4
SLICE_BYTES = 4 << 20
PRIME = 7 * (1 << 20) + 1
RADIX = 64
AT_ONCE = 1 << 17  # numbers in one batch of transforms
LONGEST_BLOCK = 1 << 19  # half the longest transform that the prime has
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_FOLD = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNFOLD = np.uint64(pow(int(_FOLD), -1, 1 << 64))


def _generator() -> int:
    """Least number whose powers reach all residues."""
    g = 2
    while any(pow(g, (PRIME - 1) // f, PRIME) == 1 for f in (2, 7)):
        g += 1
    return g


def reduced(x: np.ndarray) -> np.ndarray:
    """Whole doubles up to ``2^53`` modulo the prime, in place; rounding may leave one or two beyond either end."""
    whole = x * (1.0 / PRIME)
    np.floor(whole, out=whole)
    whole *= PRIME
    x -= whole
    return x


def divisible(x: np.ndarray) -> np.ndarray:
    return x == np.rint(x * (1.0 / PRIME)) * PRIME


class Transform:
    """Number-theoretic transform of one length (a power of two) over the last axis, outputs in any fixed order."""

    _known: dict[int, Transform] = {}

    def __init__(self, size: int) -> None:
        self.size, self.head = size, min(size, RADIX)
        self.rest = size // self.head
        root = pow(_generator(), (PRIME - 1) // size, PRIME)
        own = self._powers(pow(root, self.rest, PRIME), self.head)
        exponent = np.outer(np.arange(self.head), np.arange(self.head)) % self.head
        self.matrix = own[exponent]  # values stay below the prime, so 64 products of two sum to less than 2^53
        self.inverse_matrix = own[-exponent % self.head] * pow(self.head, -1, PRIME) % PRIME
        if self.rest > 1:
            every = self._powers(root, size)
            turn = np.outer(np.arange(self.head), np.arange(self.rest)) % size
            self.twist, self.untwist = every[turn], every[-turn % size]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = [1]
        while len(out) < n:
            out.append(out[-1] * base % PRIME)
        return np.array(out, dtype=np.float64)

    @classmethod
    def of(cls, size: int) -> Transform:
        if size not in cls._known:
            cls._known[size] = cls(size)
        return cls._known[size]

    def forward(self, x: np.ndarray) -> np.ndarray:
        if self.rest == 1:
            return reduced(x @ self.matrix)
        y = reduced(np.matmul(self.matrix, x.reshape(-1, self.head, self.rest)))
        y = reduced(y * self.twist)
        return self.of(self.rest).forward(y.reshape(-1, self.rest)).reshape(len(x), self.size)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        if self.rest == 1:
            return reduced(x @ self.inverse_matrix)
        y = self.of(self.rest).inverse(x.reshape(-1, self.rest)).reshape(-1, self.head, self.rest)
        return reduced(np.matmul(self.inverse_matrix, reduced(y * self.untwist))).reshape(len(x), self.size)


def zero_mismatches(numbers: np.ndarray, blocks: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all occurrences of ``numbers[s : s + size]``, s in ``blocks``, ``least`` to ``least + size - 1`` on.

    ``numbers``, from zero to the prime, must reach ``least + 2 * size`` beyond the last block.
    """
    whole = Transform.of(2 * size)
    views = np.lib.stride_tricks.sliding_window_view(numbers, 2 * size)
    starts, distances = [], []
    step = max(1, AT_ONCE // (2 * size))
    for at in range(0, len(blocks), step):
        own = blocks[at : at + step]
        window = views[own + least]
        block = np.zeros((len(own), 2 * size))
        # correlation: the block turned round a cycle of twice its length
        inside = views[own, :size]
        block[:, 0] = inside[:, 0]
        block[:, size + 1 :] = inside[:, :0:-1]
        products = whole.inverse(reduced(whole.forward(block) * whole.forward(window)))[:, :size]
        square = reduced(window * window)
        sums = np.cumsum(square, axis=1)
        moving = sums[:, size - 1 : 2 * size - 1].copy()
        moving[:, 1:] -= sums[:, : size - 1]
        total = reduced(inside * inside).sum(axis=1, keepdims=True) + moving - 2 * products
        row, lag = np.nonzero(divisible(total))
        starts.append(own[row])
        distances.append(lag + least)
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


class Prefixes:
    """Hashes of all prefixes, for how far two places agree."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _FOLD))), dtype=np.uint64)
        self.unfold = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _UNFOLD))), dtype=np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(numbers.astype(np.uint64)) * powers[:n], dtype=np.uint64)))
        self.n = n

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        part = lambda s: (self.sums[s + size] - self.sums[s]) * self.unfold[s]
        return part(a) == part(b)

    def reach(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``a`` and ``b`` (``a < b``) on agree, or how many right before them."""
        low = np.zeros(len(a), np.int64)
        high = self.n - b if forward else a.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            shift = 0 if forward else half
            ok = self._same(a - shift, b - shift, half)
            low, high = np.where(ok, half, low), np.where(ok, high, half - 1)
        return low


def stretch(numbers: np.ndarray, start: int, distance: int, left: int, right: int) -> tuple[int, int]:
    """The ends of the stretch around ``start`` whose words agree ``distance`` on; ``left`` and ``right`` are tried first."""
    same = lambda a, b: np.array_equal(numbers[a : b - distance], numbers[a + distance : b])
    if same(left, right):
        return left, right
    left = start
    while left > 0 and numbers[left - 1] == numbers[left - 1 + distance]:
        left -= 1
    right = start + distance
    while right < len(numbers) and numbers[right] == numbers[right - distance]:
        right += 1
    return left, right


def find_runs(numbers: np.ndarray, first: np.ndarray, after: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, end, period) of all runs, in order; words ``first[d]`` to ``after[d] - 1`` are document ``d``.

    Between documents stand numbers that occur once, so that no run crosses.
    """
    n = len(numbers)
    found: dict[tuple[int, int], int] = {}
    longest = int((after - first).max(initial=0))
    prefixes = None
    size = 1
    while EXPONENT * size <= longest:
        # every other block; it and one period more lie in a document long enough for a run of this scale
        blocks = np.arange(0, n, 2 * size)
        own = np.searchsorted(first, blocks, side="right") - 1
        blocks = blocks[(after[own] - first[own] >= max(min_words, EXPONENT * size)) & (blocks + 2 * size <= after[own]) & (own >= 0)]
        if found and len(blocks):
            skip = np.zeros(n + 1, np.int64)
            ends = np.array(list(found), dtype=np.int64)
            ends = ends[ends[:, 1] - ends[:, 0] >= 3 * size]
            np.add.at(skip, ends[:, 0], 1)
            np.add.at(skip, ends[:, 1] - 3 * size + 1, -1)
            blocks = blocks[np.cumsum(skip)[blocks] == 0]
        if len(blocks):
            if prefixes is None:
                prefixes = Prefixes(numbers)
                padded = (numbers % PRIME).astype(np.float64)
            room = int(blocks[-1]) + 3 * size - len(padded)
            if room > 0:
                padded = np.concatenate([padded, np.full(room, float(PRIME - 1))])
            block = min(size, LONGEST_BLOCK)
            pieces = [zero_mismatches(padded, blocks, block, least) for least in range(size, 2 * size, block)]
            start, distance = (np.concatenate(x) for x in zip(*pieces, strict=True))
            inside = start + distance + block <= n
            start, distance = start[inside], distance[inside]
            left = start - prefixes.reach(start, start + distance, False)
            right = start + distance + prefixes.reach(start, start + distance, True)
            enough = right - left >= np.maximum(min_words, EXPONENT * distance)
            seeds = np.unique(np.stack([left, right, distance, start], axis=1)[enough], axis=0)
            _, one = np.unique(seeds[:, :3], axis=0, return_index=True)
            fresh: dict[tuple[int, int], int] = {}
            for a, b, d, s in seeds[one].tolist():
                if (a, b) in found:
                    continue
                a, b = stretch(numbers, s, d, a, b)
                if b - a >= max(min_words, EXPONENT * d) and (a, b) not in found:
                    fresh[a, b] = min(d, fresh.get((a, b), d))
            found |= fresh
        size *= 2
    rows = sorted((a, q, b) for (a, b), q in found.items())
    return np.array([(a, b, q) for a, q, b in rows], dtype=np.int64).reshape(-1, 3)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(start, length, period) of the greatest length by period; ties by smallest start, then period."""
    best = None
    for run in runs:  # ascending, so that ties keep the first
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row with ``runs`` by start and period, ``best`` (see ``best_run``) and ``collapsed``.

    ``collapsed`` is the text's words joined by single spaces, without the words that lie in a run after its first period.
    """
    new = {"runs": T.ArrayType(RUN), "best": RUN, "collapsed": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in new.items())])
    names = [f.name for f in kept]

    def work(batches: Batches) -> Batches:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                words = [t.split() for t in utf8(b.column(text))]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                after = np.cumsum(sizes + 1) - 1
                first = after - sizes
                numbers, known = np.empty(int(after[-1]) + 1, np.int64), {}
                for w, a, z in zip(words, first.tolist(), after.tolist(), strict=True):
                    numbers[a:z] = [known.setdefault(x, len(known)) for x in w]
                numbers[after] = len(known) + np.arange(len(words))
                found = find_runs(numbers, first, after, min_words)
                drop = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(drop, found[:, 0] + found[:, 2], 1)
                np.add.at(drop, found[:, 1], -1)
                gone = np.cumsum(drop) > 0
                bounds = np.searchsorted(found[:, 0], np.stack([first, after]))
                runs, best, left = [], [], []
                for k, (a, w) in enumerate(zip(first.tolist(), words, strict=True)):
                    low, high = bounds[0, k], bounds[1, k]
                    if low == high:
                        own = []
                        left.append(b" ".join(w))
                    else:
                        own = [(s - a, e - s, q) for s, e, q in found[low:high].tolist()]
                        left.append(b" ".join(x for x, g in zip(w, gone[a : a + len(w)].tolist(), strict=True) if not g))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    top = best_run(own)
                    best.append(dict(zip(("start", "length", "period"), top, strict=True)) if top else None)
                columns = [b.column(c) for c in names]
                columns += [pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return docs.select(*names).mapInArrow(work, schema)
