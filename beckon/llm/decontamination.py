"""Benchmark decontamination (1): a generalised suffix automaton of the test items.

The automaton holds every substring of the normalised items.  A document's words stream through it;
after each word the state tells the longest suffix that some item contains.  A suffix of at least
``window`` words means an item window ends here; a whole shorter item is a window of its own.  All
words inside an occurrence are *hit*; hit runs are the spans that ``decontaminate`` removes.

Long items are cut into overlapping segments, segments are dealt into blocks of about ``block_words``
words with an automaton each, and the documents stream past the blocks one after the other.  The driver
collects one block's words at a time, but it keeps the automata of all blocks and every worker holds them
all, so the whole benchmark has to fit there; only the documents are without bound.

Edge cases: null or empty texts have no words and no hits; items without words match nothing; an item
with null id counts under the id ``null``; repeated items count once; empty tables give no hits or no
rows; columns of the inputs other than the named ones are carried along, or ignored where stated.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.llm.automaton import SuffixAutomaton
from beckon.llm.common import Batches, contract_words, slices, tidy, utf8

WINDOW = 10
BLOCK_WORDS = 1_000_000
SEGMENT_WORDS = 4096
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
HITS = "struct<n_words:bigint,runs:array<bigint>,items:array<string>,longest:bigint>"


@dataclass
class ItemIndex:
    """Automaton of one block of items with what its states stand for."""

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    automaton: SuffixAutomaton = field(default_factory=SuffixAutomaton)
    #: state whose suffix class holds a full window -> items that contain it
    windows: dict[int, set[str]] = field(default_factory=dict)
    #: state -> (length, item) of whole short items that end there
    shorts: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    least: int = 0

    @classmethod
    def build(cls, segments: list[tuple[str, list[bytes]]], window: int) -> ItemIndex:
        """``segments``: (item id, words); one of fewer than ``window`` words is a whole item."""
        index = cls(window)
        coded = [(item, [index.words.setdefault(w, len(index.words)) for w in words]) for item, words in segments if words]
        for _, codes in coded:
            index.automaton.add(codes)
        index.least = min([window, *(len(c) for _, c in coded)]) if coded else 0
        for item, codes in coded:
            states, sizes = index.automaton.match(codes)
            if len(codes) < window:
                index.shorts.setdefault(index.reach(states[-1], len(codes)), []).append((len(codes), item))
            for state, size in zip(states, sizes, strict=True):
                if size >= window:
                    index.windows.setdefault(index.reach(state, window), set()).add(item)
        return index

    def reach(self, state: int, length: int) -> int:
        """The state that holds the suffix of ``length`` words of ``state``."""
        link, longest = self.automaton.link, self.automaton.length
        while longest[link[state]] >= length:
            state = link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Occurrences as word ranges, the items they belong to, and the longest match."""
        if not self.least or len(words) < self.least:
            return [], set(), 0
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for first, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if stop - first < self.least:
                continue  # a match lies within words that items have
            states, sizes = self.automaton.match(codes[first:stop].tolist())
            for at, (state, size) in enumerate(zip(states, sizes, strict=True), first + 1):
                longest = max(longest, size)
                if size >= self.window:
                    ranges.append((at - self.window, at))
                    items |= self.windows.get(self.reach(state, self.window), set())
                if self.shorts:
                    seen = state
                    while seen > 0:
                        for length, item in self.shorts.get(seen, ()):
                            if length <= size:
                                ranges.append((at - length, at))
                                items.add(item)
                        seen = self.automaton.link[seen]
        return ranges, items, longest


def join_runs(ranges: list[tuple[int, int]]) -> list[int]:
    """Union of ranges as a flat list start, end, start, end."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def item_segments(bench: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, segment, words): normalised items, long ones cut with an overlap of ``window - 1`` words."""

    def cut(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for name, body in zip(b.column("item").to_pylist(), utf8(b.column("body")), strict=True):
                words = contract_words(body)
                step = max(SEGMENT_WORDS, window)
                for k, at in enumerate(range(0, max(1, len(words) - window + 1), step)):
                    part = words[at : at + step + window - 1]
                    if part:
                        rows.append((name, k, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "segment", "words", "n"), r, strict=True)) for r in rows], schema=pa.schema([("item", pa.string()), ("segment", pa.int64()), ("words", pa.binary()), ("n", pa.int64())]))

    named = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("body"))
    return named.mapInArrow(tidy(cut), "item string, segment long, words binary, n long").distinct()


def item_blocks(bench: DataFrame, item: str, text: str, window: int, block_words: int) -> list[ItemIndex]:
    """Automata of blocks of about ``block_words`` words each; the driver collects a block at a time and keeps all automata."""
    segments = item_segments(bench, item, text, window)
    total = segments.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // block_words)
    out = []
    for k in range(count):
        rows = segments.filter(F.pmod(F.xxhash64("item", "segment"), F.lit(count)) == k).collect()
        out.append(ItemIndex.build([(r["item"], bytes(r["words"]).split(b" ")) for r in rows], window))
    return out


def scan_block(spark: SparkSession, docs: DataFrame, index: ItemIndex, text: str, hits: str) -> DataFrame:
    """Add the block's findings to the ``hits`` struct of every document."""
    shared = spark.sparkContext.broadcast(index)
    kept = [f for f in docs.schema.fields if f.name != hits]
    schema = T.StructType([*kept, T.StructField(hits, T._parse_datatype_string(HITS))])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])

    def scan(batches: Batches) -> Batches:
        block = shared.value
        for whole in batches:
            for b in slices(whole, text):
                found = []
                old = b.column(hits).to_pylist() if hits in b.schema.names else repeat(None)
                for body, before in zip(utf8(b.column(text)), old):
                    words = contract_words(body)
                    ranges, items, longest = block.scan(words)
                    if before:
                        flat = before["runs"]
                        ranges += list(zip(flat[::2], flat[1::2], strict=True))
                        items |= set(before["items"])
                        longest = max(longest, before["longest"])
                    found.append({"n_words": len(words), "runs": join_runs(ranges), "items": sorted(items), "longest": longest})
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, kind)], names=[*names, hits])

    return docs.mapInArrow(tidy(scan), schema)


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, hits: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``hits``: n_words, runs (hit word ranges, flat), items (sorted ids), longest match."""
    if hits in docs.columns:
        raise ValueError(f"docs has a column {hits}; name the result otherwise")
    spark = docs.sparkSession
    blocks = item_blocks(bench, item, item_text, window, block_words) or [ItemIndex(window)]
    for block in blocks:
        docs = scan_block(spark, docs, block, text, hits)
    return docs


def contamination_report(found: DataFrame, keys: list[str], hits: str = "contamination") -> DataFrame:
    """Digest per document: word counts, items, and the hash over the items' ids."""

    def spell(batches: Batches) -> Batches:
        for b in batches:
            rows = b.column(hits).to_pylist()
            hit = [sum(r["runs"][1::2]) - sum(r["runs"][::2]) for r in rows]
            digest = [hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in rows]
            cols = [pa.array([r["n_words"] for r in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(r["items"]) for r in rows], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array([r["longest"] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *cols], names=[*keys, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])

    head = [found.schema[k] for k in keys]
    tail = T._parse_datatype_string("struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,longest_match:bigint>").fields
    return found.select(*keys, hits).mapInArrow(tidy(spell), T.StructType([*head, *tail]))


def cut_spans(text: str, runs: list[int]) -> str:
    """``text`` without the characters from the first to the last word of each run of words."""
    ends = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, bench: DataFrame, max_coverage: float = 0.5, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    Documents whose hit words exceed ``max_coverage`` of their words go; of the others every hit span
    goes, and what is left is scanned again until no window occurs (a cut can join two halves).
    """
    hits, fields = "__contamination", docs.schema
    spark = docs.sparkSession
    blocks = item_blocks(bench, item, item_text, window, block_words) or [ItemIndex(window)]
    found = docs
    for block in blocks:
        found = scan_block(spark, found, block, text, hits)
    shared = [spark.sparkContext.broadcast(b) for b in blocks]

    def clean(batches: Batches) -> Batches:
        for whole in batches:
            for b in slices(whole, text):
                texts, keep = b.column(text).to_pylist(), []
                for k, hit in enumerate(b.column(hits).to_pylist()):
                    runs = hit["runs"]
                    if sum(runs[1::2]) - sum(runs[::2]) > max_coverage * hit["n_words"]:
                        continue
                    while runs:
                        texts[k] = cut_spans(texts[k], runs)
                        words = contract_words(texts[k].encode())
                        runs = join_runs([r for block in shared for r in block.value.scan(words)[0]])
                    keep.append(k)
                rows = b.take(pa.array(keep, pa.int64()))
                cols = [pa.array([texts[k] for k in keep], rows.column(n).type) if n == text else rows.column(n) for n in fields.names]
                yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    return found.mapInArrow(tidy(clean), fields)
