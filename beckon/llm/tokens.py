"""Exact token ids of whole texts through a tokenizer file, with a bounded cache of word pieces.

The tokenizers here cut a normalised text into pieces and encode every piece by itself, so a piece
that occurs again need not be encoded again, and a new piece is merged by the ranks of the file's merges.
Texts of plain Latin characters take that path; any other text, and one that spells a special token,
goes to the tokenizer whole.  Ids are the same (where pieces hold no white space, words are looked up whole); ``tests/llm`` compares them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

CACHED_PIECES = 300_000
# The piece pattern of byte-level vocabularies when their file names none.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"
# Characters for which lower-casing and composing never depend on their neighbours.
_PLAIN = r"\t\n\r\x20-\x7e\xa1-įĲ-ɏ"


def _class(kind: str) -> str:
    return "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _compile(pattern: str) -> re.Pattern:
    """The pattern for plain Latin texts, with letter and number classes spelled out."""
    for kind in "LN":
        own = _class(kind)
        inside = re.compile(r"\[[^\]]*\\p\{" + kind + r"\}[^\]]*\]")
        pattern = inside.sub(lambda m, k=kind, o=own: m[0].replace(rf"\p{{{k}}}", o), pattern)
        pattern = pattern.replace(rf"\p{{{kind}}}", f"[{own}]")
    if pattern.startswith(CONTRACTIONS):  # they start like no letter or number, so these can be tried first
        letters, numbers, rest = pattern.removeprefix(CONTRACTIONS).split("|", 2)
        pattern = f"{letters}|{numbers}|{CONTRACTIONS}{rest}"
    return re.compile(pattern)


def byte_names() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class RankMerger:
    """Byte pair merges of single pieces by rank; 0xFF, which UTF-8 never has, marks a word's end."""

    def __init__(self, model: dict) -> None:
        import tiktoken

        self.end, suffix = (b"\xff", model["end_of_word_suffix"]) if model.get("end_of_word_suffix") else (b"", "")
        names = byte_names()

        def raw(token: str) -> bytes:
            ended = bool(suffix) and token.endswith(suffix)
            return bytes(names[c] for c in (token[: -len(suffix)] if ended else token)) + (self.end if ended else b"")

        ranks = {bytes([b]): b for b in range(256)}
        if self.end:
            for b in range(255):
                ranks[bytes([b]) + self.end] = len(ranks)
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.merge = tiktoken.Encoding("pieces", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.id_of = np.zeros(len(ranks), dtype="<u4")
        self.bytes_of = np.array([len(t.removesuffix(b"\xff") if self.end else t) for t in ranks])
        for token, k in model["vocab"].items():
            if all(c in names for c in (token.removesuffix(suffix) if suffix else token)) and raw(token) in ranks:
                self.id_of[ranks[raw(token)]] = k

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all pieces' tokens, one after the other, and the number of each piece's."""
        merged = [self.merge(p.encode() + self.end) for p in pieces]
        counts = np.fromiter(map(len, merged), np.int64, len(merged))
        return np.fromiter(chain.from_iterable(merged), np.int64, int(counts.sum())), counts


class Learned(dict):
    """Ids of white-space words, or of pieces where pieces hold white space; a missing one is merged on demand."""

    def __init__(self, encoder: Encoder) -> None:
        self.split, self.merge, self.end = encoder.pieces, encoder.merger.merge, encoder.merger.end
        self.id_of = encoder.merger.id_of.tolist()

    def __missing__(self, word: str) -> bytes:
        ranks = chain.from_iterable(self.merge(p.encode() + self.end) for p in self.split(word))
        self[word] = out = array("I", map(self.id_of.__getitem__, ranks)).tobytes()
        return out


_EVEN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC9)])  # bytes of plain characters


class Encoder:
    """``ids(texts)`` and ``spans(texts)`` for one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        norm = spec["normalizer"] or {"normalizers": []}
        self.lower = any(n["type"] == "Lowercase" for n in norm["normalizers"])
        self.covers = split is None  # pieces then cover the text without gaps
        self.pieces = _compile(split["pattern"]["Regex"] if split else BYTE_PATTERN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[:2].encode() for t in special} | {b"\xc2", b"\xc4\xb0"}
        self.odd = re.compile("|".join([f"[^{_PLAIN}]", *map(re.escape, special)])).search
        self.merger = RankMerger(spec["model"])
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ids_of = Learned(self)
        self.spans_of: dict[str, tuple[int, bytes, bytes]] = {}

    def _cut(self, text: str) -> list[str]:
        return self.pieces(text.lower() if self.lower else text)

    def _fresh(self, cut: list[list[str]], known: dict) -> list[str]:
        if len(known) > CACHED_PIECES:
            known.clear()
        return list(set().union(*cut) - known.keys())

    def _learn_spans(self, pieces: list[str]) -> None:
        ranks, counts = self.merger(pieces)
        ends = np.cumsum(self.merger.bytes_of[ranks])  # in bytes of all pieces
        starts = ends - self.merger.bytes_of[ranks]
        body = np.frombuffer("".join(pieces).encode(), np.uint8)
        char = np.cumsum((body & 0xC0) != 0x80)  # characters begun up to each byte
        first, stop = char[starts] - 1, char[ends - 1]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        first, stop = (first - base).astype("<i4").tobytes(), (stop - base).astype("<i4").tobytes()
        at = 0
        for piece, n in zip(pieces, counts.tolist(), strict=True):
            self.spans_of[piece] = (n, first[4 * at : 4 * (at + n)], stop[4 * at : 4 * (at + n)])
            at += n

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.ids_of) > CACHED_PIECES:
            self.ids_of.clear()
        get, out = self.ids_of.__getitem__, []
        for text in texts:
            if self.is_odd(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                own = text.lower() if self.lower else text
                out.append(b"".join(map(get, self.pieces(own) if self.covers else own.split())))
        return out

    def is_odd(self, text: str) -> bool:
        """Whether a text needs the tokenizer itself; most are told by their bytes."""
        raw = text.encode()
        if raw.translate(None, _EVEN):
            return True
        return any(m in raw for m in self.marks) and bool(self.odd(text))

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Character starts and ends (exclusive) of each text's tokens."""
        cut = [None if not self.covers or self.is_odd(t) else self._cut(t) for t in texts]
        self._learn_spans(self._fresh([c for c in cut if c], self.spans_of))
        out = []
        for text, c in zip(texts, cut, strict=True):
            if c is None:
                offsets = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
                out.append((offsets[:, 0], offsets[:, 1]))
                continue
            if not c:
                out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            counts, starts, stops = zip(*map(self.spans_of.__getitem__, c), strict=True)
            sizes = np.fromiter(map(len, c), np.int64, len(c))
            base = np.repeat(np.cumsum(sizes) - sizes, counts)
            out.append((base + np.frombuffer(b"".join(starts), "<i4"), base + np.frombuffer(b"".join(stops), "<i4")))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path)
