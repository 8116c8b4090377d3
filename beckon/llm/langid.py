"""Language ID (2): cross-parsing entropy over suffix automata of labelled text.

For every language a suffix automaton is built over a bounded sample of labelled text.  A text is
parsed greedily: a phrase goes on while the language's automaton knows it; where it does not, the
phrase ends and the next begins.  Each phrase costs ``log2`` of the language's sample size, so
``phrases * log2(size) / symbols`` are bits per symbol; the language with the fewest wins, ties go to
the larger sample, then to the smaller name.

Automata are made dense and stepped for many texts and all languages at once.  Symbols are lower-cased
letters, runs of anything else are one space.  Where the samples have more letters than there are symbols, the most
frequent ``DIRECT`` have one each and every other is spelled in ``DIGITS`` symbols, so no letter of a sample is lost
whatever its script; a letter that no sample has is a symbol that no automaton knows.  The parse starts anew every ``SEGMENT`` symbols, so that
long texts are parsed in many lanes.

``fit`` also learns what each language needs: a model of every other sample row gives the phrases per symbol of the
rows between, a high quantile of them, and of random letters.  A text's distance is 0 where its winner knows it as well
as such held-out text and 1 where no better than random letters; ``SHORT_PHRASES`` are free, so a short text is not judged
by its luck.  A language too small to be held out has the strictest need of the others.

Edge cases: a null text or one without letters is ``und`` with score 0; with no labelled text at all
every text is ``und``; null labels and texts teach nothing; repeated texts teach once; the sample is
bounded by ``SAMPLE_ROWS`` rows of at most ``ROW_CHARS`` characters for each language and ``TABLE_CELLS``
cells of all automata; other columns are carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.llm.automaton import SuffixAutomaton
from beckon.llm.common import Batches, bounded_batches, release, slices, tidy, utf8

UNKNOWN = "und"
SAMPLE_ROWS = 300
ROW_CHARS = 2000
LANGUAGE_CHARS = 40_000
TABLE_CELLS = 16_000_000
SYMBOLS = 64
DIRECT = 30  # letters with a symbol of their own where not all can have one; the rest is spelled
DIGITS = SYMBOLS - 2 - DIRECT
MAX_LANGUAGES = 500
SEGMENT = 1024
NEED_QUANTILE = 0.95  # so that a few wrong labels do not loosen it
LONG = 50  # symbols from which a held-out text has a rate of its own
SHORT_PHRASES = 3
_BUCKETS = 1 << 20
_SPELLED = 255


@dataclass
class LanguageModel:
    names: list[str]
    sizes: list[int]
    symbol_of: np.ndarray  # by code point: 0 no letter, 1.. known letters, last other letters, _SPELLED for several symbols
    spelled: np.ndarray  # code points of the letters that are spelled, sorted
    roots: np.ndarray  # by language, times SYMBOLS
    table: np.ndarray  # [state * SYMBOLS + symbol] -> 2 * next state * SYMBOLS, plus 1 if a phrase ended
    need: list[float] = field(default_factory=list)  # phrases per symbol of held-out text, by language
    junk: list[float] = field(default_factory=list)  # and of random letters

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.symbol_of[points]
        if len(out):
            kept = (out != 0) | np.concatenate(([True], out[:-1] != 0))
            out = out[kept]
            if len(self.spelled) and (out == _SPELLED).any():
                out = self.spell(out, points[kept])
        return out

    def spell(self, codes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Replace every ``_SPELLED`` by the digits of its letter's place, as many for each letter."""
        many = codes == _SPELLED
        place = np.searchsorted(self.spelled, points[many])
        width = 1
        while DIGITS**width < len(self.spelled):
            width += 1
        sizes = np.where(many, width, 1)
        out = np.repeat(codes, sizes)
        starts = (np.cumsum(sizes) - sizes)[many]
        for k in range(width):
            out[starts + k] = 1 + DIRECT + place // DIGITS ** (width - 1 - k) % DIGITS
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases ``[text, language]``."""
        owner, parts = [], []
        for k, codes in enumerate(texts):
            for at in range(0, len(codes), SEGMENT):
                owner.append(k)
                parts.append(codes[at : at + SEGMENT])
        total = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not parts:
            return total
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        lanes = np.zeros((int(lengths.max()), len(parts)), dtype=np.int32)
        for lane, k in enumerate(order):
            lanes[: lengths[k], lane] = parts[k]
        active = np.searchsorted(-lengths[order], -np.arange(1, len(lanes) + 1), side="right")
        state = np.repeat(self.roots[:, None], len(parts), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        for t, m in enumerate(active):
            moved = self.table.take(state[:, :m] + lanes[t, :m])
            count[:, :m] += moved & 1
            state[:, :m] = moved >> 1
        np.add.at(total, np.array(owner)[order], count.T)
        return total

    def judge(self, text: str) -> tuple[str, float, float, float]:
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str]) -> list[tuple[str, float, float, float]]:
        """(language, confidence 0 to 1, bits per symbol, distance) of each text; without ``calibrate`` the distance is 0."""
        codes = [self.symbols(t) for t in texts]
        if not self.names:
            return [(UNKNOWN, 0.0, 0.0, 0.0)] * len(texts)
        phrases = self.phrases(codes)
        bits = phrases * np.log2(np.maximum(2, np.array(self.sizes)))
        out = []
        for row, count, own in zip(bits, phrases, codes, strict=True):
            if not own.any():
                out.append((UNKNOWN, 0.0, 0.0, 0.0))
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            out.append((self.names[best], float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0, float(row[best] / len(own)), self.distance(best, int(count[best]), len(own))))
        return out

    def distance(self, language: int, phrases: int, symbols: int) -> float:
        if not self.need:
            return 0.0
        need = self.need[language]
        return float(max(0.0, (phrases - SHORT_PHRASES) / symbols - need) / max(0.05, self.junk[language] - need))

    def calibrate(self, samples: dict[str, list[str]]) -> None:
        """Learn ``need`` and ``junk`` from the samples the model was built of."""
        rows = {name: texts if len(texts) > 1 else [t[k * len(t) // 2 : (k + 1) * len(t) // 2] for t in texts for k in (0, 1)] for name, texts in samples.items()}
        half = build({name: texts[::2] for name, texts in rows.items()})
        rng = np.random.default_rng(0)
        found = {}
        for k, name in enumerate(half.names):
            codes = [c for c in map(half.symbols, rows[name][1::2]) if c.any()]
            if not codes:
                continue
            sizes = np.array([len(c) for c in codes])
            phrases = half.phrases(codes)[:, k]
            rates = (phrases / sizes)[sizes >= LONG]
            letters = sorted({c for t in rows[name] for c in t.lower() if c.isalpha()})
            spaces = sum(int((c == 0).sum()) for c in codes) / sizes.sum()
            drawn = [half.symbols("".join(np.where(rng.random(1000) < spaces, " ", rng.choice(letters, 1000)))) for _ in range(8)]
            need = max(phrases.sum() / sizes.sum(), np.quantile(rates, NEED_QUANTILE) if len(rates) else 0.0)
            found[name] = float(need), float(half.phrases(drawn)[:, k].sum() / sum(map(len, drawn)))
        other = min(found.values(), default=(1.0, 1.0))
        self.need, self.junk = ([found.get(name, other)[k] for name in self.names] for k in (0, 1))


def build(samples: dict[str, list[str]]) -> LanguageModel:
    """Model of sample texts by language; larger samples come first, so they win ties."""
    letters = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0  # surrogates are no characters
    alphabet = points.tobytes().decode("utf-32-le")
    symbol_of = np.fromiter((SYMBOLS - 1 if c.isalpha() else 0 for c in alphabet), np.uint8, len(alphabet))
    ranked = sorted(letters, key=lambda c: (-letters[c], c))
    direct = SYMBOLS - 2 if len(ranked) <= SYMBOLS - 2 else DIRECT
    for k, c in enumerate(ranked[:direct], 1):
        symbol_of[ord(c)] = k
    spelled = np.array(sorted(map(ord, ranked[direct:])), dtype=np.uint32)
    symbol_of[spelled] = _SPELLED
    model = LanguageModel([], [], symbol_of, spelled, np.zeros(0, np.int32), np.zeros(0, np.int32))
    budget = min(LANGUAGE_CHARS, TABLE_CELLS // SYMBOLS // 2 // max(1, len(samples)))
    sized = []
    for name in sorted(samples):
        automaton, size = SuffixAutomaton(), 0
        for text in samples[name]:
            codes = model.symbols(text)[: budget - size]
            codes = codes.tolist()
            for at in range(0, len(codes), SEGMENT):
                automaton.add(c if c != SYMBOLS - 1 else SYMBOLS for c in codes[at : at + SEGMENT])
            size += len(codes)
            if size >= budget:
                break
        if size:  # the dense form alone is kept
            sized.append((-size, name, automaton.table(SYMBOLS + 1)[:, :SYMBOLS].copy()))
        del automaton
    sized.sort(key=lambda x: x[:2])
    model.table = np.empty(sum(steps.size for _, _, steps in sized), np.int32)
    roots, base = [], 0
    while sized:
        size, name, steps = sized.pop(0)
        fresh = 2 * (np.maximum(steps[0], 0) + np.int32(base)) * SYMBOLS + 1
        own = model.table[base * SYMBOLS : (base + len(steps)) * SYMBOLS].reshape(steps.shape)
        np.add(steps, np.int32(base), out=own)
        own *= 2 * SYMBOLS
        np.copyto(own, fresh, where=steps < 0)
        roots.append(base * SYMBOLS)
        model.names.append(name)
        model.sizes.append(-size)
        base += len(steps)
    model.roots = np.array(roots, dtype=np.int32)
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of labelled rows, drawn by a hash of their text."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return build({})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, min(_BUCKETS, 2 * SAMPLE_ROWS * _BUCKETS // r["count"])))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(_BUCKETS))
    picked = rows.withColumn("drawn", drawn).filter(F.col("drawn") < share[F.col("lang")])
    sample = picked.select("lang", "drawn", F.substring("text", 1, ROW_CHARS).alias("text")).distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["drawn"], r["text"])):
        own = texts.setdefault(r["lang"], [])
        if len(own) < SAMPLE_ROWS:
            own.append(r["text"])
    model = build(texts)
    model.calibrate(texts)
    release()
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``bits`` and ``distance`` (names after ``prefix``)."""
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}bits", f"{prefix}distance"]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(clash)}; pass a prefix")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])])

    def run(batches: Batches) -> Batches:
        own = shared.value
        for whole in batches:
            for b in slices(whole, text, 2 << 20):
                found = own.judge_all([x.decode() for x in utf8(b.column(text))])
                tail = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *tail], names=[*b.schema.names, *names])

    return docs.mapInArrow(tidy(run), schema)


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of))
