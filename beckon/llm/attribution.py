"""Token counts (7): offset-mapped attribution of tokens to sections.

Whole documents are encoded once; every token has a span of characters.  A token belongs to the
sections that contain its anchor, by an explicit rule: its first character (``start``), its last
(``end``) or its middle one, the left of two (``middle``).  Token anchors are sorted, so the join of
spans with sections is two binary searches per section.  Sections may overlap or leave gaps; the row
with null section counts the tokens that no section holds.

Edge cases: a null or empty text has no tokens; null section arrays and null bounds count as absent or
empty; bounds beyond the text are cut; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import Batches, slices, utf8
from beckon.llm.tokens import encoder

RULES = {"start": lambda a, b: a, "end": lambda a, b: np.maximum(a, b - 1), "middle": lambda a, b: (a + np.maximum(a, b - 1)) // 2}


def line_bounds(text: str) -> list[tuple[str, int, int]]:
    """Lines as sections ``line-k``, each with its line break."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        if end > at:
            out.append((f"line-{k}", at, end))
        at = end
    return out


def attach_sections(docs: DataFrame, sections: DataFrame, key: str, column: str = "sections") -> DataFrame:
    """Give ``docs`` the spans (name, start, stop) of a table of sections as an array column."""
    spans = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "start", "stop"))).alias(column))
    return docs.join(spans, key, "left")


def count_section(anchors: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, stop: int) -> tuple[int, int]:
    """Tokens whose anchor lies in the section, and tokens that cross one of its bounds."""
    inside = np.searchsorted(anchors, stop) - np.searchsorted(anchors, first)
    crossing = (starts < first) & (ends > first) | (starts < stop) & (ends > stop) if len(starts) < 64 else None
    if crossing is not None:
        return int(max(0, inside)), int(crossing.sum())
    low, high = np.searchsorted(ends, first, "right"), np.searchsorted(starts, first)
    low2, high2 = np.searchsorted(ends, stop, "right"), np.searchsorted(starts, stop)
    both = max(0, min(high, high2) - max(low, low2))
    return int(max(0, inside)), int(max(0, high - low) + max(0, high2 - low2) - both)


def attribute_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", key: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """(key, section, start, stop, n_tokens, n_crossing, doc_tokens): one row per section and document.

    ``sections`` names an array column of (name, start, stop) in characters; without it lines are taken.
    """
    anchor = RULES[rule]

    def count(batches: Batches) -> Batches:
        tok = encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [x.decode() for x in utf8(b.column("text"))]
                given = b.column("sections").to_pylist() if sections else None
                rows, out = [], []
                for k, (body, (starts, ends)) in enumerate(zip(texts, tok.spans(texts), strict=True)):
                    bounds = line_bounds(body) if given is None else [(s["name"], max(0, s["start"] or 0), min(len(body), s["stop"] or 0)) for s in given[k] or [] if s]
                    marks = anchor(starts, ends)
                    cover = np.zeros(len(body) + 2, dtype=np.int32)
                    for name, first, stop in bounds:
                        stop = max(first, stop)
                        inside, crossing = count_section(marks, starts, ends, first, stop)
                        rows.append(k)
                        out.append((name, first, stop, inside, crossing, len(starts)))
                        cover[min(first, len(body))] += 1
                        cover[min(stop, len(body))] -= 1
                    outside = int((np.cumsum(cover)[marks] == 0).sum()) if len(marks) else 0
                    if outside or not bounds:
                        rows.append(k)
                        out.append((None, None, None, outside, 0, len(starts)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"])

    cols = [F.col(key).alias("key"), F.col(text).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    rows = docs.select(*cols)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, section string, start long, stop long, n_tokens long, n_crossing long, doc_tokens long").withColumnRenamed("key", key)
