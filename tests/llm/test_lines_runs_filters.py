"""Line dedup, periodic runs and the filter audit against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beckon.llm import filters, lines, queries, runs
from beckon.llm.queries import planted
from tools.oracle_check import duck
from tools.oracle_check import rows as normal

DOCS = "doc_id long, text string, source string, id string, part string, runs string, n_lines long"
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
SHARED = "This very line, with more than forty characters, is in many texts."


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, "i", "p", "r", -1) for k, t, s in rows], DOCS)


def check(df, columns, want):
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want)


def none_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


EDGE = [(1, None, "a"), (2, "", None), (3, "  \n", "a"), (4, "one", "b"), (None, f"null id\n{SHARED}", "a"), (6, "same words again", "a"), (6, "same words again", "a"), (7, LONG, "a")]


# --- 11 ---


def brute_lines(rows, least=5, size=40):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for k, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= size and k is not None:
                held[key(x)].add(k)
    out = []
    for k, t, _ in rows:
        own = (t or "").split("\n")
        gone = [len(held[key(x)]) >= least and k != max(held[key(x)]) if len(key(x)) >= size else False for x in own]
        out.append((k, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    pool = [f"Line number {k} of the pool, which is certainly long enough" + " é" * (k % 3) for k in range(12)] + ["short", "", "  ", "x" * 39, "Y" * 40, " " + "z" * 39]
    rows = EDGE + [(k, SHARED + "\n\r\n" + SHARED.upper() + " \t", "a") for k in range(20, 27)]
    for k in range(60):
        own = [rng.choice([" ", "", "\t"]) + rng.choice([x, x.upper(), x]) + rng.choice(["", "\r", " "]) for x in rng.choices(pool, k=rng.randint(0, 9))]
        rows.append((rng.randint(100, 130), "\n".join(own), "b"))
    out = lines.dedup_lines(docs(spark, rows))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["n_dropped"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    assert none_first(got) == none_first(brute_lines(rows))


def test_lines_beyond_the_broadcast_table(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_KEYS", 2)
    pool = [f"Sentence {k} is shared by a number of documents here, so it goes" for k in range(9)]
    rows = [(k, "\n".join(pool[j] for j in range(9) if (k + j) % (j + 2) == 0), "a") for k in range(40)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs(spark, rows)).collect()]
    assert none_first(got) == none_first(brute_lines(rows)) and sum(r[2] for r in got) > 50


def test_lines_of_nothing_and_reserved_names(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(docs(spark, []).withColumnRenamed("part", "__lines"))


def test_lines_stay_native(spark):
    plan = lines.dedup_lines(docs(spark, EDGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- 12 ---


def brute_runs(w, least=6):
    n, seen, out = len(w), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(k, text):
    w = (text or "").encode().split()
    if k is not None:
        w = planted(w, zlib.crc32(str(k).encode()))
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found).encode()
    milli = 1000 * best[1] // best[2] if found else None
    return (k, len(found), *best, milli, sha(listed), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


words = st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=90))


def numbered(texts):
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    after = np.cumsum(sizes + 1) - 1
    first = after - sizes
    out = np.empty(int(after[-1]) + 1, np.int64)
    for t, a, z in zip(texts, first, after):
        out[a:z] = t
    out[after] = 100 + np.arange(len(texts))
    return out, first, after


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, st.integers(1, 20), st.integers(0, 90)), min_size=1, max_size=4))
def test_runs_match_brute_force(parts):
    texts = [w + [w[i % min(p, len(w))] for i in range(more)] if w else w for w, p, more in parts]
    numbers, first, after = numbered(texts)
    found = runs.find_runs(numbers, first, after)
    got = [[(int(s - a), int(e - s), int(q)) for s, e, q in found if a <= s < z] for a, z in zip(first, after)]
    assert got == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("size", [1, 2, 32, 64, 128, 512])
def test_transform_correlates_exactly(size):
    rng = np.random.default_rng(size)
    numbers = rng.integers(0, 3, 40 * size).astype(np.float64)
    numbers[5 * size : 9 * size] = numbers[2 * size : 6 * size]
    blocks = np.arange(0, 30 * size, 2 * size)
    got = set(zip(*(x.tolist() for x in runs.zero_mismatches(numbers, blocks, size, size))))
    want = {(int(s), d) for s in blocks for d in range(size, 2 * size) if np.array_equal(numbers[s : s + size], numbers[s + d : s + d + size])}
    assert got == want


def test_long_periods_and_long_blocks(monkeypatch):
    rng = random.Random(3)
    text = [rng.randrange(5000) for _ in range(9000)]
    for a, p, size in ((10, 700, 2900), (5000, 130, 700), (8000, 1, 6)):
        text[a : a + size] = [text[a + i % p] for i in range(size)]
    for longest in (1 << 19, 64):
        monkeypatch.setattr(runs, "LONGEST_BLOCK", longest)
        numbers, first, after = numbered([text, text])
        found = runs.find_runs(numbers, first, after)
        assert [(s, e - s, q) for s, e, q in found[: len(found) // 2].tolist()] == brute_runs(text)


def test_collapsed_rows(spark):
    rows = EDGE + [(10, "a a a a a a b", "a"), (11, "x " + "go home now " * 5 + "end", "b"), (12, "a\x0bb a\tb a\nb a b", "a")]
    out = runs.collapse_runs(docs(spark, rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "source", "id", "part", "n_lines", "runs", "best", "collapsed"]
    assert [tuple(x) for x in got[10]["runs"]] == [(0, 6, 1)] and got[10]["collapsed"] == "a b"
    assert got[11]["collapsed"] == "x go home now end" and tuple(got[11]["best"]) == (1, 15, 3)
    assert got[12]["collapsed"] == "a b" and got[1]["collapsed"] == "" and got[1]["runs"] == [] and got[1]["best"] is None
    assert Counter(r["doc_id"] for r in out.collect())[6] == 2
    assert runs.collapse_runs(docs(spark, [])).count() == 0
    assert runs.best_run([(0, 8, 2), (3, 4, 1), (9, 12, 3)]) == (0, 8, 2)


def test_query_of_runs(spark, sf):
    want = [digest(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert none_first(tuple(r) for r in got.collect()) == none_first(want)
    assert sum(w[1] > 0 for w in want) > 10


# --- 13 ---


def brute_audit(rows, labels):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, x in labels if k is not None and x == 1}
    fails = []
    for k, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum(c.isascii() and c.isupper() for c in t) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), k is not None and least[t] < k)) if bad}
        fails.append((s or "", f, k in good, k in toxic))
    out, removed = {}, Counter()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                here = [x for x in own if c in x[1] and not x[1] & set(order[: step - 1])]
                removed[part, c] += len(here)
                out[part, order, step] = (
                    sum(not x[1] & set(order[:step]) for x in own), len(here), sum(c in x[1] and bool(x[1] & set(order[: step - 1])) for x in own),
                    sum(x[1] == {c} for x in own), sum(x[2] for x in here), sum(x[3] for x in here),
                )
    return [(*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


AUDIT = ["part", "filter_order", "step", *filters.COUNTS]
FIFTY = " ".join(f"word{k}" for k in range(60))
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, None), (None, 1, 1), (31, 1, 1), (33, 1, 0), (40, 0, 1), (999, 1, 1)]


def audited(spark, rows, labels=LABELS):
    return filters.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_audit_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filters, "RANGE_BYTES", 2000)
    monkeypatch.setattr(filters, "PACK_BYTES", 3000)
    rng = random.Random(9)
    base = [FIFTY + tail for tail in ("", " a", " b", " aa", " ab # x", " THIS IS LOUD AND LOUDER STILL, WITH EVEN MORE CAPITALS", " word1" * 50, " é", "é")]
    rows = EDGE + [(31, FIFTY, "a"), (33, FIFTY, None), (33, FIFTY, "b"), (None, FIFTY, "b")]
    rows += [(rng.randint(34, 80), rng.choice(base) + rng.choice(["", "", " tail"]), rng.choice(["a", "b", "", None])) for _ in range(120)]
    rng.shuffle(rows)
    check(audited(spark, rows), AUDIT, brute_audit(rows, LABELS))


def test_audit_of_nothing(spark):
    assert audited(spark, []).count() == 0
    check(audited(spark, EDGE, [(None, None, None)]), AUDIT, brute_audit(EDGE, []))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=7).map(str.encode), max_size=30))
def test_trie_holds_the_first_id_of_each_text(texts):
    trie, first = filters.RadixTrie(), {}
    for k, t in enumerate(texts):
        assert trie.insert(t, k) == first.setdefault(t, k)


def test_bounds_follow_long_common_beginnings(spark, monkeypatch):
    monkeypatch.setattr(filters, "RANGE_BYTES", 4000)
    rows = [(k, "the same beginning of every text " * 20 + f"{k:05d}", "a") for k in range(300)]
    frame = docs(spark, rows)
    bounds = filters.range_bounds(frame, "text", sum(len(t) + 1 for _, t, _ in rows))
    assert bounds == sorted(bounds) and len(bounds) > 20 and max(map(len, bounds)) <= len(rows[0][1])
    monkeypatch.setattr(filters, "BOUNDS_BYTES", 10)
    assert filters.range_bounds(frame, "text", sum(len(t) + 1 for _, t, _ in rows)) == []


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_filter_audit"])
def test_queries_match_oracle(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    res = duck(sf).execute(queries.ORACLES[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([d[0] for d in res.description], res.fetchall())
