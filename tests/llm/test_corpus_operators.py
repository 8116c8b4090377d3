"""Jaccard join, language model, embeddings, pipeline and registered queries on small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from beckon.llm import embeddings, jaccard, lm, queries
from beckon.llm.common import word_hashes
from beckon.llm.components import components
from tools.oracle_check import duck, rows

ORACLES = queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    res = duck(sf).execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in res.description], res.fetchall())


class Sets:
    """Union-find."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_word_hashes_follow_words(texts):
    texts = [t.replace(b"q", b" ") for t in texts]
    hashes, counts = word_hashes(texts)
    words = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_word_hashes_of_long_texts():
    text = b" ".join(b"w%d" % (k % 5000) for k in range(400_000)) + b" " + b"z" * 1_500_000 + b" end"
    hashes, counts = word_hashes([b"w7 end", text, b"z" * 1_500_000])
    assert counts.tolist() == [2, 400_002, 1] and hashes[0] == hashes[2 + 7] and hashes[1] == hashes[-2] and hashes[-1] == hashes[-3]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    want = Sets(range(31))
    for a, b in pairs:
        want.join(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long")) if pairs else None
    for r in got.collect() if got is not None else []:
        assert r["component"] == want.root(r["node"])


def similar(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_match_brute_force(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 12)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(7)
    line = " ".join(f"c{k}" for k in range(30))
    texts = [None, "", " \n", "a b", "A  b", "b a", "one two three", "one two three"]
    for base in range(12):
        words = [f"b{base}x{k}" for k in range(int(rng.integers(20, 90)))]
        for _ in range(int(rng.integers(1, 25))):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"n{rng.integers(0, 10**9)}"
            texts.append(" ".join(own) + (f" {line}" if rng.random() < 0.5 else ""))
    ids = [5 * k + 3 for k in range(len(texts))]
    sets = [shingles(t, width) for t in texts]
    want = Sets(ids)
    for k, a in enumerate(sets):
        for j in range(k):
            if a and sets[j] and similar(a, sets[j], percent):
                want.join(ids[k], ids[j])
    frame = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, component_id string").repartition(3)
    got = {r["doc_id"]: r for r in jaccard.similar_groups(frame, width=width, percent=percent).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(s), want.root(k)) for k, s in zip(ids, sets, strict=True)}


def test_jaccard_edges(spark):
    kind = "doc_id long, text string"
    assert jaccard.similar_groups(spark.createDataFrame([], kind)).count() == 0
    got = jaccard.similar_groups(spark.createDataFrame([(None, "p q r s t"), (4, "p q r s t"), (2, "p q r s t"), (2, "p q r s t"), (9, None), (None, None)], kind)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter({(None, 2, 2): 1, (4, 2, 2): 1, (2, 2, 2): 2, (9, 0, 9): 1, (None, 0, None): 1})


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[: int(rng.integers(50, 60))], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)])) for b in base for _ in range(15)]
    sizes = np.array([len(s) for s in sets])
    all_rows = np.arange(len(sets))
    found = {tuple(sorted(p)) for a, b in jaccard.candidates([jaccard.signature(s) for s in sets], sizes, all_rows, all_rows, all_rows, 85) for p in zip(a.tolist(), b.tolist(), strict=True)}
    left, right = all_rows[::2], all_rows[1::2]
    across = {tuple(sorted(p)) for a, b in jaccard.candidates([jaccard.signature(s) for s in sets], sizes, all_rows, left, right, 85) for p in zip(a.tolist(), b.tolist(), strict=True)}
    real = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(set(sets[i].tolist()), set(sets[j].tolist()), 85)}
    assert real and real <= found and len(found) < 3 * len(real) and {p for p in real if (p[0] + p[1]) % 2} <= across


def katz(texts, held):
    """Plain Katz backoff over dictionaries."""
    tokens = [(t or "").encode().lower().split() + ["end"] for t in texts]
    uni, bi, hist = Counter(), Counter(), Counter()
    for own, out in zip(tokens, held, strict=True):
        if not out:
            uni.update(own)
            hist.update(["begin", *own[:-1]])
            bi.update(zip(["begin", *own[:-1]], own, strict=True))
    total, types = sum(uni.values()), len(uni)
    of = Counter(uni.values())
    one = lm.Unigrams(total, types, [float(of[r]) for r in range(1, 7)])
    p1 = lambda w: float(one.probability(np.array([uni[w]]))[0])
    of = Counter(bi.values())
    d = lm.discounts([float(of[r]) for r in range(1, 7)], lm.MIN_COUNT)
    mass, low = Counter(), Counter()
    for (v, w), c in bi.items():
        if c >= lm.MIN_COUNT:
            mass[v] += d[min(c, 6)] * c
            low[v] += p1(w)

    def p(v, w):
        whole = max(hist[v], mass[v] + 0.5) if hist[v] else 1.0
        if bi[(v, w)] >= lm.MIN_COUNT:
            return d[min(bi[(v, w)], 6)] * bi[(v, w)] / whole
        return ((1 - mass[v] / whole) / (1 - low[v]) if hist[v] else 1.0) * p1(w)

    rows = []
    for own in tokens:
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        rows.append((len(own), sum(uni[w] > 0 for w in own), total, base, sum(math.log10(p(v, w)) for v, w in zip(["begin", *own[:-1]], own, strict=True))))
    return rows, p, uni


@pytest.mark.parametrize("batch", [1 << 20, 50])
def test_katz_matches_brute_force_and_sums_to_one(spark, monkeypatch, batch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", batch)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", "W1 w1\tw2"] + [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)] + ["never seen words w1"]
    held = [k % 7 == 3 for k in range(len(texts) - 1)] + [True]
    frame = spark.createDataFrame([(k, t, h, "x") for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean, score string").repartition(3)
    got = {r["doc_id"]: r for r in lm.score(frame).collect()}
    want, p, uni = katz(texts, held)
    for k, row in enumerate(want):
        own = got[k]
        assert (own["n_tokens"], own["n_known"], own["train_tokens"], own["held_out"]) == (*row[:3], held[k])
        assert own["base_score"] == pytest.approx(row[3], abs=1e-6) and own["score"] == pytest.approx(row[4], abs=1e-6)
    for v in ["begin", b"w0", b"w59", b"nothing"]:
        assert sum(p(v, w) for w in [*uni, "unknown"]) == pytest.approx(1.0)


def katz_of(order, texts, held):
    """Plain recursive Katz backoff of any order that keeps every n-gram seen."""
    tokens = [["begin", *(t or "").encode().lower().split(), "end"] for t in texts]
    grams = [Counter() for _ in range(order + 1)]
    for own, out in zip(tokens, held, strict=True):
        for n in range(1, order + 1):
            grams[n].update(tuple(own[k - n + 1 : k + 1]) for k in range(max(1, n - 1), len(own)) if not out)
    of = [Counter(g.values()) for g in grams]
    one = lm.Unigrams(sum(grams[1].values()), len(grams[1]), [float(of[1][r]) for r in range(1, 7)])
    d = [lm.discounts([float(o[r]) for r in range(1, 7)], 1) for o in of]
    seen, times = {}, Counter()
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            seen.setdefault(g[:-1], []).append(g[-1])
            times[g[:-1]] += c
    memo = {}

    def history(h):
        if h not in memo:
            mass = sum(d[len(h) + 1][min(6, grams[len(h) + 1][(*h, w)])] * grams[len(h) + 1][(*h, w)] for w in seen[h])
            whole = max(times[h], mass + 0.5)
            memo[h] = whole, (1 - mass / whole) / (1 - sum(p(h[1:], w) for w in seen[h]))
        return memo[h]

    def p(h, w):
        if not h:
            return float(one.probability(np.array([grams[1][(w,)]]))[0])
        c = grams[len(h) + 1][(*h, w)]
        if c:
            return d[len(h) + 1][min(6, c)] * c / history(h)[0]
        return (history(h)[1] if h in seen else 1.0) * p(h[1:], w)

    return [sum(math.log10(p(tuple(own[max(0, k - order + 1) : k]), own[k])) for k in range(1, len(own))) for own in tokens], p, grams


@pytest.mark.parametrize(("order", "batch"), [(1, 50), (2, 50), (3, 1 << 20), (3, 50), (4, 50)])
def test_katz_of_any_order_keeps_what_was_seen_once(spark, monkeypatch, order, batch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", batch)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", "W1 w1\tw2"] + [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)] + ["never seen words w1"]
    texts += texts[20:30] + [f"{t} w3" for t in texts[30:40]]
    held = [k % 7 == 3 for k in range(len(texts))]
    frame = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, order=order).collect()}
    want, p, grams = katz_of(order, texts, held)
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-6)
    for h in [("begin",), (b"w0",), ("begin", b"w0"), (b"w1", b"w2"), (b"w0", b"w1", b"w2")]:
        if len(h) < order:
            assert sum(p(h, *g) for g in [*grams[1], ("unknown",)]) == pytest.approx(1.0)


def test_order_and_batches_without_long_texts(spark):
    frame = spark.createDataFrame([(1, None, False), (2, "", True)], "doc_id long, text string, held_out boolean")
    assert all(math.isfinite(r["score"]) for r in lm.score(frame, order=4).collect())
    with pytest.raises(ValueError):
        lm.score(frame, order=0)


def test_katz_edges(spark):
    kind = "doc_id long, text string, held_out boolean"
    assert lm.score(spark.createDataFrame([], kind)).count() == 0
    got = lm.score(spark.createDataFrame([(1, "a b", True), (None, None, True)], kind)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0.0 for r in got) and len(got) == 2
    got = lm.score(spark.createDataFrame([(1, "a b a b", None), (1, "a b a b", False)], kind)).collect()
    assert len(got) == 2 and all(math.isfinite(r["score"]) and r["train_tokens"] == 10 for r in got)


def test_counts_survive_packing():
    counts = np.array([0, 1, 126, 127, 128, 10**12])
    owner = np.array([True, False, True, False, True, False])
    back, own = lm.unpack_counts(lm.pack_counts(counts, owner))
    assert back.tolist() == counts.tolist() and own.tolist() == owner.tolist()
    hashes = np.sort(np.random.default_rng(0).integers(0, 2**60, 50).astype(np.uint64))
    assert lm.widen(lm.narrow(hashes, 4)).tolist() == ((hashes << np.uint64(4)) >> np.uint64(24)).tolist()


def brute_vectors(table, threshold=0.93):
    ids = [r[0] for r in table]
    good = {}
    for k, (_, v, label) in enumerate(table):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v) / max(map(abs, v))
            good[k] /= np.linalg.norm(good[k])
    sets, links = Sets(range(len(table))), Counter()
    for i in good:
        for j in good:
            if i < j and table[i][2] == table[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    least = {}
    for k, i in enumerate(ids):
        r = sets.root(k)
        least[r] = min(least.get(r, i), i)
    return Counter((i, links[k], least[sets.root(k)]) for k, i in enumerate(ids))


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(9)
    table = []
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            table.append([float(x) for x in base + rng.normal(size=16) * 0.08])
    tight = rng.normal(size=16)
    table += [[float(x) for x in tight + rng.normal(size=16) * 0.01] for _ in range(90)]
    table += [table[0], table[0], [0.0] * 16, None, [], [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e-300] * 16, [2e-300] * 16]
    rows = [(k * 3 + 1, v, None if k % 11 == 5 else k % 2) for k, v in enumerate(table)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(3)
    got = embeddings.near_duplicates(frame).collect()
    want = brute_vectors(rows)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).collect()
    rng = np.random.default_rng(1)
    rows = []
    for k, r in enumerate(table):
        v = np.array(r["embedding"], dtype=float)
        noise = rng.normal(size=len(v))
        noise -= noise @ v / (v @ v) * v
        noise *= np.linalg.norm(v) / np.linalg.norm(noise) * math.tan(math.acos(0.935))  # pairs right at the threshold
        rows += [(2 * k, v.tolist(), r["label"]), (2 * k + 1, (v + noise).tolist(), r["label"])]
    want = sum(n * c for (_, n, _), c in brute_vectors(rows).items())
    got = sum(r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert 0.97 * want <= got <= want


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = next(t for t in texts.values() if len(t.split()) > 100)
    planted = spark.createDataFrame([(10**6, "12345 ... !!", None, "s", 3), (10**6 + 1, some + " extra", "en", None, None), (10**6 + 2, f"{some[::-1]} {bench} joe@site.example.org", "en", "s", 1), (10**6 + 3, None, None, None, None)], docs.schema)
    docs = docs.union(planted)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts) - set(kept["language_id"]) == set() and not {10**6, 10**6 + 3} & set(kept["language_id"])
    groups = kept["language_id"]
    sets = {k: shingles(t, 5) for k, t in groups.items()}
    want = Sets(groups)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and similar(sets[a], sets[b], 80):
                want.join(a, b)
    assert set(kept["near_duplicates"]) == {k for k in groups if want.root(k) == k} and 10**6 + 1 not in kept["near_duplicates"]
    assert bench in kept["near_duplicates"][10**6 + 2] and bench not in kept["decontamination"][10**6 + 2]
    assert kept["personal_data"][10**6 + 2].endswith("[EMAIL]")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept["personal_data"])


def test_duplicate_stage_knows_rows_not_ids(spark):
    a = " ".join(f"alpha{k}" for k in range(40))
    b = " ".join(f"beta{k}" for k in range(40))
    c = " ".join(f"gamma{k}" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, a), (5, a), (5, b), (7, a + " tail"), (None, c), (None, c), (None, b), (8, ""), (9, None), (9, "  "), (9, None)]
    given = [(k, t, "en", "s", None) for k, t in rows] + [(None, "one two", "en", None, None), (None, "one two", "en", "x", None), (None, "three", None, None, 1)]
    out = [tuple(r)[:2] for r in corpus_pipeline.duplicate_stage(spark, spark.createDataFrame(given, schema), "").collect()]
    want = [(3, a), (5, b), (None, c), (8, ""), (9, None), (9, "  "), (None, "one two"), (None, "three")]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    real = docs.collect()
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    random = ["".join(rng.choice(letters + [" "] * spaces, 1000)) for spaces in (0, 5) for _ in range(5)]
    foreign = [r["text"] for r in real if r["lang"] == "es" and len(r["text"]) > 300]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä " * 2
    cyrillic = "все люди рождаются свободными и равными в своем достоинстве и правах " * 5
    known = docs.filter("lang != 'es'")
    own = [r["text"] for r in real if r["lang"] != "es"]
    texts = [(t, None) for t in [*random, finnish, cyrillic, *foreign]] + [("".join(rng.choice(letters, 1000)), "en")]
    rows = [(10**6 + k, t, lang, None, None) for k, (t, lang) in enumerate(texts)]
    rows += [(2 * 10**6 + k, t, None, None, None) for k, t in enumerate(own)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, known.union(spark.createDataFrame(rows, docs.schema)), sf).select("doc_id").collect()}
    assert {r["doc_id"] for r in real if r["lang"] != "es"} <= kept
    assert not [texts[k - 10**6] for k in kept if 10**6 <= k < 2 * 10**6] and len(foreign) > 5
    assert sum(k >= 2 * 10**6 for k in kept) >= 0.98 * len(own)


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_every_query_is_registered(spark, sf):
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert names == [f"op{k}" for k in range(1, 14)] and "pipeline" in entry.queries()


def test_digests_are_whole(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_language_id", "op3_toxicity", "op4_sharding", "op5_pii", "op8_jaccard_join", "op9_lm_scoring"):
        assert queries.QUERIES[name](spark, sf).count() == n
    assert zlib.crc32(b"") == 0
