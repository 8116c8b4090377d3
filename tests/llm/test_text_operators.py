"""Decontamination, language ID, toxicity, sharding, personal data, packing and token counts on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beckon.llm import attribution, decontamination, langid, packing, pii, sharding, toxicity
from beckon.llm.automaton import SuffixAutomaton
from beckon.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, tokenizer
from beckon.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, score string"
LONG = " ".join(f"w{k % 997}" for k in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(k, t, None, s, None, "x", "y") for k, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", None), (3, "  \n", "a"), (4, "one", "b"), (None, "null id text here", "a"), (6, "same words again", "a"), (6, "same words again", "a"), (7, LONG, "a")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4), st.lists(st.integers(0, 3), max_size=20))
def test_automaton_finds_longest_suffixes(items, text):
    sam = SuffixAutomaton()
    for item in items:
        sam.add(item)
    known = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a, len(i) + 1)}
    for at, size in enumerate(sam.match(text)[1], 1):
        assert size == max((k for k in range(at + 1) if tuple(text[at - k : at]) in known), default=0)


def brute_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for name, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").lower())
        size = min(window, len(own))
        wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wins:
                hit |= set(range(k, k + size))
                found.add(str(name) if name is not None else "null")
    return len(words), len(hit), ",".join(sorted(found))


BENCH = [(1, "the quick brown fox jumps over the lazy dog and then sleeps all day"), (2, "short item"), (10, "short item"), (3, None), (4, " "), (None, "ünïcode wörds!"), (1, "the quick brown fox jumps over the lazy dog and then sleeps all day")]


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_contamination_matches_brute_force(spark, block_words):
    rows = EDGE + [(8, "x THE quick, brown fox jumps over the lazy dog and THEN sleeps y", "a"), (9, "a short item, short item", "a"), (10, "Ünïcode ünïcode wörds", "b"), (11, "quick brown fox jumps over the lazy dog and", "b")]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontamination.find_contamination(docs(spark, rows), bench, block_words=block_words)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination_report(found, ["doc_id"]).collect())
    want = Counter()
    for k, t, _ in rows:
        n, hit, ids = brute_hits(t, BENCH)
        want[(k, n, hit, hashlib.sha256(ids.encode()).hexdigest(), hit > 0)] += 1
    assert got == want


def test_decontaminate_cuts_spans_and_keeps_the_rest(spark):
    passage = "the quick brown fox jumps over the lazy dog and"
    clean = "nothing of the kind stands here at all"
    halves = f"{clean} the quick brown fox jumps {passage} over the lazy dog and {clean} {clean} {clean}"
    rows = [(1, f"{clean}. {passage}; {clean}", "a"), (2, passage, "a"), (3, clean, "a"), (4, None, "a"), (5, halves, "a")]
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    out = decontamination.decontaminate(docs(spark, rows), bench)
    assert out.columns == docs(spark, rows).columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == {1, 3, 4, 5} and got[3] == clean and got[4] is None
    assert got[1] == f"{clean}. ; {clean}" and brute_hits(got[5], BENCH[:1])[1] == 0


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontamination.find_contamination(docs(spark, []), bench).count() == 0
    found = decontamination.find_contamination(docs(spark, EDGE), bench.limit(0))
    assert not any(r["contaminated"] for r in decontamination.contamination_report(found, ["doc_id"]).collect())


def test_phrases_match_a_plain_parse():
    model = langid.build({"x": ["abra cadabra abracadabra", "bra"], "y": ["cad dac cadd"]})
    for text in ["abracadabra", "zzz abra", "", "Cad! dac 12 dac", "é"]:
        codes = model.symbols(text)
        got = model.phrases([codes])[0]
        for k, name in enumerate(model.names):
            sample = {"x": ["abra cadabra abracadabra", "bra"], "y": ["cad dac cadd"]}[name]
            parts = [model.symbols(s).tolist() for s in sample]
            known = {tuple(p[a:b]) for p in parts for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
            own, phrases, phrase = codes.tolist(), 1, ()
            for c in own:
                if c != langid.SYMBOLS - 1 and (*phrase, c) in known:
                    phrase = (*phrase, c)
                else:
                    phrases += 1
                    phrase = (c,) if (c,) in known else ()
            assert got[k] == (phrases if own else 0)


def test_language_of_held_out_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", langid.remainder("doc_id", 4) == 2)
    model = langid.fit(rows.filter("not held"))
    got = langid.identify(rows.select("doc_id", "text", "lang", "held"), model).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_large_scripts(spark):
    """Three languages of the same 900 Han letters in other pairs, one of Hangul and one of Latin letters."""
    rng = np.random.default_rng(6)
    words = {"en": ["the", "cat", "and", "dog", "house", "green", "river", "walks"], "ko": ["".join(chr(0xAC00 + int(x)) for x in rng.integers(0, 3000, 2)) for _ in range(400)]}
    for name in ("xa", "xb", "xc"):
        words[name] = ["".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 900, 2)) for _ in range(400)]
    rows = []
    for name, own in words.items():
        rows += [(len(rows) + k, " ".join(rng.choice(own, 60)), name) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame.filter("doc_id % 4 > 0"))
    letters = sorted({c for k, t, _ in rows for c in t if k % 4 and c.isalpha()})
    codes = [tuple(model.symbols(c).tolist()) for c in letters]
    assert (langid.SYMBOLS - 1,) not in codes and len(set(codes)) == len(letters) > 1000
    got = langid.identify(frame, model).filter("doc_id % 4 = 0").collect()
    assert len(got) == 50 and all(r["lang"] == r["lang_pred"] for r in got)


def test_language_edges(spark):
    model = langid.build({"en": ["the cat and the dog"], "de": ["der hund und die katze"]})
    out = langid.identify(docs(spark, EDGE + [(20, "123 ...", "a"), (21, "die katze und der hund", "a")]), model, prefix="p_")
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["p_lang_pred"] == got[2]["p_lang_pred"] == got[20]["p_lang_pred"] == "und" and got[21]["p_lang_pred"] == "de"
    assert out.columns[:7] == docs(spark, []).columns
    empty = langid.fit(docs(spark, EDGE))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, EDGE).drop("score"), empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(docs(spark, EDGE), model)


def test_toxicity_learns_and_leaves_clean_rows(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    bad = ["grumpf" + s for s in ("a", "el", "ion")]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        words = [word() for _ in range(30)] + ([str(rng.choice(bad)), "idiot"] if toxic else [])
        rows.append((k, " ".join(words), "a"))
        labels.append((k, int(toxic)))
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), known)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, rows).drop("score"), model).collect() if r["doc_id"] % 3 == 0}
    assert all(got[k] == dict(labels)[k] for k in got)
    fresh = toxicity.score(docs(spark, [(1, "what grumpfly thing", "a"), (2, None, "a"), (3, "", "a"), (4, "quiet text", "a")]).drop("score"), model)
    by = {r["doc_id"]: r["score"] for r in fresh.collect()}
    assert by[1] > by[4] and by[2] == by[3] and all(0 <= v <= 1 for v in by.values())


def plain_label_model(votes, labels, rounds=25, trust=0.95):
    """Expectation maximisation over lists, one row and one voter at a time."""
    n, m = len(votes), len(votes[0])
    base = min(0.99, max(0.01, sum(labels) / n))
    post = [trust if y else 1 - trust for y in labels]
    share = [1.0] * m
    for step in range(rounds):
        on, off = [], []
        for j in range(m):
            for out, weight in ((on, post), (off, [1 - p for p in post])):
                rate = min(1.0, sum(w for w, v in zip(weight, votes, strict=True) if v[j]) / sum(weight))
                out.append((rate * n + 0.5) / (n + 1))
        if step == rounds // 2:
            rest = [[votes[i][j] - post[i] * on[j] - (1 - post[i]) * off[j] for i in range(n)] for j in range(m)]
            size = [math.sqrt(sum(x * x for x in r)) + 1e-9 for r in rest]
            for j in range(m):
                share[j] = 1 / max(1.0, sum(abs(sum(x * y for x, y in zip(rest[j], rest[k], strict=True)) / size[j] / size[k]) for k in range(m)))
        for i in range(n):
            odds = math.log(base / (1 - base)) + (1 if labels[i] else -1) * math.log(trust / (1 - trust))
            odds += sum(math.log(on[j] / off[j]) * share[j] for j in range(m) if votes[i][j])
            post[i] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return post, share


@pytest.mark.parametrize("seed", range(4))
def test_label_model_matches_plain_expectation_maximisation(seed):
    rng = np.random.default_rng(seed)
    truth = rng.random(80) < 0.4
    votes = np.stack([rng.random(80) < np.where(truth, a, b) for a, b in ((0.9, 0.05), (0.6, 0.1), (0.5, 0.4), (0.3, 0.0))], 1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1).astype(np.uint8)  # a voter that copies another
    labels = (truth ^ (rng.random(80) < 0.05)).astype(int)
    got, share = toxicity.label_model(votes, labels)
    want, shares = plain_label_model(votes.tolist(), labels.tolist())
    assert np.allclose(got, want, atol=1e-9) and np.allclose(share, shares, atol=1e-9)
    assert share[0] < 0.6 and share[4] < 0.6


def test_toxicity_of_repeated_tied_and_very_long_texts(spark):
    model = toxicity.ToxicityModel(["idiot", "grum*"], np.array([3.0, 3.0]), -2.0)
    long = "calm words " * 200_000
    rows = [(1, "you idiot", "a"), (1, "you idiot", "a"), (2, "a grumble", "a"), (3, long + "IDIOT", "a"), (4, long, "a"), (5, "", "a"), (6, None, None), (None, "idiot idiot", "b")]
    got = sorted(((r["doc_id"] or 0, r["score"], r["predicted"]) for r in toxicity.score(docs(spark, rows).drop("score"), model).collect()))
    hit, miss = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(2))
    assert [(k, p) for k, _, p in got] == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0)]
    assert np.allclose([x for _, x, _ in got], [hit] * 5 + [miss] * 3)


def test_toxicity_without_labels(spark):
    model = toxicity.fit(docs(spark, EDGE), spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(docs(spark, EDGE + [(9, "you idiot", "a")]), model, prefix="t_")
    assert {r["doc_id"]: r["t_predicted"] for r in out.collect() if r["doc_id"] in (1, 9)} == {1: 0, 9: 1}


def test_correlated_voters_count_less():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 800)
    one, two = (np.where(rng.random(800) < 0.8, y, 1 - y) for _ in range(2))
    _, share = toxicity.label_model(np.stack([one, one, one, two], 1).astype(np.uint8), y)
    assert share[0] < 0.5 < share[3]


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    before = sharding.jump_hash(keys, 1)
    assert not before.any()
    for n in range(2, 20):
        now = sharding.jump_hash(keys, n)
        moved = now != before
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.03
        before = now


def test_shards_edges(spark):
    got = sharding.shard_rows(docs(spark, EDGE + [(k, f"text {k % 5}", "a") for k in range(100, 400)]).repartition(5), 7).collect()
    assert len(got) == len(EDGE) + 300
    for shard in range(7):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got)
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["size"], one["text_crc32"]) == (1, 0)
    same = {(r["shard"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 6}
    assert same == {(next(iter(same))[0], 17, zlib.crc32(b"same words again"))}
    assert sharding.shard_rows(docs(spark, []), 4).count() == 0


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(5)
    pieces = ["a@b.c", "+d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "007.08.9.10", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "x", " ", "é😀", "1", "-", "\n", "9" * 25, "0000000000000000", "a.b%c@d-e.f-g.h"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(300)]
    texts += ["9" * 5000, "a" * 5000, "1." * 3000, "+1" + " " * 3000, "x 1.2.3.4" * 900, "a@" + "b." * 3000 + "c", None, ""]
    rows = docs(spark, [(k, t, "a") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii.report(pii.find(rows), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[k]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
        assert got[k]["n_ip"] == want.count("ip:")


def test_contexts_discover_unseen_identifiers(spark):
    cards = [n for n in (f"41111111111{k:05d}" for k in range(200)) if luhn(n)][:12]
    rows = [(k, f"please bill visa {c} today", "a") for k, c in enumerate(cards)] + [(50, "please bill visa 4111-22XX-1 today", "a"), (51, "room 12 has 4000 seats", "a")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(docs(spark, rows)), ["doc_id"]).collect()}
    assert got[50] == "card:17:28" and got[51] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows)).collect()}
    assert clean[0] == "please bill visa [CARD] today" and clean[50] == "please bill visa [CARD] today" and clean[51] == rows[-1][1]


def test_redaction_edges(spark):
    rows = docs(spark, EDGE + [(30, "mail é a@b.co, ip 10.0.0.1 end", "a")])
    out = pii.redact(rows)
    assert out.columns == rows.columns and out.count() == len(EDGE) + 1
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[30] == "mail é [EMAIL], ip [IP] end" and got[1] is None and got[7] == LONG
    assert pii.report(pii.find(docs(spark, [])), ["doc_id"]).count() == 0


ODD = ["naïve café — ok", "a\x85b\xa0c", "İstanbul", "x<|endoftext|>y", "don't we'LL 'tis", "", " \t\n", "日本語 text", "a\x1cb", "12½ 3² x_y", "\n\nTwo  lines\n"]


@pytest.mark.parametrize("name", [WORD_VOCABULARY, BYTE_VOCABULARY])
def test_ids_and_spans_equal_the_tokenizer(spark, sf, name):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ODD
    own = encoder(tokenizer(name))
    for text, ids, (a, b) in zip(texts, own.ids(texts), own.spans(texts), strict=True):
        want = own.tokenizer.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [tuple(o) for o in want.offsets]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(1, 9)), min_size=1, max_size=6), st.sampled_from([4, 7, 16]))
def test_schedule_is_the_round_robin_it_claims(queues, size):
    totals, weights = (np.array(x) for x in zip(*queues, strict=True))
    schedule = packing.Schedule(totals, weights.astype(float), size)
    w = schedule.weights
    turns = sorted(((2 * p + 1) / w[q], q, p) for q in range(len(totals)) for p in range(totals[q]))
    turns = sorted(turns, key=lambda t: (t[0], t[1])) if len({t[0] for t in turns}) == len(turns) else None
    for q in range(len(totals)):
        ranks = schedule.rank(q, np.arange(totals[q]))
        if turns:
            assert ranks.tolist() == [k for k, t in enumerate(turns) if t[1] == q]
        for k in range(-(-int(totals.sum()) // size) + 1):
            assert schedule.served(q, np.array([k]))[0] == (ranks < k * size).sum()


@pytest.mark.parametrize("totals", [[200_000_000, 1_000], [3_000_000, 30], [2_000_000_000, 7, 50_000]])
def test_small_queues_last_as_long_as_large_ones(totals):
    totals = np.array(totals)
    schedule = packing.Schedule(totals, totals / totals.sum())
    last = int(totals.sum()) // packing.WINDOW
    windows = np.unique(np.linspace(0, last, 200).astype(np.int64))
    served = np.stack([schedule.served(q, windows) for q in range(len(totals))])
    assert (np.abs(served - windows * packing.WINDOW * (totals / totals.sum())[:, None]) < 2).all()
    assert served.sum(axis=0).tolist() == (windows * packing.WINDOW).tolist()


def test_packing_round_trip(spark):
    rows = EDGE + [(k, " ".join(f"word{k} and {j}" for j in range(k % 40)), f"s{k % 3}") for k in range(100, 220)]
    got = packing.pack(docs(spark, rows).repartition(4), tokenizer(WORD_VOCABULARY), size=256).collect()
    tok = encoder(tokenizer(WORD_VOCABULARY)).tokenizer
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [1] for k, t, _ in rows}
    seqs = {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(ids[k]) for k, _, _ in rows)
    assert sorted(seqs) == list(range(len(seqs)))
    for k, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or k == max(seqs)
    assert packing.pack(docs(spark, []), tokenizer(WORD_VOCABULARY)).count() == 0


def test_packing_keeps_target_proportions(spark):
    rows = [(k, "lorem ipsum dolor sit amet " * 40, "ab"[k % 2]) for k in range(40)]
    got = packing.pack(docs(spark, rows), tokenizer(WORD_VOCABULARY), targets={"a": 3.0, "b": 1.0}, size=400).collect()
    share = Counter()
    for r in got:
        share[(r["sequence_id"], r["queue"])] += r["length"]
    assert all(abs(share[(k, "a")] - 300) <= 1 for k in range(8))
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), tokenizer(WORD_VOCABULARY), targets={"a": 0.0})


@pytest.mark.parametrize("rule", ["start", "end", "middle"])
def test_attribution_matches_brute_force(spark, rule):
    text = "Hello wörld, this is\n\na  small téxt 1234567 for sections."
    sections = [("all", 0, len(text)), ("cut", 2, 9), ("tail", 30, 999), ("none", 5, 5), ("low", None, 4)]
    kind = "doc_id long, text string, sections array<struct<name:string,start:int,stop:int>>, extra string"
    rows = spark.createDataFrame([(1, text, sections, "e"), (2, None, sections, None), (3, text, None, None), (4, text, [], None), (1, text, sections, "e")], kind)
    got = attribution.attribute_tokens(rows, tokenizer(BYTE_VOCABULARY), rule=rule, sections="sections").collect()
    offsets = encoder(tokenizer(BYTE_VOCABULARY)).tokenizer.encode(text, add_special_tokens=False).offsets
    anchor = {"start": lambda a, b: a, "end": lambda a, b: b - 1, "middle": lambda a, b: (a + b - 1) // 2}[rule]
    for name, a, b in sections:
        a, b = a or 0, min(b, len(text))
        own = [r for r in got if r["doc_id"] == 1 and r["section"] == name]
        assert [r["n_tokens"] for r in own] == [sum(a <= anchor(*o) < b for o in offsets)] * 2
        assert own[0]["n_crossing"] == sum(o[0] < a < o[1] or o[0] < b < o[1] for o in offsets)
    assert [(r["section"], r["n_tokens"]) for r in got if r["doc_id"] in (3, 4)] == [(None, len(offsets))] * 2
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] == 2)


def test_attribution_to_lines_and_attached_sections(spark):
    rows = docs(spark, EDGE)
    got = attribution.attribute_tokens(rows, tokenizer(BYTE_VOCABULARY)).collect()
    for k in (3, 4, 7):
        own = [r for r in got if r["doc_id"] == k]
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]
    spans = spark.createDataFrame([(4, "x", 0, 2), (4, "y", 1, 3)], "doc_id long, name string, start int, stop int")
    joined = attribution.attach_sections(rows.select("doc_id", "text"), spans, "doc_id")
    got = attribution.attribute_tokens(joined, tokenizer(BYTE_VOCABULARY), sections="sections").filter("doc_id = 4").collect()
    assert [r["section"] for r in got][:2] == ["x", "y"]
    assert attribution.attribute_tokens(rows.limit(0), tokenizer(BYTE_VOCABULARY)).count() == 0


def test_word_hashes_take_little_memory_and_do_not_depend_on_pieces(monkeypatch):
    import random
    import tracemalloc

    from beckon.llm import common

    rng = random.Random(3)
    texts = [" ".join(f"W{rng.randrange(500)}é" for _ in range(rng.choice([0, 3, 400, 90_000]))).encode() for _ in range(12)] + [b"x" * 700_000 + b" y\n z", b""]
    common._POWERS.clear()
    tracemalloc.start()
    hashes, counts = common.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(common, "_PIECE", 1 << 12)
    again = common.word_hashes(texts)
    assert (again[0] == hashes).all() and (again[1] == counts).all()
    common._POWERS.clear()
    long = b"some words " * 400_000
    tracemalloc.start()
    monkeypatch.undo()
    common.word_hashes([long])
    assert tracemalloc.get_traced_memory()[1] < 32e6, (peak, tracemalloc.get_traced_memory())
    tracemalloc.stop()


def test_pairs_of_near_copies_come_in_bounded_parts():
    import numpy as np

    from beckon.llm import jaccard

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 62, 40).astype(np.uint64))
    sets = [np.sort(np.append(base, np.uint64(k))) for k in range(700)]
    everyone = np.arange(700)
    parts = list(jaccard.candidates([jaccard.signature(x) for x in sets], np.full(700, 41), everyone, everyone, everyone, 85))
    pairs = {frozenset(p) for a, b in parts for p in zip(a.tolist(), b.tolist())}
    assert len(pairs) == sum(len(a) for a, _ in parts) == 700 * 699 // 2
    assert max(len(a) for a, _ in parts) <= jaccard.STEP * jaccard.FAN**2
