"""Personal data (5): bootstrapped contextual extraction, in DataFrame functions only.

Seeds are entities of four fixed forms (e-mail, IP address, payment card, phone), found leftmost and without
overlap for each kind.  Every seed, and every white-space token with a digit, occurs in contexts: the word before
it, the word after it, and both.  Contexts are lexical patterns; patterns and instances form a graph.  In each
round a pattern's confidence for a kind is the share of its distinct instances that are of the kind (seeds count
one, others their score), smoothed by one; an instance's score is the best confidence among its patterns with
enough seeds.  Instances that reach ``CONFIDENCE`` are new identifiers of that kind; they extend the seeds' spans
and never replace them.

Positions are code points, ends exclusive.  A match's place follows from the lengths of what lies between
matches, summed in blocks, so texts with very many matches stay linear.  Patterns that cannot fail late are
possessive, and a match may start only where no longer one could, so long runs are scanned once.

Edge cases: a null text is empty; texts without entities give empty lists; repeated rows are treated each; an
empty table gives no rows; other columns are carried along by ``redact`` whatever their names, but for the
reserved names that start with two underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
LEAST_SEEDS = 3
ROUNDS = 3
# The forms of the four kinds, and tokens with a digit; ``\G`` is the end of the match before.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9]*+[0-9]\S*+",
}
HINTS = {"email": "instr({0}, '@') > 0", "ip": "{0} rlike '[0-9][.][0-9]'", "card": "{0} rlike '[0-9]'", "phone": "instr({0}, '+') > 0", "token": "{0} rlike '[0-9]'"}
_LUHN = "aggregate(sequence(1, length({0})), 0, (a, i) -> a + case when i % 2 = 1 then int(substr(reverse({0}), i, 1)) when int(substr(reverse({0}), i, 1)) < 5 then 2 * int(substr(reverse({0}), i, 1)) else 2 * int(substr(reverse({0}), i, 1)) - 9 end) % 10 = 0"
_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and int(concat('0', substr(trim(LEADING '0' FROM p), 1, 4))) <= 255)",
    "card": f"case when length({_DIGITS}) between 16 and 19 then {_LUHN.format(_DIGITS)} else false end",
    "phone": f"length({_DIGITS}) between 8 and 15",
    "token": "true",
}
SPAN = "struct<start:int,stop:int,t:string,left:string,right:string>"
_BLOCK = 256


def _word(text: str, last: bool) -> str:
    """The last (or first) word next to a match, lower-cased and bounded."""
    near = f"translate({'right' if last else 'left'}({text}, 48), '\\n\\t\\r', '   ')"
    return f"lower(substring_index({'rtrim' if last else 'ltrim'}({near}), ' ', {-1 if last else 1}))"


def _spans(kind: str) -> Column:
    """Spans of the matches ``__m_<kind>`` and the parts around them ``__s_<kind>``, with the words next to them."""
    m, s = f"__m_{kind}", f"__s_{kind}"
    steps = f"transform({m}, (t, i) -> struct(length({s}[i]) as gap, length(t) as n, t as t, {_word(f'{s}[i]', True)} as left, {_word(f'{s}[i + 1]', False)} as right))"
    part = f"slice(d, c * {_BLOCK} + 1, {_BLOCK})"
    start = "a.pos + x.gap"
    walk = (
        f"aggregate({part}, struct(aggregate(slice(sums, 1, c), 0, (u, v) -> u + v) as pos, cast(array() as array<{SPAN}>) as out), "
        f"(a, x) -> struct({start} + x.n as pos, array_append(a.out, struct({start} as start, {start} + x.n as stop, x.t as t, x.left as left, x.right as right)) as out)).out"
    )
    chunks = f"sequence(0, (size(d) - 1) div {_BLOCK})"
    sums = f"transform({chunks}, c -> aggregate({part}, 0, (u, x) -> u + x.gap + x.n))"
    # bind d and sums by lambdas over one-element arrays
    whole = f"transform(array({steps}), d -> transform(array({sums}), sums -> flatten(transform({chunks}, c -> {walk})))[0])[0]"
    return F.expr(f"case when size({m}) > 0 then filter({whole}, x -> {VALID[kind]}) else cast(array() as array<{SPAN}>) end")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__email`` ... ``__phone`` (valid entities) and ``__token`` (tokens with a digit)."""
    body = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    cut = {}
    for kind, form in FORMS.items():
        hint = F.expr(HINTS[kind].format("__text"))
        cut[f"__m_{kind}"] = F.when(hint, F.regexp_extract_all("__text", F.lit(form), 0)).otherwise(none)
        cut[f"__s_{kind}"] = F.when(hint, F.split("__text", form, -1)).otherwise(none)
    found = body.withColumns(cut)
    return found.select(*docs.columns, *[_spans(k).alias(f"__{k}") for k in FORMS])


def _core(token: str) -> str:
    return f"regexp_replace(lower({token}), '^[^0-9a-z+]+|[^0-9a-z]+$', '')"


def instance_graph(spans: DataFrame) -> DataFrame:
    """Distinct edges (pattern, instance) and, for seeds, the instance's kind."""
    each = [spans.select(F.lit(None if k == "token" else k).cast("string").alias("kind"), F.explode(f"__{k}").alias("x")) for k in FORMS]
    seen = reduce(DataFrame.union, each).select("kind", F.expr(_core("x.t")).alias("instance"), "x.left", "x.right")
    patterns = F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"), F.concat_ws(" ", F.lit("b:"), "left", "right"))
    edges = seen.filter("instance != ''").select("kind", "instance", F.explode(patterns).alias("pattern"))
    return edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))


def discover(edges: DataFrame) -> DataFrame:
    """(instance, kind, score) of new identifiers: instances no pattern form knows, in trusted contexts."""
    seeds = edges.filter("kind is not null").select("instance", "kind").groupBy("instance").agg(F.min("kind").alias("known"))
    graph = materialize(edges.select("pattern", "instance").join(seeds, "instance", "left"), "pii-graph")
    scores: DataFrame | None = None
    for _ in range(ROUNDS):
        rated = graph.withColumn("kind", F.col("known")).withColumn("score", F.lit(1.0))
        if scores is not None:
            rated = graph.join(scores, "instance", "left").select("pattern", "instance", "known", F.coalesce("known", "new_kind").alias("kind"), F.when(F.col("known").isNotNull(), 1.0).otherwise(F.coalesce("new_score", F.lit(0.0))).alias("score"))
        of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
        seeds_of = lambda k: F.count(F.when(F.col("known") == k, 1))
        totals = rated.groupBy("pattern").agg(F.count("*").alias("n"), *[of(k).alias(f"s_{k}") for k in KINDS], *[seeds_of(k).alias(f"c_{k}") for k in KINDS])
        options = F.array(*[F.struct((F.col(f"s_{k}") / (F.col("n") + 1)).alias("confidence"), F.lit(k).alias("kind"), F.col(f"c_{k}").alias("seeds")) for k in KINDS])
        best = totals.select("pattern", F.array_max(F.filter(options, lambda o: o["seeds"] >= LEAST_SEEDS)).alias("best")).filter(F.col("best.confidence") >= CONFIDENCE)
        reached = graph.filter("known is null").join(best, "pattern").groupBy("instance").agg(F.max("best").alias("best"))
        scores = materialize(reached.select("instance", F.col("best.kind").alias("new_kind"), F.col("best.confidence").alias("new_score")), "pii-scores")
    return scores.select("instance", F.col("new_kind").alias("kind"), F.col("new_score").alias("score"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base spans ``__email`` ... ``__phone`` and ``__extra``: spans (kind, start, stop) the contexts add."""
    spans = materialize(base_spans(docs, text).withColumn("__row", F.monotonically_increasing_id()), "pii-spans")
    found = discover(instance_graph(spans))
    tokens = spans.select("__row", F.explode("__token").alias("x")).select("__row", F.expr(_core("x.t")).alias("instance"), (F.col("x.start") + F.expr("length(regexp_extract(x.t, '^[^0-9A-Za-z+]*', 0))")).alias("start"), F.expr(f"length({_core('x.t')})").alias("n"))
    hits = tokens.join(found, "instance").select("__row", F.struct("kind", "start", (F.col("start") + F.col("n")).alias("stop")).alias("x"))
    extra = materialize(hits.groupBy("__row").agg(F.sort_array(F.collect_set("x")).alias("__extra")), "pii-extra")
    base = "concat(" + ", ".join(f"__{k}" for k in KINDS) + ")"
    free = F.expr(f"filter(coalesce(__extra, cast(array() as array<struct<kind:string,start:int,stop:int>>)), e -> not exists({base}, b -> b.start < e.stop and b.stop > e.start))")
    return spans.drop("__token").join(extra, "__row", "left").withColumn("__extra", free).drop("__row")


def _labels(kind: str, extra: bool) -> str:
    own = f"transform(__{kind}, b -> struct(b.start as start, b.stop as stop))"
    more = f"transform(filter(__extra, e -> e.kind = '{kind}'), e -> struct(e.start as start, e.stop as stop))"
    both = f"array_sort(concat({own}, {more}))" if extra else own
    return f"transform({both}, b -> concat('{kind}:', b.start, ':', b.stop))"


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    listed = {extra: F.expr("array_join(concat(" + ", ".join(_labels(k, extra) for k in KINDS) + "), ',')") for extra in (False, True)}
    return found.select(*keys, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed[False].cast("binary"), 256).alias("base_sha256"), listed[True].alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    found = find(docs, text)
    base = [f"transform(__{k}, b -> struct(b.start as start, b.stop as stop, '{k}' as kind))" for k in KINDS]
    spans = f"array_sort(concat({', '.join(base)}, transform(__extra, e -> struct(e.start as start, e.stop as stop, e.kind as kind))))"
    walk = (
        "aggregate(__spans, struct(0 as pos, cast(array() as array<string>) as out), (a, x) -> "
        "if(x.start < a.pos, struct(greatest(a.pos, x.stop) as pos, a.out as out), "
        "struct(x.stop as pos, concat(a.out, array(substring(__body, a.pos + 1, x.start - a.pos), concat('[', upper(x.kind), ']'))) as out)), "
        "a -> concat(array_join(a.out, ''), substring(__body, a.pos + 1)))"
    )
    whole = found.withColumn("__spans", F.expr(spans)).withColumn("__body", F.col(text))
    clean = F.when(F.size("__spans") > 0, F.expr(walk)).otherwise(F.col("__body"))
    return whole.withColumn(text, clean).select(*docs.columns)
