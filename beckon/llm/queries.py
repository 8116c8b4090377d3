"""The registered query of every operator, and oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon.llm import attribution, decontamination, embeddings, filters, jaccard, langid, lines, lm, packing, pii, runs, sharding, toxicity
from beckon.llm.common import Batches, read, slices, utf8

SHARDS = 16
LM_ORDER = 3
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return decontamination.contamination_report(found, ["doc_id"]).drop("longest_match")


_OP1_LOWER = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
with d as (select doc_id, coalesce({_OP1_LOWER}, []) as w from documents),
b as (select distinct item_id, {_OP1_LOWER} as w from benchmark where len({_OP1_LOWER}) > 0),
iw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b)),
dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from iw))),
m as (select doc_id, item_id, i, dw.k from dw join iw on dw.k = iw.k and dw.s = iw.s),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by 1),
n as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join n using (doc_id)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.remainder("doc_id", 3) == 1
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (langid.remainder("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), ["doc_id"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(BYTE_VOCABULARY))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (langid.remainder("doc_id", 10) == 0).alias("held_out"))
    return lm.score(docs, order=LM_ORDER)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words with the repetition that the contract plants in one document of ten; ``h`` is the id's CRC-32."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plant(batches: Batches) -> Batches:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [b" ".join(planted(t.split(), h)) if h is not None and h % 10 == 0 else t for t, h in zip(utf8(b.column("text")), b.column("h").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    found = runs.collapse_runs(docs.mapInArrow(plant, docs.select("doc_id", "text").schema))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filters.audit(docs, read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}
OP10_SQL = """
with v as (select vec_id, embedding::double[] as e, label from embeddings),
n as (select vec_id, label, e from v where label is not null and e is not null and len(e) > 0
  and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
c as (with recursive r(vec_id, reach) as (select a, b from l union select r.vec_id, l.b from r join l on r.reach = l.a)
  select vec_id, min(reach) as reach from r group by 1),
k as (select a as vec_id, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(reach, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(reach, vec_id)) as kept
from v left join k using (vec_id) left join c using (vec_id)"""

OP11_SQL = """
with l as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos, len(ls) as n_lines from l),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
h as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5),
m as (select r, doc_id, n_lines, pos, line, keeper is not null and doc_id is distinct from keeper as gone from k left join h using (key))
select doc_id, max(n_lines)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by r, doc_id"""
OP13_SQL = """
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as ws,
  min(doc_id) over (partition by coalesce(text, '')) as least from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
d as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails from w left join l using (doc_id)),
m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by all),
f as (select unnest(range(1, 6)) as f),
o as (select [a.f, b.f, c.f, e.f, 15 - a.f - b.f - c.f - e.f] as ord from f a, f b, f c, f e where len(list_distinct([a.f, b.f, c.f, e.f])) = 4),
s as (select list_transform(ord, lambda x: chr((64 + x)::int)).array_to_string('') as filter_order, ord[:step - 1] as before, ord[step] as this, step
  from o, (select unnest(range(1, 6)) as step)),
x as (select part, filter_order, step, this, n, good, toxic, fails[this] as bad, len(list_filter(before, lambda b: fails[b])) > 0 as gone,
  len(list_filter(fails, lambda b: b)) = 1 as alone from m, s),
r as (select part, filter_order, step::int as step, this, coalesce(sum(n) filter (not bad and not gone), 0)::bigint as kept,
  coalesce(sum(n) filter (bad and not gone), 0)::bigint as removed, coalesce(sum(n) filter (bad and gone), 0)::bigint as redundant,
  coalesce(sum(n) filter (bad and alone), 0)::bigint as unique_fails, coalesce(sum(good) filter (bad and not gone), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (bad and not gone), 0)::bigint as toxic_lost from x group by part, filter_order, step, this)
select * exclude (this), sum(removed) over (partition by part, this)::bigint as shapley from r"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op10_embedding_dedup": OP10_SQL, "op11_line_dedup": OP11_SQL, "op13_filter_audit": OP13_SQL}
