"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.  The stages call the operators of ``beckon.llm`` with their production
parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon.llm import decontamination, jaccard, langid, packing, pii
from beckon.llm.common import materialize, read
from beckon.llm.queries import WORD_VOCABULARY, tokenizer

# Near-duplicates on word shingles: five words, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
# How far from held-out text of its language (0) to random letters (1) a text may be; texts that mix languages reach
# 0.28 on the given tables.  A label of a learned language vouches for more.
MOST_DISTANCE = 0.3
MOST_LABELLED_DISTANCE = 0.6
MAX_COVERAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (2): texts without letters, and texts in no learned language, go; a null label is filled in."""
    model = langid.fit(docs)
    judged = langid.identify(docs, model, prefix="__")
    most = F.when(F.col("lang").isin(model.names), MOST_LABELLED_DISTANCE).otherwise(MOST_DISTANCE)
    kept = judged.filter((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__distance") <= most))
    return kept.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (8): of every group of similar documents the one with the least id stays.

    A row is known by its id and a 64-bit hash of all its columns, so texts that share an id are documents of their own;
    rows equal in every column are one document.  Rows without an id come last in a group; documents without words
    group with nothing.
    """
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64(*docs.columns).alias("row"))
    keyed = docs.withColumn("__key", row)
    groups = jaccard.similar_groups(keyed, key="__key", width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    gone = groups.filter("__key != component_id").select("__key").distinct()
    return keyed.join(gone, "__key", "left_anti").dropDuplicates(["__key"]).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (1): passages of test items are cut out; documents that mostly consist of them go."""
    return counted(decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), max_coverage=MAX_COVERAGE))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (5): every span becomes its kind in brackets."""
    return counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (6): all tokens into windows of mixed sources."""
    return packing.pack(docs, tokenizer(WORD_VOCABULARY))


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("personal_data", privacy_stage),
    ("packing", packing_stage),
]

# SQL has no cross-parsing, no bootstrapped patterns and no tokenizer: the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
