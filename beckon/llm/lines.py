"""Line dedup (11), in DataFrame functions only: lines that many documents share stay in one of them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.  Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except those in the largest
id that holds them.

Long enough lines are exploded with their position and known from then on by two 64-bit hashes, so no line travels
through a shuffle.  Documents are counted per hash in two steps, first distinct (hash, id), which spreads a line that
a third of all documents hold, then per hash with map-side sums.  The lines of frequent hashes are found by two joins:
the ``HOT_KEYS`` most frequent hashes are a table of fixed size and are broadcast, and any other hash has at most that
fraction of the lines, so the shuffled join has no hot key.  Positions to drop return to the row by its id and its
text's hash; a row without any keeps its text untouched.

Edge cases: a null or empty text is one empty line and becomes empty; rows of one id are one document, and equal rows
are both kept; a row without id counts as no document and loses every frequent line that some document holds; an
empty table gives no rows; all columns are returned, and those that start with ``__line`` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import materialize

MIN_CHARS = 40
MIN_DOCS = 5
HOT_KEYS = 1000
# What is stripped at both ends of a line.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), _UPPER, _LOWER)


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, gone): positions of the lines that a row loses; rows that lose none are left out."""
    row = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    line = row.select("id", "text_hash", F.posexplode(lines_of("text")).alias("pos", "line"))
    line = line.filter(F.length("line") >= min_chars).select("id", "text_hash", "pos", line_key(F.col("line")).alias("k"))
    line = line.filter(F.length("k") >= min_chars)
    found = materialize(line.select("id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")), "line-hashes")
    held = found.filter("id is not null").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    many = held.groupBy("h1", "h2").agg(F.count("id").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= min_docs)
    many = materialize(many, "line-counts")
    # one order for both: the most frequent hashes, at most HOT_KEYS rows
    hot = many.orderBy(F.desc("docs"), "h1", "h2").limit(HOT_KEYS).select("h1", "h2", F.col("keeper").alias("hot_keeper"))
    tried = found.join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = many.join(F.broadcast(hot), ["h1", "h2"], "left_anti").select("h1", "h2", "keeper")
    rest = tried.filter("hot_keeper is null").drop("hot_keeper").join(cold, ["h1", "h2"]).select("id", "text_hash", "pos", "keeper")
    hits = tried.filter("hot_keeper is not null").select("id", "text_hash", "pos", F.col("hot_keeper").alias("keeper")).unionByName(rest)
    gone = hits.filter(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines`` (before) and ``n_dropped``; those two names are replaced."""
    clash = [c for c in docs.columns if c.startswith("__line")]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    gone = shared_lines(docs, key, text, min_chars, min_docs).select(F.col("id").alias("__line_id"), F.col("text_hash").alias("__line_hash"), F.col("gone").alias("__line_gone"))
    tagged = docs.withColumn("__line_own", F.xxhash64(text))
    same = tagged[key].eqNullSafe(gone["__line_id"]) & (tagged["__line_own"] == gone["__line_hash"])
    both = tagged.join(gone, same, "left").drop("__line_id", "__line_hash", "__line_own")
    split = both.withColumn("__lines", lines_of(text))
    # hashed set difference over positions, so that long texts stay linear
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__line_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    whole = F.col("__line_gone").isNull()
    out = split.withColumns(
        {
            text: F.when(whole, F.coalesce(F.col(text), F.lit(""))).otherwise(kept),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.when(whole, 0).otherwise(F.size("__line_gone")).cast("long"),
        }
    )
    return out.drop("__lines", "__line_gone")
