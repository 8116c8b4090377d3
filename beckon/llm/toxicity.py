"""Toxicity (3): weak supervision.

Many voters look at a text: lexicon words, and patterns (words that begin with certain letters).  Fixed seed
words always vote; the others are mined from a bounded sample of labelled rows.  A generative label model
with a latent class takes the votes of the sample, and the noisy labels as one voter more, and estimates by
expectation maximisation how often each voter fires for either class (a silent voter abstains).  Correlations: voters that still move
together within a class would count one piece of evidence twice, so each voter's evidence is divided by the
summed correlation with its fellows.  A linear classifier over the voters is then trained on the posterior
labels, and alone scores texts.

Edge cases: a null or empty text and one without words gets the bias score; null labels and texts teach
nothing; repeated and nearly repeated texts teach once; without labelled rows the seed words alone score; the
sample is bounded by ``SAMPLE_ROWS`` rows a class and ``ROW_CHARS`` characters a row, the voters by
``MAX_VOTERS``; other columns are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.llm.common import Batches, slices, utf8

# Seed lexicon of plain insults.
SEED_WORDS = ["idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "disgusting", "worthless", "clown"]
PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 4000
ROW_CHARS = 20_000
MAX_VOTERS = 400
LEAST_SUPPORT = 5
LEAST_SHARE = 0.01
LEAST_ODDS = 12.0
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_BUCKETS = 1 << 20


def signs(text: str) -> set[str]:
    """What voters can fire on: the text's words, and their beginnings marked by a star."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for k in PREFIXES:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


@dataclass
class ToxicityModel:
    voters: list[str]
    weights: np.ndarray
    bias: float

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(votes @ self.weights + self.bias, -40, 40)))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, trust: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of the toxic class by row, evidence share of each voter) from a latent two-class model.

    ``labels`` are noisy: they vote with the fixed accuracy ``trust``.
    """
    x = votes.astype(float)
    base = np.clip(labels.mean(), 0.01, 0.99)
    gold = np.where(labels == 1, np.log(trust / (1 - trust)), -np.log(trust / (1 - trust)))
    post = np.where(labels == 1, trust, 1 - trust)
    share = np.ones(x.shape[1])
    for step in range(rounds):
        fires = [np.clip((x * w[:, None]).sum(0) / w.sum(), 0, 1) for w in (post, 1 - post)]
        on, off = ((f * len(x) + 0.5) / (len(x) + 1.0) for f in fires)
        if step == rounds // 2 and x.shape[1]:  # what moves together within a class is one piece of evidence
            rest = x - post[:, None] * on - (1 - post)[:, None] * off
            size = np.sqrt((rest**2).sum(0)) + 1e-9
            share = 1.0 / np.maximum(1.0, np.abs((rest / size).T @ (rest / size)).sum(0))
        odds = x @ (np.log(on / off) * share) + gold + np.log(base / (1 - base))
        post = 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))
    return post, share


def linear_classifier(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels by Newton steps."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], axis=1).astype(float)
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(curve, x.T @ (weight * (target - p)) - hold * w)
        w += step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from a sample of at most ``SAMPLE_ROWS`` rows of each class, drawn by a hash of the key."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)").distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = [F.lit(max(1, min(_BUCKETS, SAMPLE_ROWS * _BUCKETS // max(1, counts.get(y, 0))))) for y in (0, 1)]
    drawn = known.filter(F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(F.col(key).alias("key"), F.substring(text, 1, ROW_CHARS).alias("text")).join(F.broadcast(drawn), "key")  # about 2 * SAMPLE_ROWS keys

    def reduce(batches: Batches) -> Batches:
        """Least word-pair hash and signs of each row: near copies mostly share the first."""
        for b in batches:
            out = []
            for y, body in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = _WORD.findall((body or "").lower())
                out.append((y, min((crc32(f"{u} {v}".encode()) for u, v in zip(words, words[1:])), default=0), sorted(signs(body or ""))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["y", "mark", "signs"])

    sample = rows.select("y", "text").mapInArrow(reduce, "y int, mark long, signs array<string>").dropDuplicates(["y", "mark"]).persist()
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    voters = list(SEED_WORDS)
    if sizes.get(1) and sizes.get(0):
        n1, n0 = sizes[1], sizes[0]
        by_sign = sample.select("y", F.explode("signs").alias("sign")).groupBy("sign").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        odds = ((F.col("a") + 0.5) / n1) / ((F.col("b") + 0.5) / n0)
        found = by_sign.filter(F.col("a") >= max(LEAST_SUPPORT, LEAST_SHARE * n1)).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
        best = found.orderBy(F.desc(F.col("a") * F.log("odds")), "sign").limit(MAX_VOTERS).collect()
        voters += [r["sign"] for r in best if r["sign"] not in set(SEED_WORDS)]
    place = {v: k for k, v in enumerate(voters)}
    wanted = spark.createDataFrame([(voters,)], "voters array<string>")
    votes, y = [], []
    for r in sample.crossJoin(F.broadcast(wanted)).select("y", F.array_intersect("signs", "voters").alias("signs")).collect():
        row = np.zeros(len(voters), dtype=np.uint8)
        row[[place[s] for s in r["signs"]]] = 1
        votes.append(row)
        y.append(r["y"])
    sample.unpersist()
    if len(set(y)) < 2:  # nothing to learn from: each seed word alone is decisive
        return ToxicityModel(voters, np.full(len(voters), 3.0), -2.0)
    x, y = np.stack(votes), np.array(y)
    rate = counts[1] / (counts[0] + counts[1])
    post, _ = label_model(x, y)
    # the sample holds about as many rows of either class; the table does not
    clean = (1 - rate) / rate * y.sum() / (len(y) - y.sum())
    weights, bias = linear_classifier(x, post, np.where(y == 1, 1.0, clean))
    return ToxicityModel(voters, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), names after ``prefix``."""
    names = [f"{prefix}score", f"{prefix}predicted"]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(clash)}; pass a prefix")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Batches) -> Batches:
        own = shared.value
        place = {v: k for k, v in enumerate(own.voters)}
        whole_words = {v for v in own.voters if not v.endswith("*")}
        begins = [(k, {v for v in own.voters if v.endswith("*") and len(v) == k + 1}) for k in PREFIXES]
        begins = [(k, {v[:-1] for v in known}) for k, known in begins if known]
        for whole in batches:
            for b in slices(whole, text):
                votes = np.zeros((b.num_rows, len(place)), dtype=np.uint8)
                for row, body in enumerate(utf8(b.column(text))):
                    words = set(_WORD.findall(body.decode().lower()))
                    hits = [place[w] for w in words & whole_words]
                    for k, known in begins:
                        hits += [place[p + "*"] for p in {w[:k] for w in words if len(w) > k} & known]
                    votes[row, hits] = 1
                p = own.score(votes)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
