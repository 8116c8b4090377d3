"""A store that grows by micro-batches: rows whose key is not there yet (T2, D6), by a Bloom filter and merged runs.

Every batch writes one run of Parquet files, sorted by the part of the key's hash.  A filter of fixed size (``PARTS``
rows of ``BLOOM_BITS`` bits) holds all keys so far, so keys that it does not know are new without a look at the store;
only the others are compared with the store, key columns alone and only in their parts.  Where ``FAN`` runs of one size
have gathered, they are merged into one, so there are few folders however long the stream runs.

A run names the batches it covers and counts once its ``_SUCCESS`` is there; of overlapping runs the widest counts.  A
replayed batch overwrites its own run and filter and sees only earlier ones, so replays and failures between the steps
change nothing.  ``PARTS`` and ``BLOOM_BITS`` are fixed for the life of a store; about 50,000 keys a part keep wrong
guesses near one in a hundred, and more of them only cost reads.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 256
BLOOM_BITS = 1 << 19
HASHES = 4
FAN = 8


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _finished(spark: SparkSession, path: str, mark: str) -> list[tuple[int, int]]:
    """(first, last) of the folders ``mark=first-last`` that were written to their end."""
    fs, where = _files(spark, path)
    if not fs.exists(where(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where(path))]
    found = [tuple(int(x) for x in n[len(mark) + 1 :].split("-")) for n in names if n.startswith(mark + "=")]
    return [r for r in found if fs.exists(where(f"{path}/{_name(mark, r)}/_SUCCESS"))]


def _name(mark: str, run: tuple[int, int]) -> str:
    return f"{mark}={run[0]:09d}-{run[1]:09d}"


def runs(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, int]]:
    """The runs that make up the store: widest first, none that a chosen one covers, none that ends at ``before`` or later."""
    chosen: list[tuple[int, int]] = []
    for run in sorted(_finished(spark, path, "run"), key=lambda r: (r[0], -r[1])):
        if (before is None or run[1] < before) and (not chosen or run[0] > chosen[-1][1]):
            chosen.append(run)
    return chosen


def read_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    found = runs(spark, path, before)
    return spark.read.parquet(*[f"{path}/{_name('run', r)}" for r in found]) if found else None


def _places(part: np.ndarray, key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, byte, bit) of each of a key's marks."""
    x = key.astype(np.int64).view(np.uint64)
    out = []
    for k in range(HASHES):
        y = (x ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        spot = (y ^ (y >> np.uint64(31))) % np.uint64(BLOOM_BITS)
        out.append((part, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8)))
    return out


def _load_filter(spark: SparkSession, path: str, before: int) -> np.ndarray:
    bits = np.zeros((PARTS, BLOOM_BITS // 8), np.uint8)
    known = [r for r in _finished(spark, f"{path}/_seen", "upto") if r[1] < before]
    if known:
        for r in spark.read.parquet(f"{path}/_seen/{_name('upto', max(known))}").collect():  # PARTS rows of a fixed size
            bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bits


def append_if_absent(batch: DataFrame, batch_id: int, path: str, order: str, keys: Sequence[str]) -> None:
    """Write the rows of a micro-batch whose key is not stored yet; of rows with one key that with the least ``order``."""
    spark = batch.sparkSession
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys]
    once = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__v")).select(*keys, "__v.*")
    hashed = once.withColumn("key_hash", F.xxhash64(*keys)).withColumn("part", F.pmod("key_hash", F.lit(PARTS)).cast("int")).persist()
    try:
        bits = _load_filter(spark, path, batch_id)
        shared = spark.sparkContext.broadcast(bits)

        @F.pandas_udf("boolean")
        def known(part: pd.Series, key: pd.Series) -> pd.Series:
            hit = np.ones(len(part), dtype=bool)
            for row, byte, bit in _places(part.to_numpy(), key.to_numpy()):
                hit &= shared.value[row, byte] & bit > 0
            return pd.Series(hit)

        def mark(rows: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(BLOOM_BITS // 8, np.uint8)
            for _, byte, bit in _places(rows["part"].to_numpy(), rows["key_hash"].to_numpy()):
                np.bitwise_or.at(own, byte, bit)
            return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [own.tobytes()]})

        stored = read_store(spark, path, batch_id) if bits.any() else None
        fresh = hashed
        if stored is not None:
            judged = hashed.withColumn("__maybe", known("part", "key_hash"))
            asked = [r["part"] for r in judged.filter("__maybe").select("part").distinct().collect()]  # at most PARTS
            old = stored.filter(F.col("part").isin(asked)).select("part", "key_hash", *keys) if asked else stored.limit(0)
            same = F.col("n.part").eqNullSafe(F.col("o.part")) & (F.col("n.key_hash") == F.col("o.key_hash"))
            for k in keys:  # a null is a value like any other here
                same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
            checked = judged.filter("__maybe").alias("n").join(old.alias("o"), same, "left_anti")
            fresh = judged.filter("not __maybe").unionByName(checked).drop("__maybe")
        fresh.repartition("part").sortWithinPartitions("part", "key_hash").write.mode("overwrite").parquet(f"{path}/{_name('run', (batch_id, batch_id))}")
        for r in hashed.select("part", "key_hash").groupBy("part").applyInPandas(mark, "part int, bits binary").collect():
            bits[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
        seen = spark.createDataFrame([(k, b.tobytes()) for k, b in enumerate(bits)], "part int, bits binary").coalesce(1)
        seen.write.mode("overwrite").parquet(f"{path}/_seen/{_name('upto', (0, batch_id))}")
    finally:
        hashed.unpersist()
    merge_runs(spark, path, batch_id)


def merge_runs(spark: SparkSession, path: str, batch_id: int) -> None:
    """Merge ``FAN`` neighbouring runs of one size into one, and drop what merged runs and later filters replace.

    The last batch may be replayed, so its own run is never merged and its forerunner's filter is kept.
    """
    found = runs(spark, path, batch_id)
    size = 1
    while True:
        alike = [r for r in found if r[1] - r[0] + 1 == size]
        group = next((alike[k : k + FAN] for k in range(len(alike)) if alike[k][0] % (size * FAN) == 0 and len(alike[k : k + FAN]) == FAN and alike[k + FAN - 1][1] - alike[k][0] + 1 == size * FAN), None)
        if group:
            whole = (group[0][0], group[-1][1])
            rows = spark.read.parquet(*[f"{path}/{_name('run', r)}" for r in group])
            rows.repartition("part").sortWithinPartitions("part", "key_hash").write.mode("overwrite").parquet(f"{path}/{_name('run', whole)}")
            found = runs(spark, path, batch_id)
            continue
        size *= FAN
        if not any(r[1] - r[0] + 1 >= size for r in found):
            break
    fs, where = _files(spark, path)
    live = set(found)
    for r in _finished(spark, path, "run"):
        if r[1] < batch_id and r not in live:
            fs.delete(where(f"{path}/{_name('run', r)}"), True)
    for r in _finished(spark, f"{path}/_seen", "upto"):
        if r[1] < batch_id - 1:
            fs.delete(where(f"{path}/_seen/{_name('upto', r)}"), True)
