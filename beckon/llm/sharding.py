"""Sharding (4): jump consistent hashing of stable keys.

A key's shard depends on the key and the number of shards only.  When a shard is appended, a key
stays where it is or moves to the new shard; no ring table is kept.  Slots number each shard's rows
without a gap: rows are numbered inside their input partition while they stream by, the table of
(shard, partition) counts gives the offsets, so no shard is ever gathered or sorted.

Edge cases: a null key is a key like any other; a null text has no bytes; repeated rows get slots of
their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beckon.llm.common import Batches, map_arrow, materialize

# Fixed value: multiplier of the 64-bit linear congruential generator of jump consistent hash.
LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: follow the key's random jumps until they leave ``[0, shards)``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = np.asarray(keys, dtype=np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * LCG + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = np.floor((shard[live] + 1) * (float(1 << 31) / draw))
        inside = jump < shards
        live = live[inside]
        shard[live] = jump[inside].astype(np.int64)
    return shard


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus one, ``grown_shard`` the shard with one more shard.
    """

    def place(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for b in batches:
            keys = b.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            sizes = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            local += seen[shard]
            seen += sizes
            cols = [b.column(c) for c in ("key", "size", "text_crc32")]
            cols += [pa.array(shard, pa.int32()), pa.array(jump_hash(keys, shards + 1), pa.int32()), pa.array(np.full(len(shard), part), pa.int32()), pa.array(local)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "size", "text_crc32", "shard", "grown_shard", "part", "local"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(key).alias("hash"))
    kind = rows.schema["key"].dataType.simpleString()
    placed = materialize(map_arrow(rows, place, f"key {kind}, size long, text_crc32 long, shard int, grown_shard int, part int, local long"), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shard-starts")
    return placed.join(starts, ["shard", "part"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard", (F.col("first") + F.col("local")).alias("slot"))
