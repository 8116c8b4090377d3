"""Embedding near-dedup (10): cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a vector's hash is the axis
(with sign) nearest to its rotated image.  ``hashes`` such values make a table's bucket, and a vector is
also put into the buckets of its next best values (multiprobe).  The number of hashes follows from the
number of vectors, and the number of tables from the wanted recall at the threshold, measured on simulated
pairs, so buckets stay small and recall stays put as data grow.

Equal vectors are one class with a count.  A bucket's vectors are compared in blocks; a pair that meets in
several buckets counts only in the one whose key is least among those that both have.  What leaves a block is
one row per vector (its links, and the least vector it hangs together with there), never the pairs.

Edge cases: a null label, and vectors that are null, empty, zero, or hold null or non-finite components, link
with nothing; vectors of different length do not compare; repeated rows are linked with each other; a null id is
kept as a row, its component is null unless it links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import Batches, materialize, mix64
from beckon.llm.components import components, roots_of

THRESHOLD = 0.93
RECALL = 0.999
PROBES = 3
BLOCK = 512
SEED = 20260


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def rotate(x: np.ndarray, table: int, part: int) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, part, width]).integers(0, 2, (3, width)) * 2 - 1
    for row in signs:
        out = hadamard(out * row)
    return out


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, salt: np.ndarray) -> np.ndarray:
    """Keys ``[vector, table * probes]`` of unit vectors; ``salt`` keeps groups apart."""
    keys = np.empty((len(x), tables * probes), dtype=np.uint64)
    for t in range(tables):
        best, second, loss = [], [], []
        for h in range(hashes):
            y = rotate(x, t, h)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            pair = np.take_along_axis(size, top, 1)
            top = np.where((pair[:, :1] >= pair[:, 1:]), top, top[:, ::-1])
            value = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best.append(value[:, 0])
            second.append(value[:, 1])
            loss.append(np.abs(pair[:, 0] - pair[:, 1]))
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        width = np.uint64(2 * y.shape[1])
        for p in range(probes):
            key = np.full(len(x), t, dtype=np.uint64)
            for h in range(hashes):
                # the p-th probe takes the next best value at the p-th least costly place
                swap = (order[:, p - 1] == h) if 0 < p <= hashes else np.zeros(len(x), bool)
                if p > hashes:
                    swap = np.isin(h, order[:, :2]) & np.ones(len(x), bool)
                key = key * width + np.where(swap, second[h], best[h]).astype(np.uint64)
            keys[:, t * probes + p] = mix64(key ^ salt)
    return keys


def meeting_rate(dim: int, hashes: int, probes: int, threshold: float) -> float:
    """Share of simulated pairs at the threshold that meet in one table."""
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(64, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(64, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.maximum(norm, 1e-12)
    none = np.zeros(64, np.uint64)
    met = [(bucket_keys(a, 1, hashes, probes, none)[:, :, None] == bucket_keys(b, 1, hashes, probes, none)[:, None, :]).any((1, 2))]
    for t in range(1, 24):
        ka, kb = (bucket_keys(rotate(v, 1000 + t, 0), 1, hashes, probes, none) for v in (a, b))
        met.append((ka[:, :, None] == kb[:, None, :]).any((1, 2)))
    return max(0.02, float(np.mean(met)))


def plan_tables(count: int, dim: int, threshold: float, recall: float, probes: int) -> tuple[int, int]:
    """(tables, hashes): about as many buckets as vectors, and tables for the recall at the threshold."""
    values = 2 * (1 << max(1, (max(2, dim) - 1).bit_length()))
    hashes = max(2, math.ceil(math.log(max(2, count)) / math.log(values)))
    rate = meeting_rate(max(2, dim), hashes, min(probes, hashes + 1), threshold)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(rate, 0.999)))), hashes


def compare(key: int, first: int, second: int, node: np.ndarray, count: np.ndarray, block: np.ndarray, vectors: np.ndarray, keys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links found in a pair of blocks of one bucket: node, linked rows, least connected node."""
    order = np.argsort(node, kind="stable")
    node, count, block, vectors, keys = node[order], count[order], block[order], vectors[order], keys[order]
    links = np.zeros(len(node), dtype=np.int64)
    pairs_a, pairs_b = [], []
    left = np.flatnonzero(block == first)
    right = np.flatnonzero(block == second)
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        close = vectors[own] @ vectors[right].T >= threshold
        if first == second:
            close &= own[:, None] < right[None, :]
        i, j = np.nonzero(close)
        i, j = own[i], right[j]
        for cut in range(0, len(i), 4096):
            x, y = i[cut : cut + 4096], j[cut : cut + 4096]
            same = (keys[x][:, :, None] == keys[y][:, None, :]).any(2)
            least = np.where(same, keys[x], np.uint64(2**64 - 1)).min(1)
            mine = least == np.uint64(key)
            pairs_a.append(x[mine])
            pairs_b.append(y[mine])
    a, b = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (pairs_a, pairs_b))
    np.add.at(links, a, count[b])
    np.add.at(links, b, count[a])
    root = roots_of(len(node), a, b)
    met = np.flatnonzero(links)
    return node[met], links[met], node[root[met]]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.when(valid, v).alias("v"), F.xxhash64(label, F.size(v)).alias("group"), F.col(label).cast("string").alias("label"))
    rows = rows.select("key", "v", "group", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("node"))
    named = materialize(rows.select("key", "node"), "vector-nodes")
    classes = materialize(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("count"), F.min("key").alias("least"), F.first("v").alias("v"), F.first("group").alias("group")), "vector-classes")
    total, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(2))).first()
    tables, hashes = plan_tables(total, dim, threshold, recall, probes)
    probes = min(probes, hashes + 1)

    def keyed(batches: Batches) -> Batches:
        for b in batches:
            body = b.column("v")
            sizes = np.diff(body.offsets.to_numpy())
            flat, starts = body.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            group = b.column("group").to_numpy(zero_copy_only=False).view(np.uint64)
            out: list = [None] * len(sizes)
            units: list = [None] * len(sizes)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = flat[starts[own][:, None] + np.arange(d)]
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = bucket_keys(x, tables, hashes, probes, mix64(group[own]))
                for k, row, unit in zip(own, keys, x, strict=True):
                    out[k], units[k] = row.view(np.int64), unit.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables * probes, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("count"), pa.array(units, pa.binary()), lists], names=["node", "count", "unit", "keys"])

    hashed = materialize(classes.select("node", "count", "v", "group").mapInArrow(keyed, "node long, count long, unit binary, keys array<long>"), "vector-keys")
    spots = hashed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    full = spots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = spots.join(full, "key").select("node", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "key", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    loaded = dealt.join(hashed, "node").repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")

    def link(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

        def finish(table: pa.Table) -> pa.RecordBatch:
            key, first, second, block, node, count = (table.column(c).to_numpy() for c in ("key", "first", "second", "block", "node", "count"))
            units, lists = table.column("unit").to_pylist(), table.column("keys").combine_chunks()
            lists = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1).view(np.uint64)
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)) + 1
            out = []
            for run in np.split(np.arange(len(key)), edge):
                if len(run) > 1:
                    x = np.stack([np.frombuffer(units[k]) for k in run])
                    out.append(compare(key[run[:1]].view(np.uint64)[0], first[run[0]], second[run[0]], node[run], count[run], block[run], x, lists[run], threshold))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        def bucket(b: pa.RecordBatch, row: int) -> tuple:
            return tuple(b.column(c)[row].as_py() for c in ("key", "first", "second"))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if bucket(b, b.num_rows - 1) == bucket(held[0], 0):
                continue
            table = pa.Table.from_batches(held)
            key, first, second = (table.column(c).to_numpy() for c in ("key", "first", "second"))
            last = (key == key[-1]) & (first == first[-1]) & (second == second[-1])
            done = int(len(key) - last.sum())
            yield finish(table.slice(0, done))
            held = table.slice(done).to_batches()
        if held:
            yield finish(pa.Table.from_batches(held))

    found = materialize(loaded.select("key", "first", "second", "block", "node", "count", "unit", "keys").mapInArrow(link, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    inside = classes.select("node", "count", "least").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = inside.join(least, "component").select("node", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.join(nodes, "node", "left").select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
