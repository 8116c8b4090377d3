"""N-gram Jaccard join (8): signature trees.

A document is the set of hashes of its word shingles; equal sets are one node of the join.  Two nodes link when
their Jaccard similarity reaches ``percent`` hundredths, decided exactly.

The upper levels of the tree are spread over the cluster: a node stands under each of its prefix shingles, the
first ``n - ceil(t n) + 1`` of its set in one global order, since similar sets share at least one of them.  The
order puts shingles that are frequent in the corpus last, so common passages rarely become entries; it decides
cost only, never results.  Below an entry, nodes form a tree sorted by component and size: every tree node holds
the OR of its members' bitmaps, their size range and the largest number of shingles that share bits.  A dual
traversal expands pairs of tree nodes and prunes a pair whose sizes cannot be similar, whose members already
hang together, or whose largest possible overlap, ``popcount(a & b)`` plus shared bits, is too small.

Rounds: first every node is compared with the hub that it shares most of its entries with, which joins copies
with work linear in their number.  Entries that still hold several components are traversed with coarse bitmaps of
the sets' longer prefixes (similar sets share at least ``EXTRA`` hundredths there); nodes of surviving pairs form
clusters, so that a pair is looked at once and not under every entry that it shares.  Clusters are traversed with
fine bitmaps of the whole sets; a surviving pair is verified on the sets unless its nodes already hang together, so
what leaves a task are links of a spanning forest, never all pairs.  Entries and clusters of more than ``BLOCK`` nodes
are cut into pairs of blocks.

Edge cases: a null, empty or blank text has the empty set and links with nothing; a text shorter than a shingle
is one shingle; repeated rows share a component; a null key is kept as a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import Batches, materialize, mix64, slices, tidy, utf8, whole_groups, word_hashes
from beckon.llm.components import components, roots_of

WIDTH = 4
PERCENT = 85
HOT = 100  # documents from which on a shingle goes to the end of the order
HOT_LIMIT = 1 << 18  # the most frequent ones only: the order is broadcast
CHUNK = 1 << 20  # shingles counted at once
BLOCK = 1024
FAN = 8
LEAF = 32
STEP = 2048
EXTRA = 30
STRONG = 0.3  # share of a node's prefix that makes a hub worth a comparison
BLOOM_BITS = (20, 28)
_WEIGHTS = mix64(np.arange(64, dtype=np.uint64) + np.uint64(500)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _WEIGHTS[k]
    rolled = mix64(rolled)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            own = words[end - n : end]
            out.append(mix64((own * _WEIGHTS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of ``n`` shares with any similar set."""
    return (percent * n + 99) // 100


def spare(n, percent: int):
    """Shingles that the coarse prefix of a set of ``n`` has more than its entries; similar sets share one more there."""
    return EXTRA * n // 100


def prefix(shingles: np.ndarray, hot: np.ndarray, percent: int, more: int = 0) -> np.ndarray:
    n = len(shingles)
    size = n - int(least_overlap(n, percent)) + 1 + more
    if len(hot):
        at = np.searchsorted(hot, shingles)
        common = hot[np.minimum(at, len(hot) - 1)] == shingles
        shingles = np.concatenate([shingles[~common], shingles[common]])
    return shingles[:size]


def each_set(column: str, width: int, batches: Batches):
    for whole in batches:
        for b in slices(whole, column, 1 << 20):
            yield b, shingle_sets(utf8(b.column(column)), width)


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles of at least ``HOT`` documents by chunk counts over the whole corpus, sorted."""

    def count(batches: Batches) -> Batches:
        held, size = [], 0
        schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], schema=schema)

        for _, sets in each_set("text", width, batches):
            held += sets
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "shingle").limit(HOT_LIMIT).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().view(np.uint64)) if rows.num_rows else np.empty(0, np.uint64)


def bloom_places(nodes: np.ndarray, bits: int) -> list[np.ndarray]:
    x = nodes.view(np.uint64)
    return [mix64(x + np.uint64(k)) >> np.uint64(64 - bits) for k in (1, 2)]


def bloom_filter(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Fixed-size filter of the nodes: built in blocks on the cluster; at most ``2**28`` bits reach the driver."""
    count = nodes.count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (16 * max(1, count)).bit_length()))
    block_bits = 16

    def mark(batches: Batches) -> Batches:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            block, place = b.column("block").to_numpy(), b.column("place").to_numpy()
            for k in np.unique(block):
                own = blocks.setdefault(int(k), np.zeros(1 << block_bits - 3, np.uint8))
                p = place[block == k]
                np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([v.tobytes() for v in blocks.values()], pa.binary())], names=["block", "bits"])

    def spread(batches: Batches) -> Batches:
        for b in batches:
            p = np.concatenate(bloom_places(b.column("node").to_numpy(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p >> block_bits), pa.array(p & (1 << block_bits) - 1)], names=["block", "place"])

    found = nodes.select("node").mapInArrow(tidy(spread), "block long, place long").repartition("block").mapInArrow(tidy(mark), "block long, bits binary").collect()
    table = np.zeros(1 << bits - 3, np.uint8)
    for r in found:
        at = r["block"] << block_bits - 3
        table[at : at + (1 << block_bits - 3)] |= np.frombuffer(r["bits"], np.uint8)
    return bits, table


def signature(shingles: np.ndarray, each: int = 8) -> np.ndarray:
    """Bitmap of at least ``each`` bits a shingle, as 64-bit words (a power of two of them)."""
    size = 1 << max(6, (each * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[mix64(shingles) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


class SignatureTree:
    """Levels of nodes over members of one bitmap width, sorted by component and size."""

    def __init__(self, rows: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, marked: np.ndarray, group: np.ndarray) -> None:
        """``marked``: shingles that a member's bitmap stands for."""
        self.rows = rows
        excess = marked - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess, group)]
        while len(self.levels[-1][1]) > LEAF:
            maps, low, high, most, own = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            same = np.minimum.reduceat(own, at) == np.maximum.reduceat(own, at)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.where(same & (own[at] >= 0), own[at], -1)))


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int, coarse: bool) -> np.ndarray:
    """Which pairs of tree nodes can hold a similar pair of different components."""
    keep = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i]) & ((a[4][i] != b[4][j]) | (a[4][i] < 0))
    live = np.flatnonzero(keep)
    step = max(1, (1 << 19) // a[0].shape[1])
    for at in range(0, len(live), step):
        k = live[at : at + step]
        shared = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i[k]], b[3][j[k]])
        if coarse:
            keep[k] = shared > spare(np.minimum(a[1][i[k]], b[1][j[k]]), percent)
        else:
            keep[k] = (100 + percent) * shared >= percent * (a[1][i[k]] + b[1][j[k]])
    return keep


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int, coarse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may be similar, at most ``STEP * FAN * FAN`` at once; ``a is b`` gives each pair once."""
    top = [np.arange(len(t.levels[-1][1])) for t in (a, b)]
    i, j = (x.ravel() for x in np.meshgrid(*top, indexing="ij"))
    open_pairs = [(len(a.levels) - 1, len(b.levels) - 1, i, j)]
    while open_pairs:
        depth_a, depth_b, i, j = open_pairs.pop()
        if a is b:
            keep = i < j if depth_a == 0 else i <= j
            i, j = i[keep], j[keep]
        keep = possible(a.levels[depth_a], b.levels[depth_b], i, j, percent, coarse)
        i, j = i[keep], j[keep]
        if depth_a == depth_b == 0:
            yield a.rows[i], b.rows[j]
            continue
        down_a = depth_a > 0 and (a is b or depth_a >= depth_b)
        down_b = depth_b > 0 and (a is b or not down_a)
        for at in range(0, len(i), STEP):  # few pairs at a time: depth first keeps memory bounded
            x, y = i[at : at + STEP], j[at : at + STEP]
            if down_a:
                x, y = (x[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(y, FAN)
                keep = x < len(a.levels[depth_a - 1][1])
                x, y = x[keep], y[keep]
            if down_b:
                y, x = (y[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(x, FAN)
                keep = y < len(b.levels[depth_b - 1][1])
                x, y = x[keep], y[keep]
            open_pairs.append((depth_a - down_a, depth_b - down_b, x, y))


def candidates(maps: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, coarse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs between ``left`` and ``right`` rows (the same rows: within) that pass the traversal, by bitmap width."""
    widths = np.array([len(m) for m in maps])
    marked = sizes - least_overlap(sizes, percent) + 1 + spare(sizes, percent) if coarse else sizes
    marked = np.minimum(marked, sizes)

    def tree(rows: np.ndarray, width: int) -> SignatureTree:
        rows = rows[np.lexsort((sizes[rows], group[rows]))]
        folded = np.stack([maps[k] if len(maps[k]) == width else np.bitwise_or.reduce(maps[k].reshape(-1, width), axis=0) for k in rows])
        return SignatureTree(rows, folded, sizes[rows], marked[rows], group[rows])

    within = left is right
    for w in np.unique(widths):
        own, other = left[widths[left] == w], right[widths[right] == w]
        if within and len(own) > 1:
            one = tree(own, w)
            yield from dual_traversal(one, one, percent, coarse)
        elif not within and len(own) and len(other):
            yield from dual_traversal(tree(own, w), tree(other, w), percent, coarse)
        for x, y in ((left, right),) if within else ((left, right), (right, left)):
            own, wide = x[widths[x] == w], y[widths[y] == 2 * w]  # similar sizes differ by less than two
            if len(own) and len(wide):
                yield from dual_traversal(tree(own, w), tree(wide, w), percent, coarse)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""

    def check(batches: Batches) -> Batches:
        for whole in batches:
            for b in slices(whole, "x", 8 << 20):
                keep = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    keep.append(alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
                done = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([done.column("a"), done.column("b")], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def load_sets(docs: DataFrame, nodes: DataFrame, text: str, width: int) -> DataFrame:
    """(node, set) of the wanted nodes: one pass over the texts behind a Bloom filter."""
    bits, table = bloom_filter(nodes)
    wanted = docs.sparkSession.sparkContext.broadcast(table)

    def load(batches: Batches) -> Batches:
        for _, sets in each_set("text", width, batches):
            sets = [s for s in sets if len(s)]
            found = np.array([node_of(s) for s in sets], dtype=np.int64)
            keep = np.ones(len(found), dtype=bool)
            for p in bloom_places(found, bits):
                keep &= (wanted.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(found[kept]), pa.array([sets[k].tobytes() for k in kept], pa.binary())], names=["node", "set"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(tidy(load), "node long, set binary")
    return materialize(rows.groupBy("node").agg(F.first("set").alias("set")), "shingle-sets")


def meet(batches: Batches) -> Batches:
    """Of rows sorted by entry and node: those of entries with several nodes, each with the hub, the least node."""
    entry, hub, waiting = None, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        e, node, n = (b.column(c).to_numpy() for c in ("entry", "node", "n"))
        at = np.concatenate(([0], np.flatnonzero(np.diff(e)) + 1))
        sizes = np.diff(np.append(at, len(e)))
        hubs, full = node[at].copy(), sizes > 1
        extra = []
        if entry is not None and e[0] == entry:
            extra = [waiting] if waiting else []
            hubs[0], full[0] = hub, True
        keep = np.repeat(full, sizes)
        cols = [e[keep], node[keep], n[keep], np.repeat(hubs, sizes)[keep]]
        cols = [np.concatenate([c, np.array([x[k] for x in extra], c.dtype)]) for k, c in enumerate(cols)]
        entry, hub = e[-1], hubs[-1]
        waiting = None if full[-1] else (e[-1], node[-1], n[-1], node[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["entry", "node", "n", "hub"])


def coarse_task(percent: int):
    """Over rows sorted by (entry, i, j): which nodes hang together by pairs that may be similar."""

    def run(batches: Batches) -> Batches:
        for table, groups in whole_groups(batches, ["entry", "i", "j"]):
            node, n, component, block, i, j = (table.column(c).to_numpy() for c in ("node", "n", "component", "block", "i", "j"))
            maps, out = table.column("map"), [np.empty((0, 2), np.int64)]
            for g in groups:
                if len(g) < 2:
                    continue
                _, own = np.unique(component[g], return_inverse=True)
                own_maps = [np.frombuffer(m, np.uint64) for m in maps.slice(g[0], len(g)).to_pylist()]
                pairs = list(candidates(own_maps, n[g], own, *sides(block[g], i[g[0]], j[g[0]]), percent, True))
                a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
                root = roots_of(len(g), a, b)
                met = np.flatnonzero(root != np.arange(len(g)))
                out.append(np.stack([node[g][met], node[g][root[met]]], axis=1))
            edges = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return run


def sides(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        everyone = np.arange(len(block))
        return everyone, everyone
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def alike(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    if len(u) > len(v):
        u, v = v, u
    shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 100 * shared >= percent * (len(u) + len(v) - shared)


def fine_task(percent: int):
    """Over rows sorted by (cluster, i, j): verified links that join components."""

    def run(batches: Batches) -> Batches:
        for table, groups in whole_groups(batches, ["cluster", "i", "j"]):
            node, component, block, i, j = (table.column(c).to_numpy() for c in ("node", "component", "block", "i", "j"))
            column, links = table.column("set"), []
            for g in groups:
                if len(g) < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in column.slice(g[0], len(g)).to_pylist()]
                n = np.array([len(x) for x in sets])
                _, own = np.unique(component[g], return_inverse=True)
                up = list(range(int(own.max()) + 1))
                for a, b in candidates([signature(x) for x in sets], n, own, *sides(block[g], i[g[0]], j[g[0]]), percent):
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        p, q = find_root(up, own[x]), find_root(up, own[y])
                        if p != q and alike(sets[x], sets[y], percent):
                            up[max(p, q)] = min(p, q)
                            links.append((node[g[x]], node[g[y]]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in links], pa.int64()), pa.array([k[1] for k in links], pa.int64())], names=["a", "b"])

    return run


def find_root(up: list[int], k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of the exact similarity graph, by smallest key."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = sc.broadcast(frequent_shingles(docs, text, width))

    def describe(batches: Batches) -> Batches:
        for b, sets in each_set("text", width, batches):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["key", "node", "n"])

    named = materialize(rows.mapInArrow(tidy(describe), f"key {kind}, node long, n long"), "shingle-nodes")

    def once(batches: Batches):
        """Sets by node; copies of a set in one task count once."""
        seen: set[int] = set()
        for _, sets in each_set("text", width, batches):
            fresh = {node_of(s): s for s in sets if len(s)}
            fresh = {k: s for k, s in fresh.items() if k not in seen}
            seen.update(fresh)
            yield fresh

    def enter(batches: Batches) -> Batches:
        for fresh in once(batches):
            heads = [prefix(s, order.value, percent) for s in fresh.values()]
            times = np.array([len(h) for h in heads], dtype=np.int64)
            n = np.array([len(s) for s in fresh.values()], dtype=np.int32)
            cols = [np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64), np.repeat(np.array(list(fresh), dtype=np.int64), times), np.repeat(n, times)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["entry", "node", "n"])

    def sketch(batches: Batches) -> Batches:
        for fresh in once(batches):
            maps = [signature(prefix(s, order.value, percent, spare(len(s), percent)), 4).tobytes() for s in fresh.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array([len(s) for s in fresh.values()], pa.int64()), pa.array(maps, pa.binary())], names=["node", "n", "map"])

    entries = rows.select("text").mapInArrow(tidy(enter), "entry long, node long, n int").repartition("entry").sortWithinPartitions("entry", "node")
    met = materialize(entries.mapInArrow(tidy(meet), "entry long, node long, n int, hub long"), "shingle-entries")

    size = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    shared = met.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= STRONG * size)
    stars = materialize(shared.groupBy("node").agg(F.max_by("hub", "c").alias("b")).select(F.col("node").alias("a"), "b"), "shingle-stars")
    near = load_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text, width)
    links = materialize(verified(stars, near, percent), "shingle-links")
    joined = components(links)

    grouped = met.select("entry", "node").distinct().join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # entries with the same nodes ask the same question; one of them stays
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    still = grouped.groupBy("entry").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), *marks).filter("low != high")
    still = still.groupBy("m", "mark1", "mark2").agg(F.min("entry").alias("entry")).select("entry", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))

    def in_blocks(frame: DataFrame, group: str) -> DataFrame:
        """Each row once for every pair (i, j) of its group's blocks that has its own."""
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        out = frame.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return out.select(group, "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    coarse = rows.select("text").mapInArrow(tidy(sketch), "node long, n long, map binary").groupBy("node").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    loaded = in_blocks(grouped.join(still, "entry"), "entry").join(coarse, "node").repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    edges = loaded.select("entry", "i", "j", "node", "n", "component", "block", "map").mapInArrow(tidy(coarse_task(percent)), "a long, b long")
    clusters = materialize(components(edges).withColumnRenamed("component", "cluster"), "shingle-clusters")

    sets = load_sets(docs, clusters.select("node"), text, width)
    sized = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sized, "cluster")
    loaded = in_blocks(placed, "cluster").join(sets, "node").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    more = materialize(loaded.select("cluster", "i", "j", "node", "component", "block", "set").mapInArrow(tidy(fine_task(percent)), "a long, b long"), "shingle-links")
    final = components(links.union(more)).withColumnRenamed("component", "root")
    placed = named.select("key", "node", "n").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.filter("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    out = placed.join(least, "root", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))
