"""Helpers shared by the corpus operators: shared scratch tables, Arrow batches, word splitting, hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from beckon.session import checkpoint_dir

# The bytes that may belong to a word of the decontamination contract are those
# not listed here, after lower-casing A-Z (0-9, a-z and every byte of a non-ASCII character).
_NOT_WORD = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_SPACES = bytes.maketrans(bytes(_NOT_WORD), b" " * len(_NOT_WORD))

BATCH_BYTES = 8 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Batches = Iterator[pa.RecordBatch]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about ``BATCH_BYTES``, since ten thousand rows of whole texts are a lot for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where none is set (tests)."""
    return f"{checkpoint_dir(spark)}/beckon-llm"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: work is done once and its lineage ends.

    The files stay until the folder is cleaned, since the returned DataFrame reads them; the shuffles behind them are
    removed at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(tidy(fn), schema)


def tidy(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``fn`` for ``mapInArrow``, giving freed memory back to the system at its end, as idle workers keep theirs."""

    def run(batches: Batches) -> Batches:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give memory that is free but held by this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column's bytes of a slice stay near ``most`` (one long value may exceed it)."""
    n = batch.num_rows
    sizes = binary_sizes(batch.column(column))
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binary_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def contract_words(text: bytes) -> list[bytes]:
    """Maximal runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z."""
    return text.lower().translate(_SPACES).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Hashing of white-space words -------------------------------------------------------------------

_PIECE = 1 << 18  # bytes hashed at once; a worker takes some fifty times that meanwhile
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(str(base))
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, _PIECE + (1 << 16)) - 1, base, np.uint64))), dtype=np.uint64)
        _POWERS[str(base)] = known
    return known[:n]


def _hash_piece(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a lower-cased buffer."""
    data = np.frombuffer(buffer, np.uint8)
    word = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    shift = _powers(_BASE_INVERSE, len(data))
    return starts, mix64((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end at white space."""
    at = 0
    while len(text) - at > _PIECE:
        parts = text[at : at + _PIECE].rsplit(None, 1)
        size = len(parts[0]) if len(parts) == 2 else 0
        if not size:  # one word longer than a piece
            rest = text[at + _PIECE :].split(None, 1)
            size = len(text) - at - (len(rest[1]) if len(rest) == 2 else 0)
        yield text[at : at + size]
        at += size
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and the words of each text."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            starts, found = _hash_piece(b"\n".join(texts[k] for k in group).lower())
            bounds = np.cumsum([0] + [len(texts[k]) + 1 for k in group])
            counts[group] = np.diff(np.searchsorted(starts, bounds))
            hashes.append(found)
            group.clear()
            size = 0

    for k, text in enumerate(texts):
        if len(text) > _PIECE:
            flush()
            for piece in _cuts(text):
                found = _hash_piece(piece.lower())[1]
                counts[k] += len(found)
                hashes.append(found)
            continue
        group.append(k)
        size += len(text) + 1
        if size > _PIECE:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def whole_groups(batches: Batches, keys: list[str]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """From batches sorted by integer ``keys``: tables of complete groups, with the row numbers of each group.

    Only the group that a batch breaks off in is held back.
    """

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for k in keys:
            change |= np.diff(table.column(k).to_numpy()) != 0
        return np.flatnonzero(change) + 1

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if all(held[0].column(k)[0] == b.column(k)[b.num_rows - 1] for k in keys):
            continue
        table = pa.Table.from_batches(held)
        edges = cut(table)
        yield table.slice(0, edges[-1]), np.split(np.arange(edges[-1]), edges[:-1])
        held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.split(np.arange(table.num_rows), cut(table))
