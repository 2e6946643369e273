"""Helpers shared by the text operators: shared storage, bounded batches and hashing kernels.

The hashing kernels work on whole batches of UTF-8 bytes with NumPy; no kernel
loops over characters in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_LOCAL_SHARED = "/tmp/checkpoints"


# -- shared storage ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that runs on one machine (tests, notebooks) gets a default where it names
    none; on a cluster a local folder would lose rows, so there it must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{_LOCAL_SHARED}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or ``path``) and read it back.

    This cuts the lineage; the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that does not occur in ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# -- batches ----------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``max_bytes`` of text (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def arrow_map(df: DataFrame, columns: list, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over a projection of ``df``."""
    return df.select(*columns).mapInArrow(fn, schema)


# -- hashing ----------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 well mixed 64-bit values, one per byte."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(256, dtype=U64) + U64(seed * 1000 + 1)) * U64(_MULT))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n; cached and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(8, (n - 1).bit_length())
        out = np.full(size, U64(base % 2**64))
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        _POWERS[base] = have = out
    return have[:n]


_WORD_TABLE = byte_table(7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separator_mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 booleans: true for bytes in any of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACES = separator_mask([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
NON_ALNUM = separator_mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


class Words:
    """The words of a batch of texts.

    ``hashes``: a 64-bit hash of each word; ``starts``/``ends``: byte range of each
    word; ``first``: n + 1 offsets into these arrays, by text.
    """

    __slots__ = ("chars", "ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        low = self.chars = LOWER[data]
        word = ~separators[low]
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        begins = word & (~before | edge[:-1])
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        finishes = word & (~after | edge[1:])
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            sizes = self.ends - self.starts
            chars = low[word]
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            rel = np.arange(len(chars), dtype=np.int64) - np.repeat(at, sizes)
            with np.errstate(over="ignore"):
                values = _WORD_TABLE[chars] * powers(_MULT | 1, int(sizes.max()))[rel]
                self.hashes = mix64(np.add.reduceat(values, at))
        else:
            self.hashes = np.zeros(0, U64)


    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        which = np.flatnonzero(self.ends - self.starts > size)
        at = self.starts[which]
        out = np.full(len(which), U64(size))
        with np.errstate(over="ignore"):
            for j in range(size):
                out *= U64(_MULT)
                out += _WORD_TABLE[self.chars[at + j]]
        return which, mix64(out)


def gram_hashes(hashes: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (runs over row ends included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, size):
            out *= U64(base | 1)
            out += hashes[j : j + n]
    return mix64(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def expand_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(starts[i], starts[i] + counts[i])``."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + (np.arange(total, dtype=np.int64) - at)

