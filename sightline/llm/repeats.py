"""Removal of repeated byte strings: suffix arrays over what winnowing leaves undecided.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.

1. Every window of ``length`` bytes keeps its least k-gram, the anchor.  Equal windows have
   equal anchors at the same offset, so only windows of one anchor need comparing.  A
   run of windows with one anchor, and the bytes they cover, is a context.
2. Anchors met once: no window repeats.  Anchors whose contexts are all equal: every
   window repeats.  Equal contexts are counted, never gathered.
3. Of the rest, one of each distinct context remains.  Anchors with up to ``max_contexts`` of them
   go to shards; a shard's contexts are concatenated and their suffix array, built by induced
   sorting, with its permuted common prefixes tells which windows repeat: those whose
   prefix in common with the neighbour before or after reaches a window's length.
4. Anchors with more distinct contexts are first cut into cells of windows, each with what
   its windows have in common as the new anchor, and go through 2 and 3 again; cells of one
   window are decided by counting.  So no group is ever gathered whole, however hot.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import U64, expand_ranges, materialize, mix64, powers, scratch_path, shared_dir, sliding_min, text_slices, utf8_buffers
from sightline.llm.suffix_array import permuted_lcp, suffix_array

GRAM = 64
#: Cells of windows that contexts of hot anchors are cut into, one size after the other.
CELLS = (16, 1)
#: Anchors with more distinct contexts are hot.
MAX_CONTEXTS = 1024
#: Most repeated contexts (16 bytes each) that are broadcast.
MAX_BROADCAST_KEYS = 400_000
SHARD_BYTES = 2 << 20
_SEGMENT = 1 << 20
_BASE = 0xDA942042E4DD58B5
_INVERSE = pow(_BASE, -1, 2**64)
_OCCURRENCE = "key long, context long, row long, start long, windows int, offset int"
_FIELDS = [("key", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("offset", pa.int32())]


class Ranges:
    """Hashes of byte ranges of a buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U64)
            np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def get(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            d = self.sums[size:] - self.sums[:-size]
            d *= self.inverse[: len(d)]
        return mix64(d)


def _combine(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(parts[0]), U64)
        for p in parts:
            out = mix64(out * U64(0x9E3779B97F4A7C15) + p.astype(U64))
    return out


def find_contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, context hash, text number, first window, number of windows and anchor offset of all contexts."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = Ranges(data)
    grams = hashes.grams(gram)
    bits = max(16, int(n).bit_length())
    low = U64((1 << bits) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U64)
    anchor = (sliding_min(packed, length - gram + 1) & low).astype(np.int64)
    sizes = np.diff(offsets)
    valid = np.zeros(len(anchor) + 1, np.int8)
    some = sizes >= length
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[1:][some] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(begin)
    finish = valid.copy()
    finish[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    windows = np.flatnonzero(finish) + 1 - start
    place = anchor[start]
    offset = place - start
    text = np.searchsorted(offsets, start, side="right") - 1
    context = _combine(hashes.get(start, start + windows - 1 + length), windows, offset)
    return _combine(grams[place]), context, text, start - offsets[text], windows, offset


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 256 << 10):
                rows = part.column(0).to_numpy()
                data, offsets = utf8_buffers(part.column(1))
                first = np.zeros(len(rows), np.int64)
                if len(data) > _SEGMENT:  # one long text: segments that share length - 1 bytes
                    cuts = np.arange(0, max(1, len(data) - length + 1), _SEGMENT)
                    pieces = [(data[c : c + _SEGMENT + length - 1], np.array([0, min(len(data) - c, _SEGMENT + length - 1)]), rows[:1], np.array([c])) for c in cuts]
                    if len(rows) > 1:
                        raise AssertionError("long texts come alone")
                else:
                    pieces = [(data, offsets, rows, first)]
                for d, o, r, f in pieces:
                    key, context, text, start, windows, offset = find_contexts(d, o, length, gram)
                    arrays = [key.view(np.int64), context.view(np.int64), r[text], start + f[text], windows.astype(np.int32), offset.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, (_, t) in zip(arrays, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return docs.select("row", "text").mapInArrow(run, _OCCURRENCE)


def _with_text(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """``text, list``: each needed text with its contexts (as many as its length allows)."""
    place = F.struct("key", "context", "row", "start", "windows", "offset", "alone")
    return docs.select("row", "text").join(contexts.groupBy("row").agg(F.collect_list(place).alias("list")), "row").select("text", "list")


def _unnest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes, starts of the texts, and the contexts' columns with ``text``, of a batch of (text, list)."""
    data, offsets = utf8_buffers(batch.column(0))
    lists = batch.column(1)
    flat = lists.flatten()
    columns = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    sizes = np.diff(lists.offsets.to_numpy())
    columns["at"] = np.repeat(offsets[:-1], sizes) + columns["start"]
    return data, offsets, columns


def _refine(contexts: DataFrame, docs: DataFrame, length: int, cell: int) -> DataFrame:
    """Contexts cut into cells of windows at the same distance from the anchor."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 0, 1 << 20):
                data, _, c = _unnest(part)
                if not len(c["at"]):
                    continue
                hashes = Ranges(data)
                far, near = c["offset"].astype(np.int64), c["offset"].astype(np.int64) - c["windows"] + 1
                first, cells = near // cell, far // cell - near // cell + 1
                who = np.repeat(np.arange(len(cells)), cells)
                number = expand_ranges(first, cells)
                low, high = number * cell, number * cell + cell - 1
                place = (c["at"] + far)[who]  # the anchor
                core = hashes.get(place - low, place - high + length)
                to, frm = np.maximum(near[who], low), np.minimum(far[who], high)
                start, windows = place - frm, frm - to + 1
                context = _combine(hashes.get(start, start + windows - 1 + length), windows, frm)
                key = _combine(c["key"][who].view(U64), number, core)
                arrays = [key.view(np.int64), context.view(np.int64), c["row"][who], c["start"][who] + (start - c["at"][who]), windows.astype(np.int32), frm.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, (_, t) in zip(arrays, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return _with_text(contexts, docs).mapInArrow(run, _OCCURRENCE)


def repeated_windows(texts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, which of its first ``counts[i]`` windows occur at another place in ``texts``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint16) + 1
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    joined[starts + sizes] = 0  # ends every text
    order = suffix_array(joined)
    window = np.zeros(len(joined), bool)
    window[expand_ranges(starts, counts)] = True
    # a common prefix of that length cannot contain the end of a text: both of its places start windows
    reach = np.flatnonzero(window & (permuted_lcp(joined, order) >= length))
    before = np.empty(len(joined), np.int64)
    before[order[1:]] = order[:-1]
    again = np.zeros(len(joined), bool)
    again[reach] = True
    again[before[reach]] = True
    return [again[s : s + c] for s, c in zip(starts, counts, strict=True)]


def _shards(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Spans (``row, start, stop``) that the suffix arrays of shards of contexts find repeated."""
    total = contexts.agg(F.sum(F.col("windows") + (length - 1))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, 0, 1 << 20):
                data, _, c = _unnest(part)
                ends = c["at"] + c["windows"] + (length - 1)
                pieces = [data[a:b].tobytes() for a, b in zip(c["at"], ends, strict=True)]
                columns = [pa.array(c["key"]), pa.array(c["row"]), pa.array(c["start"]), pa.array(c["windows"].astype(np.int32)), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "start", "windows", "bytes"])

    def solve(table: pa.Table) -> pa.Table:
        counts = table.column("windows").to_numpy().astype(np.int64)
        rows, starts = table.column("row").to_numpy(), table.column("start").to_numpy()
        again = repeated_windows(table.column("bytes").to_pylist(), counts, length)
        flags = np.concatenate(again)
        owner = np.repeat(np.arange(len(counts)), counts)
        edge = np.append(True, owner[1:] != owner[:-1])
        begin = flags & (edge | ~np.append(False, flags[:-1]))
        finish = flags & (np.append(edge[1:], True) | ~np.append(flags[1:], False))
        begin, finish = np.flatnonzero(begin), np.flatnonzero(finish)
        base = starts - (np.cumsum(counts) - counts)
        who = owner[begin]
        return pa.table({"row": rows[who], "start": base[who] + begin, "stop": base[who] + finish + length})

    pieces = _with_text(contexts, docs).mapInArrow(cut, "key long, row long, start long, windows int, bytes binary")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return pieces.groupBy("shard").applyInArrow(solve, "row long, start long, stop long")


def find_repeats(docs: DataFrame, length: int, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``row, start, stop``: byte ranges of ``docs`` (``row, text``) covered by repeated windows."""
    spans = []
    pool = None
    found = materialize(_occurrences(docs, length, gram), "contexts")
    for cell in (*CELLS, None):
        keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("one"), F.max("context").alias("two")).where("n > 1")
        # written first: a join of two plain exchanges can split a hot key's partition, one above an aggregation cannot
        keys = materialize(keys.select("key", (F.col("one") == F.col("two")).alias("equal")), "keys")
        met = materialize(found.join(keys, "key"), "met")
        whole = (F.col("start") + F.col("windows") + (length - 1)).alias("stop")
        spans.append(met.where("equal").select("row", "start", whole))
        mixed = met.where("not equal")
        # one place for each distinct context; those met more than once are repeated whole
        least = F.min(F.struct("row", "start", "windows", "offset")).alias("p")
        distinct = materialize(mixed.groupBy("key", "context").agg(F.count("*").alias("n"), least), "distinct")
        again = distinct.where("n > 1").select("key", "context")
        if again.count() <= MAX_BROADCAST_KEYS:  # so that a hot context's occurrences stay where they are
            again = F.broadcast(again)
        spans.append(mixed.join(again, ["key", "context"], "left_semi").select("row", "start", whole))
        groups = distinct.groupBy("key").agg(F.count("*").alias("contexts"), F.sum((F.col("n") == 1).cast("int")).alias("alone")).where("alone > 0")
        open_ = distinct.join(groups.select("key", "contexts"), "key")
        open_ = materialize(open_.select("key", "context", "p.*", (F.col("n") == 1).alias("alone"), "contexts"), "open")
        few = open_.where(F.col("contexts") <= max_contexts).drop("contexts")
        pool = few if pool is None else pool.union(few)
        hot = open_.where(F.col("contexts") > max_contexts).drop("contexts")
        if cell is None or hot.isEmpty():
            break
        found = materialize(_refine(hot, docs, length, cell), "contexts")
    spans.append(_shards(materialize(pool, "pool"), docs, length))
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the removed runs (start, stop) of UTF-8 bytes, ``kept`` the remaining bytes
    (binary: a cut may part a character).  Null text counts as empty; texts shorter than
    ``length`` keep everything; rows with equal texts repeat each other; a null id stays
    null; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    id_type = mine.schema["doc_id"].dataType.simpleString()
    # bucketed by row, so that the joins below never shuffle the texts again
    buckets = min(10_000, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shared_dir(spark)
    name = f"texts_{uuid.uuid4().hex}"
    placed = mine.repartition(buckets, "row").write.bucketBy(buckets, "row").option("compression", "zstd")
    placed.option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the plan has read what it needs
    spans = materialize(find_repeats(texts, length, gram, max_contexts), "repeats")
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("list"))
    joined = texts.join(listed, "row", "left").select("doc_id", "text", "list")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 4 << 20):
                data, offsets = utf8_buffers(part.column(1))
                all_spans, kept = [], []
                for i, listed in enumerate(part.column(2).to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    runs: list[dict] = []
                    for s in sorted(listed or (), key=lambda s: s["start"]):
                        if runs and s["start"] <= runs[-1]["stop"]:
                            runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
                        else:
                            runs.append(s)
                    keep = np.ones(len(own), bool)
                    for s in runs:
                        keep[s["start"] : s["stop"]] = False
                    all_spans.append(runs)
                    kept.append(own[keep].tobytes())
                columns = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(all_spans, span_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
