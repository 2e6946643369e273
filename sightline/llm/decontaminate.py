"""Benchmark decontamination by winnowing.

An item's windows are its runs of ``span`` words; an item with fewer words (but some) is
one window.  Winnowing keeps, for each window, the least hash of its word k-grams: two
equal windows keep the same one, so every shared window is found.  Document windows whose
kept hash is also a benchmark fingerprint are then extended to the whole window, which
is looked up by a 128-bit hash of its words.

The benchmark is a query set, and the documents are read once, whatever its size.  Up to a bounded
number of text bytes it is broadcast whole, and nothing is shuffled.  Beyond that only a bit table of its
fingerprints, of fixed size, is broadcast; document windows whose kept hash may be one of them
are joined with the benchmark's windows by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import NON_ALNUM, U64, Words, expand_ranges, gram_hashes, materialize, mix64, sliding_min, text_slices, utf8_buffers

#: Most bytes of benchmark text that are broadcast.
BLOCK_BYTES = 8 << 20
#: Bits of the table of fingerprints that is broadcast beyond that, as a power of two, and of its segments.
TABLE_BITS, SEGMENT_BITS = 26, 16
#: Most contaminated rows that are broadcast to remove them.
MAX_BROADCAST_ROWS = 400_000
_BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def _window_hash(hashes: np.ndarray, starts: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of ``size`` values from each start."""
    out = np.zeros(len(starts), U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out *= U64(base | 1)
            out += hashes[starts + j]
    return mix64(out)


def _fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words, the least hash of its k-grams, k about half of it."""
    k = (size + 1) // 2
    return sliding_min(gram_hashes(hashes, k), size - k + 1)


class _Windows:
    """Windows of one length: sorted fingerprints, window hashes and the items that hold each window."""

    def __init__(self, words: Words, starts: np.ndarray, items: np.ndarray, size: int):
        self.size = size
        self.fingerprints = np.unique(_fingerprints(words.hashes, size)[starts])
        one, two = (_window_hash(words.hashes, starts, size, b) for b in _BASES)
        order = np.lexsort((items, two, one))
        one, two, items = one[order], two[order], items[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.one, self.two, self.items = one[new], two[new], items
        self.first = np.append(np.flatnonzero(new), len(items))
        clash = np.unique(self.one, return_counts=True)[1]
        self.most = int(clash.max()) if len(clash) else 0

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in ``words`` where a window starts, and which window."""
        none = np.zeros(0, np.int64)
        kept = _fingerprints(words.hashes, self.size) if len(words.hashes) >= self.size else none
        if not len(kept) or not self.most:
            return none, none
        change = np.flatnonzero(np.append(True, kept[1:] != kept[:-1]))
        lengths = np.diff(np.append(change, len(kept)))
        at = np.searchsorted(self.fingerprints, kept[change])
        at[at == len(self.fingerprints)] = 0
        met = self.fingerprints[at] == kept[change]
        starts = expand_ranges(change[met], lengths[met])
        row = np.searchsorted(words.first, starts, side="right") - 1
        starts = starts[starts + self.size <= words.first[row + 1]]
        one, two = (_window_hash(words.hashes, starts, self.size, b) for b in _BASES)
        at = np.searchsorted(self.one, one)
        found = np.full(len(starts), -1)
        for j in range(self.most):
            there = np.minimum(at + j, len(self.one) - 1)
            same = (self.one[there] == one) & (self.two[there] == two)
            found[same] = there[same]
        return starts[found >= 0], found[found >= 0]


class Block:
    """Index of a block of benchmark items."""

    def __init__(self, names: list[str], texts: pa.Array, span: int):
        self.names = np.array(names, dtype=object)
        words = Words(*utf8_buffers(texts), NON_ALNUM)
        sizes = np.diff(words.first)
        self.windows = []
        for size in sorted({int(min(s, span)) for s in sizes if s}):
            held = np.flatnonzero(sizes >= span if size == span else sizes == size)
            counts = sizes[held] - size + 1
            starts = expand_ranges(words.first[held], counts)
            self.windows.append(_Windows(words, starts, np.repeat(held, counts), size))

    def match(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Per word whether it is hit; per text with hits, its items."""
        n = len(words.hashes)
        cover = np.zeros(n + 1, np.int64)
        pairs = []
        for windows in self.windows:
            starts, which = windows.find(words)
            if len(starts):
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + windows.size, -1)
                row = np.searchsorted(words.first, starts, side="right") - 1
                met = np.unique(np.stack([row, which]), axis=1)
                counts = windows.first[met[1] + 1] - windows.first[met[1]]
                items = windows.items[expand_ranges(windows.first[met[1]], counts)]
                pairs.append(np.stack([np.repeat(met[0], counts), items]))
        items: dict[int, set[str]] = {}
        if pairs:
            for row, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
                items.setdefault(int(row), set()).add(self.names[item])
        return np.cumsum(cover[:-1]) > 0, items


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.where("item is not null and text is not null").dropDuplicates()


def _is_small(items: DataFrame, most: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most


def _broadcast(items: DataFrame, span: int):
    """The whole benchmark as one broadcast index."""
    table = items.toArrow()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    return items.sparkSession.sparkContext.broadcast(Block(table.column("item").to_pylist(), texts, span))


# -- a benchmark of any size ----------------------------------------------------


def _bit_of(fingerprints: np.ndarray, size: int) -> np.ndarray:
    """Place of a fingerprint in the bit table."""
    with np.errstate(over="ignore"):
        return (mix64(fingerprints + U64(size)) >> U64(64 - TABLE_BITS)).astype(np.int64)


def _bench_windows(items: DataFrame, span: int) -> DataFrame:
    """``size, kept, one, two, item``: every window of the benchmark."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 2 << 20):
                words = Words(*utf8_buffers(part.column(1)), NON_ALNUM)
                counts = np.diff(words.first)
                for size in sorted({int(min(c, span)) for c in counts if c}):
                    held = np.flatnonzero(counts >= span if size == span else counts == size)
                    many = counts[held] - size + 1
                    starts = expand_ranges(words.first[held], many)
                    kept = _fingerprints(words.hashes, size)[starts]
                    hashes = [_window_hash(words.hashes, starts, size, b) for b in _BASES]
                    columns = [pa.array(np.full(len(starts), size, np.int32)), *[pa.array(h.view(np.int64)) for h in (kept, *hashes)]]
                    yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(pa.array(np.repeat(held, many)))], ["size", "kept", "one", "two", "item"])

    return items.mapInArrow(run, "size int, kept long, one long, two long, item string").distinct()


def _bit_table(windows: DataFrame):
    """Broadcast table of 2**TABLE_BITS bits: which fingerprints the benchmark may have."""
    per = 1 << SEGMENT_BITS

    def mark(batches):
        found = []
        for batch in batches:
            sizes, kept = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            found += [np.unique(_bit_of(kept[sizes == s], int(s))) for s in np.unique(sizes)]
        places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for segment in np.unique(places // per):
            bits = np.zeros(per, bool)
            bits[places[places // per == segment] % per] = True
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([every.tobytes()], pa.binary())})

    marked = windows.select("size", "kept").mapInArrow(mark, "segment long, bits binary")
    table = np.zeros(1 << TABLE_BITS, bool)
    for segment, bits in marked.groupBy("segment").applyInArrow(merge, "segment long, bits binary").collect():
        table[segment * per : (segment + 1) * per] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return windows.sparkSession.sparkContext.broadcast(np.packbits(table))


def _candidates(docs: DataFrame, text: str, windows: DataFrame, keep_text: bool) -> DataFrame:
    """``docs`` plus ``row, n_words, found``: the windows (size, start, one, two) that pass the bit table."""
    shared, sizes = _bit_table(windows), sorted(r[0] for r in windows.select("size").distinct().collect())
    names = docs.columns
    at = names.index(text)
    kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("one", pa.int64()), ("two", pa.int64())]))

    def run(batches):
        bits = shared.value
        for batch in batches:
            for part in text_slices(batch, at, 2 << 20):
                words = Words(*utf8_buffers(part.column(at)), NON_ALNUM)
                found = []
                for size in sizes:
                    if len(words.hashes) < size:
                        continue
                    kept = _fingerprints(words.hashes, size)
                    place = _bit_of(kept, size)
                    starts = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    row = np.searchsorted(words.first, starts, side="right") - 1
                    inside = starts + size <= words.first[row + 1]
                    starts, row = starts[inside], row[inside]
                    hashes = [_window_hash(words.hashes, starts, size, b).view(np.int64) for b in _BASES]
                    found.append(np.stack([row, np.full(len(starts), size), starts - words.first[row], *hashes]))
                table = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
                table = table[:, np.argsort(table[0], kind="stable")]
                cuts = pa.array(np.searchsorted(table[0], np.arange(part.num_rows + 1)).astype(np.int32))
                struct = pa.StructArray.from_arrays([pa.array(table[1].astype(np.int32)), *[pa.array(c) for c in table[2:]]], fields=list(kind.value_type))
                columns = [c for i, c in enumerate(part.columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(cuts, struct)], out)

    out = [*[n for n in names if keep_text or n != text], "n_words", "found"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != text)
    signed = docs.mapInArrow(run, f"{schema}, n_words long, found array<struct<size:int,start:long,one:long,two:long>>")
    return materialize(signed.withColumn("row", F.monotonically_increasing_id()), "decontamination")


def _hits(signed: DataFrame, windows: DataFrame) -> DataFrame:
    """``row, size, start, one, two`` of the document windows that the benchmark has."""
    found = materialize(signed.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*"), "candidates")
    keys = materialize(windows.select("size", "one", "two").distinct(), "windows")
    return materialize(found.join(keys, ["size", "one", "two"], "left_semi"), "hits")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans`` are the maximal runs of hit words (start, end exclusive), ``items`` the ids,
    as sorted strings, of the items with windows in the document.  Null or empty text has
    no words and no hits; items without id or text are skipped; repeated rows each give
    a row; other columns are ignored; either table may be empty.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = mine.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_words", "spans", "items"]
    schema = f"doc_id {id_type}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    items = _items(benchmark, item_col, item_text_col)
    if _is_small(items, block_bytes):
        shared = _broadcast(items, span)

        def match(batches):
            for batch in batches:
                for part in text_slices(batch, 1, 2 << 20):
                    words = Words(*utf8_buffers(part.column(1)), NON_ALNUM)
                    hit, found = shared.value.match(words)
                    spans, held = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                    for row, own in found.items():
                        spans[row] = [{"start": a, "end": b} for a, b in _runs(hit[words.first[row] : words.first[row + 1]])]
                        held[row] = sorted(own)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, span_type), pa.array(held, pa.list_(pa.string()))], names)

        return mine.mapInArrow(match, schema)
    windows = materialize(_bench_windows(items, span), "windows")
    signed = _candidates(mine, "text", windows, False)
    hits = _hits(signed, windows)
    places = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("places"))
    held = hits.select("row", "size", "one", "two").distinct().join(windows.select("size", "one", "two", "item"), ["size", "one", "two"])
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))

    def join_spans(batches):
        for batch in batches:
            spans = []
            for listed in batch.column(2).to_pylist():
                runs: list[dict] = []
                for p in listed or ():
                    if runs and p["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], p["end"])
                    else:
                        runs.append(p)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span_type), batch.column(3)], names)

    joined = signed.select("row", "doc_id", "n_words").join(places, "row", "left").join(held, "row", "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.select("doc_id", "n_words", "places", F.coalesce("items", none).alias("items")).mapInArrow(join_spans, schema)


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns as they are.

    Rows with null or empty text stay, repeated rows are judged each; items without id or text are
    skipped; columns may carry any names; either table may be empty.
    """
    at = docs.columns.index(text_col)
    items = _items(benchmark, item_col, item_text_col)
    if _is_small(items, block_bytes):
        shared = _broadcast(items, span)

        def clean(batches):
            for batch in batches:
                for part in text_slices(batch, at, 2 << 20):
                    _, found = shared.value.match(Words(*utf8_buffers(part.column(at)), NON_ALNUM))
                    keep = np.ones(part.num_rows, bool)
                    keep[list(found)] = False
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(clean, docs.schema)
    private = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    windows = materialize(_bench_windows(items, span), "windows")
    signed = _candidates(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in private.items()]), private[text_col], windows, True)
    gone = materialize(_hits(signed, windows).select("row").distinct(), "gone")
    if gone.count() <= MAX_BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return signed.join(gone, "row", "left_anti").select(*[F.col(n).alias(c) for c, n in private.items()])
