"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A set of files is a folder with

* ``dictionary.zdict`` - the dictionary, trained on serialized id arrays of a bounded sample;
* ``shard-PPPPPP-KKKK.tok`` - shards in ascending document order;
* ``manifest`` - a Parquet table: shard path, documents, ids, ids before the shard.

Shard layout (little endian)::

    magic (8) | SHA-256 of the dictionary (32) | frames ... | index | footer (24)
    index: per document  frame offset u64, frame length u32, ids u32, key length i32, key bytes
    footer: index offset u64, documents u64, magic (8)

A frame is one document's ids (unsigned 32 bit) with the end id appended.  Reading a
document needs the footer, the index and that document's frame, nothing else.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.bpe import load
from sightline.llm.common import materialize, text_slices

MAGIC = b"TOKIDS01"
_ENTRY = struct.Struct("<QIIi")
_FOOTER = struct.Struct("<QQ8s")
#: Bound of the dictionary's training sample.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 2048, 65_536
#: Most tasks that read a folder.
MOST_READERS = 10_000


def filesystem(uri: str):
    """pyarrow filesystem and path of ``uri`` (file, s3, gs or hdfs)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; with too few samples, their bytes as a raw dictionary."""
    import zstandard

    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _codec(dictionary: bytes, level: int | None):
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    if level is None:
        return zstandard.ZstdDecompressor(**shared)
    return zstandard.ZstdCompressor(level=level, write_content_size=True, **shared)


class ShardWriter:
    """Writes one shard under a temporary name; ``close`` moves it into place."""

    def __init__(self, uri: str, dictionary: bytes, level: int, attempt: int):
        self.fs, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{attempt}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.codec, self.index, self.at = _codec(dictionary, level), [], len(MAGIC) + 32
        self.docs = self.ids = 0

    def add(self, key: str | None, ids: np.ndarray) -> None:
        frame = self.codec.compress(ids.astype("<u4").tobytes())
        raw = b"" if key is None else key.encode()
        self.out.write(frame)
        self.index.append(_ENTRY.pack(self.at, len(frame), len(ids), -1 if key is None else len(raw)) + raw)
        self.at += len(frame)
        self.docs += 1
        self.ids += len(ids)

    def close(self) -> None:
        self.out.write(b"".join(self.index) + _FOOTER.pack(self.at, self.docs, MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, docs, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        raw = self.file.read_at(size - _FOOTER.size - index_at, index_at)
        self.entries, at = [], 0
        for _ in range(docs):
            offset, length, ids, key = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            self.entries.append((offset, length, ids, None if key < 0 else raw[at : at + key].decode()))
            at += max(key, 0)
        self.codec = _codec(dictionary, None)

    def __len__(self) -> int:
        return len(self.entries)

    def key(self, i: int) -> str | None:
        return self.entries[i][3]

    def ids(self, i: int) -> bytes:
        """The i-th document's ids as little-endian unsigned 32-bit integers."""
        offset, length, ids, _ = self.entries[i]
        return self.codec.decompress(self.file.read_at(length, offset), max_output_size=4 * ids)

    def close(self) -> None:
        self.file.close()


def _sample(docs: DataFrame, tokenizer_path: str) -> list[bytes]:
    """Serialized ids of a bounded sample: ranges, from anywhere in them, of the documents with the smallest key hashes.

    A cut on the hash leaves about four times as many rows as needed before the rest is ranked.
    """
    total = max(1, docs.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    near = docs.where(place < int(2**31 * min(1.0, 4 * SAMPLE_DOCS / total)))
    picked = near.orderBy(place, F.col("doc_id")).limit(SAMPLE_DOCS)

    def encode(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            ids = []
            for text, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = bpe.encode(text or "").astype("<u4")
                start = place % max(1, len(own) - SAMPLE_IDS + 1)
                ids.append(own[start : start + SAMPLE_IDS].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return [bytes(r[0]) for r in picked.select("text", place.alias("place")).mapInArrow(encode, "ids binary").collect()]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    level: int = 3,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """Write all documents in ascending ``id_col`` order; returns the manifest.

    Null text counts as empty (one id: the end id); a null key sorts first and is read
    back as null; repeated keys keep all rows, ordered by text.  An empty table gives
    an empty manifest.  Each task writes its shards under temporary names and moves
    them into place, so a repeated task leaves the same files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(_sample(docs, tokenizer_path))
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zdict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        bpe, writer, made = load(tokenizer_path), None, []

        def finish():
            writer.close()
            made.append((part, len(made), f"{folder}/shard-{part:06d}-{len(made):04d}.tok", writer.docs, writer.ids))

        for batch in batches:
            for piece in text_slices(batch, 1, 8 << 20):
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if writer is None:
                        writer = ShardWriter(f"{folder}/shard-{part:06d}-{len(made):04d}.tok", shared.value, level, attempt)
                    writer.add(key, np.append(bpe.encode(text or ""), np.uint32(end_id)))
                    if writer.at >= shard_bytes:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        if made:  # the manifest's rows: written by the tasks, never gathered
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["part", "shard", "path", "docs", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    made = placed.select(F.col("doc_id").cast("string"), "text").mapInArrow(write, "part int, shard int, path string, docs long, ids long")
    made = materialize(made, "shards")
    earlier = lambda w, order: F.coalesce(F.sum("ids").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = made.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.partitionBy(F.lit(0)), "part").alias("part_before"))  # a row a task
    inside = made.select("part", "path", "docs", "ids", earlier(Window.partitionBy("part"), "shard").alias("own_before"))
    manifest = inside.join(parts, "part").select("path", "docs", "ids", (F.col("own_before") + F.col("part_before")).alias("before"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema("path string, docs long, ids long, before long").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """All documents of a folder: ``doc_id, start, n_tokens, ids`` (binary, 4 bytes an id).

    ``start`` is the number of ids of all documents before.
    """
    manifest = spark.read.schema("path string, docs long, ids long, before long").parquet(f"{folder}/manifest")
    shards = min(MOST_READERS, max(1, manifest.count()))

    def read(batches):
        fs, base = filesystem(folder)
        with fs.open_input_file(f"{base}/dictionary.zdict") as file:
            dictionary = file.read()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path, dictionary)
                at = 0
                while at < len(reader):
                    keys, starts, sizes, ids, held = [], [], [], [], 0
                    while at < len(reader) and held < 4 << 20:
                        raw = reader.ids(at)
                        keys.append(reader.key(at))
                        starts.append(start)
                        sizes.append(len(raw) // 4)
                        ids.append(raw)
                        start += len(raw) // 4
                        held += len(raw)
                        at += 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                reader.close()

    found = manifest.select("path", "before").repartition(shards).mapInArrow(read, "doc_id string, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))
