"""Token counts by distinct pre-token.

1. Every text is split by the vocabulary's pre-token pattern; piece frequencies are
   pre-aggregated per task and summed, which gives the distinct pieces.
2. The library counts the ids of each distinct piece once.
3. Per-document piece frequencies join the piece counts.  Frequent pieces - a bounded
   number, chosen by a frequency threshold - are joined inside the scan through a
   broadcast table, so no hot key is ever shuffled; the rest joins by shuffle.
No id is materialised for a document.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.bpe import PATTERN, load
from sightline.llm.common import materialize, text_slices

#: Most pieces that are broadcast (about 100 bytes each in a worker).
MAX_BROADCAST_PIECES = 200_000
_FLUSH = 300_000


def _splitter(path: str):
    """Function text -> (pieces, number of special tokens)."""
    import re

    import regex

    tokenizer = load(path)
    if not tokenizer.splits:
        return lambda text: ([text], 0)
    find = regex.compile(PATTERN).findall
    specials = list(tokenizer.specials)
    if not specials:
        return lambda text: (find(text), 0)
    either = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))

    def split(text: str):
        if not any(s in text for s in specials):
            return find(text), 0
        parts = either.split(text)
        return [p for part in parts for p in find(part)], len(parts) - 1

    return split


def piece_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Distinct pieces of all texts: ``piece, freq, tokens``."""

    def frequencies(batches):
        split, found = _splitter(path), Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "freq"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(split(text)[0])
                    if len(found) >= _FLUSH:
                        yield rows()
        if found:
            yield rows()

    def tokens(batches):
        bpe = load(path)
        for batch in batches:
            for part in text_slices(batch, 0, 4 << 20):
                counts = bpe.count_pieces(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int32())], ["piece", "freq", "tokens"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(frequencies, "piece string, freq long")
    return found.groupBy("piece").agg(F.sum("freq").alias("freq")).mapInArrow(tokens, "piece string, freq long, tokens int")


def _hot_threshold(pieces: DataFrame, most: int) -> int:
    """Least frequency f such that at most ``most`` pieces have frequency f or more."""
    bits = F.length(F.bin("freq"))
    low = F.expr("freq - freq % shiftleft(1L, greatest(length(bin(freq)) - 5, 0))")
    bins = pieces.groupBy(low.alias("low"), bits.alias("bits")).count().collect()
    total, least = 0, 1 << 62
    for row in sorted(bins, key=lambda r: -r["low"]):
        total += row["count"]
        if total > most:
            break
        least = row["low"]
    return least


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast_pieces: int = MAX_BROADCAST_PIECES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens``.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    each give a row; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialize(piece_counts(docs, tokenizer_path), "pieces")
    least = _hot_threshold(pieces, max_broadcast_pieces)
    spark = docs.sparkSession
    hot = {r[0]: r[1] for r in pieces.where(F.col("freq") >= least).select("piece", "tokens").toLocalIterator()}
    shared = spark.sparkContext.broadcast(hot)

    def measure(batches):
        split, known = _splitter(tokenizer_path), shared.value
        get = known.get
        for batch in batches:
            for part in text_slices(batch, 1, 8 << 20):
                sizes, totals, names, numbers = [], [], [], []
                for text in part.column(1).to_pylist():
                    total, cold = 0, Counter()
                    if text:
                        pieces, total = split(text)
                        for piece in pieces:
                            n = get(piece)
                            if n is None:
                                cold[piece] += 1
                            else:
                                total += n
                    sizes.append(len(text.encode()) if text else 0)
                    totals.append(total)
                    names.append(list(cold))
                    numbers.append(list(cold.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int32()))],
                    ["doc_id", "n_bytes", "tokens", "pieces", "counts"],
                )

    measured = docs.mapInArrow(measure, f"doc_id {id_type}, n_bytes long, tokens long, pieces array<string>, counts array<int>")
    measured = materialize(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
    cold = measured.where(F.size("pieces") > 0).select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("p"))
    cold = cold.select("row", F.col("p.pieces").alias("piece"), F.col("p.counts").alias("n"))
    cold = cold.join(pieces.where(F.col("freq") < least).select("piece", F.col("tokens").alias("each")), "piece")
    none = F.lit(None)
    both = measured.select("row", "doc_id", "n_bytes", "tokens").unionByName(
        cold.select("row", none.cast(id_type).alias("doc_id"), none.cast("long").alias("n_bytes"), (F.col("n") * F.col("each")).cast("long").alias("tokens"))
    )
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens")
