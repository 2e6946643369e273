"""Packing token pieces into fixed-length sequences as a cutting-stock problem.

A document's ids are cut into pieces of at most the sequence length.  Only the
histogram of piece lengths reaches the driver, in classes: exact lengths up to ``exact``
ids, multiples of ``granularity`` above; at most ``exact + length / granularity`` numbers,
whatever the corpus size.  There

* a linear program over patterns (how many pieces of each class share a sequence) is
  solved by column generation; a knapsack dynamic program prices new patterns;
* the solution is rounded down, and what remains is packed largest-first.

Pieces are ranked within their class without any global sort (a running number in
each task plus the totals of earlier tasks) and the rank selects the pattern slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.bpe import load
from sightline.llm.common import materialize, scratch_path, text_slices


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts of an unbounded knapsack, by dynamic programming.

    One item after the other is allowed, in doubling numbers of copies, for all capacities at once.
    """
    n = len(sizes)
    best = np.zeros((n + 1, capacity + 1))
    spare = np.empty(capacity + 1)
    for i in range(n):
        row, s, v = best[i + 1], int(sizes[i]), float(values[i])
        row[:] = best[i]
        if v <= 0:
            continue
        copies, most = 1, capacity // s
        while most > 0:
            k = min(copies, most)
            gain = spare[: capacity + 1 - k * s]
            np.add(row[: capacity + 1 - k * s], k * v, out=gain)
            np.maximum(row[k * s :], gain, out=row[k * s :])
            most -= k
            copies *= 2
    counts, w = np.zeros(n, np.int64), capacity
    for i in range(n - 1, -1, -1):
        s, v = int(sizes[i]), float(values[i])
        if best[i + 1, w] > best[i, w]:
            k = np.arange(w // s + 1)
            counts[i] = int((best[i, w - k * s] + k * v).argmax())
            w -= int(counts[i]) * s
    return float(best[n, capacity]), counts


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with row pivots.

    Elementwise on purpose, as is all arithmetic here: threaded linear algebra libraries can
    stand still in a process that has started a JVM, and their sums depend on the threads.
    """
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        some = np.flatnonzero(factor)
        work[some] -= factor[some, None] * work[i]
    return work[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """``matrix`` times ``vector``, elementwise (see :func:`inverse_of`)."""
    return (matrix * vector).sum(1)


def _start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible triangular basis with its costs and values: patterns filled largest first.

    Where larger items' patterns already hold enough of an item, its column is a surplus.
    """
    n = len(sizes)
    basis, cost, x = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    left = demand.astype(float)
    for i in range(n - 1, -1, -1):
        if left[i] <= 0:
            basis[i, i], x[i] = -1, -left[i]
            continue
        room, cost[i] = capacity, 1
        for j in range(i, -1, -1):
            if sizes[j] <= room and left[j] > 0:
                basis[j, i] = room // sizes[j]
                room -= int(basis[j, i] * sizes[j])
        x[i] = left[i] / basis[i, i]
        left -= basis[:, i] * x[i]
        left[i] = 0
    return basis, cost, x


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Linear program: fewest sequences that hold at least ``demand[i]`` items of ``sizes[i]``.

    Revised simplex with generated columns: patterns by the knapsack, at cost 1, and surplus
    columns (an item too many), at cost 0, while a dual is negative.  Stops at an optimal
    basis or when the dual bound proves the rest smaller than ``gap``.  Returns patterns
    (rows) and how often each is used (real numbers).
    """
    basis, cost, x = _start(sizes, demand, capacity)
    inverse = inverse_of(basis)
    bound = float((sizes * demand).sum()) / capacity
    for k in range(most):
        if (cost * x).sum() - bound <= gap * (cost * x).sum():
            break
        duals = _times(inverse.T, cost)
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            column, price = np.zeros(len(sizes)), 0.0
            column[low] = -1
        else:
            value, column = knapsack(np.maximum(duals, 0), sizes, capacity)
            price = 1.0
            bound = max(bound, float((np.maximum(duals, 0) * demand).sum()) / max(value, 1.0))
            if value <= 1 + 1e-9:
                break
        direction = _times(inverse, column)
        up = np.flatnonzero(direction > 1e-10)
        if not len(up):
            break
        ratio = x[up] / direction[up]
        leave = up[int(ratio.argmin())]
        basis[:, leave], cost[leave] = column, price
        if k % 64 == 63:  # rounding errors do not pile up
            inverse = inverse_of(basis)
        else:
            row = inverse[leave] / direction[leave]
            inverse -= direction[:, None] * row
            inverse[leave] = row
        x = np.maximum(_times(inverse, demand), 0)
    real = cost > 0
    return basis.T[real].round().astype(np.int64), x[real]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns for all items of ``histogram`` (class size -> number): (repeats, {size: items})."""
    sizes = np.array(sorted(s for s, k in histogram.items() if k), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns, x = solve_patterns(sizes, left.astype(float), capacity)
    plan = []

    def use(pattern: np.ndarray, times: int) -> None:
        """``times`` sequences of ``pattern``, as far as items are left."""
        take = np.minimum(pattern * times, left)
        some = take > 0
        if some.any():
            times = int((-(-take[some] // pattern[some])).max())
            plan.append((times, {int(s): int(p) for s, p in zip(sizes[some], pattern[some], strict=True)}))
            left[some] -= take[some]

    for i in np.argsort(-x, kind="stable"):
        if x[i] >= 1 - 1e-9:
            use(patterns[i], int(x[i] + 1e-9))
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        some = pattern > 0
        use(pattern, int((left[some] // pattern[some]).min()))
    return plan


def cut_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str, text_col: str, length: int, granularity: int, exact: int, end_id: int) -> DataFrame:
    """Pieces of all documents with their ids: full pieces, then the remainder.

    ``part`` is the task that made a piece, ``rank`` its number there within its class.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        bpe, part = load(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            for slice_ in text_slices(batch, 1, 4 << 20):
                at, starts, sizes, totals, ranks, classes, ids = [], [], [], [], [], [], []
                for i, text in enumerate(slice_.column(1).to_pylist()):
                    all_ids = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(all_ids), length):
                        piece = all_ids[start : start + length]
                        size_class = len(piece) if len(piece) <= exact else -(-len(piece) // granularity) * granularity
                        at.append(i)
                        starts.append(start)
                        sizes.append(len(piece))
                        totals.append(len(all_ids))
                        classes.append(size_class)
                        ranks.append(seen[size_class])
                        seen[size_class] += 1
                        ids.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [slice_.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                     pa.array(np.full(len(at), part), pa.int32()), pa.array(classes, pa.int32()), pa.array(ranks, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "part", "size_class", "rank", "ids"],
                )

    return docs.mapInArrow(cut, f"doc_id {id_type}, start long, length long, doc_tokens long, part int, size_class int, rank long, ids binary")


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per class: rows (first rank, items a sequence, first sequence), by first rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, items in plan:
        for size, each in items.items():
            rows.setdefault(size, []).append((ranks.get(size, 0), each, sequence))
            ranks[size] = ranks.get(size, 0) + times * each
        sequence += times
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    granularity: int = 8,
    exact: int = 128,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, doc_tokens, sequence_id,
    offset, piece, ids_crc32, path`` where ``path`` names the table that holds the ids of each ``piece``.

    Null text counts as empty: one piece with the end id alone.  Repeated rows are packed
    each; a null id stays null; other columns are ignored; an empty table gives no pieces.
    """
    if length % granularity:
        raise ValueError("length must be a multiple of granularity")
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer_path, id_col=id_col, text_col=text_col, length=length, granularity=granularity, exact=exact, end_id=end_id)
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id()).withColumn("ids_crc32", F.crc32("ids"))
    path = scratch_path(spark, "pieces")
    pieces = materialize(pieces, "pieces", path)
    meta = pieces.drop("ids")
    totals = materialize(meta.groupBy("part", "size_class").agg(F.count("*").alias("n")), "class-totals")
    histogram = {r[0]: r[1] for r in totals.groupBy("size_class").agg(F.sum("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(histogram, length)))
    earlier = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", "size_class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = meta.join(before, ["part", "size_class"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "start", "length", "doc_tokens", "size_class", "rank", "piece", "ids_crc32"]
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}

    def place(batches):
        for batch in batches:
            classes = batch.column(4).to_numpy(zero_copy_only=False)
            ranks = batch.column(5).to_numpy(zero_copy_only=False)
            out = np.zeros(len(ranks), np.int64)
            for size in np.unique(classes):
                rows, some = slots.value[int(size)], classes == size
                row = rows[np.searchsorted(rows[:, 0], ranks[some], side="right") - 1]
                out[some] = row[:, 2] + (ranks[some] - row[:, 0]) // row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*columns, "sequence_id"])

    placed = ranked.select(*columns).mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size_class"), "rank")
    offset = F.sum("length").over(inside) - F.col("length")
    return placed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", offset.alias("offset"), "piece", "ids_crc32", F.lit(path).alias("path"))


def sequences(packed: DataFrame, *, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed token sequences: ``sequence_id, ids`` (array of ``length`` ids).

    Sequences whose number of ids is a power of two stay as they are; all others are
    padded with ``pad_id``.  A sequence holds at most ``length`` pieces.
    """
    spark = packed.sparkSession
    paths = [r[0] for r in packed.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "sequence_id long, ids array<int>")
    ids = spark.read.parquet(*paths).select("piece", "ids")
    joined = packed.select("piece", "sequence_id", "offset").join(ids, "piece")
    grouped = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))

    def build(batches):
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                got = np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32)
                short = length - len(got)
                out.append(got if len(got) & (len(got) - 1) == 0 else np.pad(got, (0, short), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return grouped.mapInArrow(build, "sequence_id long, ids array<int>")
