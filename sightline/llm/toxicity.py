"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; the probabilities of the
earlier ones are features of the later ones, which are trained on out-of-fold
predictions, so that training sees what prediction will see.

Word statistics come from all labelled documents, by mergeable counts per fold; they choose the
features, for a fold's models without that fold's documents.  The models are fitted on the
driver, on at most ``sample`` labelled rows (those with the least hashes of their ids) and a
fixed number of features.  Every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import NON_ALNUM, Words, materialize, text_slices, utf8_buffers

#: Bounds of the fit: labelled rows, features chosen for each category, folds.
SAMPLE, FEATURES, FOLDS = 8_000, 256, 5
#: Fewest labelled documents that must hold a word for it to become a feature.
LEAST_DOCS = 4
#: Least chi-squared statistic of a feature: far beyond what chance gives the best of all words.
LEAST_CHI = 24.0
#: Besides whole words, their first bytes are features: inflected forms share them.
PREFIXES = (4, 5, 6)
MAX_BROADCAST_LABELS = 500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Design:
    """A sparse 0/1 matrix (``row``, ``column`` of its ones) beside a few dense columns and a constant.

    Products are plain sums: threaded linear algebra libraries can stand still in a process
    that has started a JVM, and their sums depend on the threads.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int], dense: np.ndarray):
        self.row, self.column, (self.rows, self.width), self.dense = row, column, shape, dense
        by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
        self._columns, self._rows = column[by_row], row[by_column]
        (self._row_at, self._row_first), (self._column_at, self._column_first) = (np.unique(a, return_index=True) for a in (row[by_row], column[by_column]))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.full(self.rows, w[-1])
        if len(self._columns):
            out[self._row_at] += np.add.reduceat(w[self._columns], self._row_first)
        for j in range(self.dense.shape[1]):
            out += self.dense[:, j] * w[self.width + j]
        return out

    def back(self, u: np.ndarray) -> np.ndarray:
        """Transposed product."""
        out = np.zeros(self.width + self.dense.shape[1] + 1)
        if len(self._rows):
            out[self._column_at] = np.add.reduceat(u[self._rows], self._column_first)
        out[self.width : -1] = (self.dense * u[:, None]).sum(0)
        out[-1] = u.sum()
        return out

    def part(self, keep: np.ndarray) -> "Design":
        """The rows where ``keep`` holds."""
        number = np.cumsum(keep) - 1
        some = keep[self.row]
        return Design(number[self.row[some]], self.column[some], (int(keep.sum()), self.width), self.dense[keep])


def fit_logistic(x: Design, y: np.ndarray, *, penalty: float = 1e-3, rounds: int = 300, least: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) of an L2-penalized logistic regression, until no gradient exceeds ``least`` or ``rounds`` are over.

    Accelerated steps with restarts; a column's step follows from a bound of the curvature (a
    quarter of each one times its row's sum, which holds for entries that are not negative).
    """
    n = max(1, x.rows)
    keep = np.full(x.width + x.dense.shape[1] + 1, penalty)
    keep[-1] = 0
    curve = 0.25 * x.back(x.times(np.ones(len(keep)))) / n + keep + 1e-9
    w = z = np.zeros(len(keep))
    k = 0
    for _ in range(rounds):
        grad = x.back(_sigmoid(x.times(z)) - y) / n + keep * z
        if np.abs(grad).max() < least:
            break
        new = z - grad / curve
        if (grad * (new - w)).sum() > 0:
            k = 0
        z = new + k / (k + 3) * (new - w)
        w = new
        k += 1
    return w


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and word prefix."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    texts, hashes = [text], [words.hashes]
    for size in PREFIXES:
        which, found = words.prefixes(size)
        texts.append(text[which])
        hashes.append(found)
    return np.concatenate(texts), np.concatenate(hashes)


class Chain:
    """Fitted chain: feature hashes (sorted), per category weights and threshold."""

    def __init__(self, features: np.ndarray, categories: list[str]):
        self.features, self.categories = features, categories
        self.weights: list[np.ndarray] = []
        self.thresholds: list[float] = []

    def fit(self, found: tuple[np.ndarray, np.ndarray], known: np.ndarray, chosen: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> "Chain":
        """``found``: row and number in ``known`` (hashes) of each feature present; ``chosen``: for every fold
        the features chosen without it; ``labels``: a column for each category, -1 where unknown."""
        row, feature = found

        def design(features: np.ndarray, dense: np.ndarray) -> Design:
            at = np.searchsorted(features, known[feature])
            at[at == len(features)] = 0
            some = np.flatnonzero(features[at] == known[feature]) if len(features) else np.zeros(0, np.int64)
            return Design(row[some], at[some], (len(labels), len(features)), dense)

        chain = np.zeros((len(labels), 0))
        for j in range(len(self.categories)):
            y = labels[:, j]
            have = y >= 0
            apart = np.zeros(len(labels))
            for f in range(FOLDS):
                x = design(chosen[f], chain)
                w = fit_logistic(x.part(have & (folds != f)), y[have & (folds != f)])
                apart[folds == f] = _sigmoid(x.part(folds == f).times(w))
            self.weights.append(fit_logistic(design(self.features, chain).part(have), y[have]))
            self.thresholds.append(best_threshold(apart[have], y[have]))
            chain = np.hstack([chain, apart[:, None]])
        return self

    def predict(self, words: Words) -> np.ndarray:
        """Probabilities, a column for each category."""
        n = len(words.first) - 1
        text, feature = presence(words, self.features)
        out = np.zeros((n, len(self.categories)))
        for j, w in enumerate(self.weights):
            out[:, j] = _sigmoid(Design(text, feature, (n, len(self.features)), out[:, :j]).times(w))
        return out


def presence(words: Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and number in ``features`` (sorted) of each feature present, each pair once."""
    if not len(features) or not len(words.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, hashes = tokens(words)
    at = np.searchsorted(features, hashes)
    at[at == len(features)] = 0
    met = np.flatnonzero(features[at] == hashes)
    pairs = np.unique(text[met] * len(features) + at[met])
    return pairs // len(features), pairs % len(features)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below the cut that maximizes F1; 0.5 where there are no positives."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    if not y.sum():
        return 0.5
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[1:] < p[:-1], True)  # cuts between equal predictions do not exist
    k = int(np.where(last, f1, -1).argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def _labelled(docs: DataFrame, labels: DataFrame, categories: list[str], most: int) -> DataFrame:
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(f"y{j}") for j, c in enumerate(categories)])
    if labels.count() <= most:
        marks = F.broadcast(marks)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.join(marks, "doc_id").select("doc_id", "text", fold, *[F.coalesce(f"y{j}", F.lit(-1)).alias(f"y{j}") for j in range(len(categories))])


def _choose_features(labelled: DataFrame, n: int, features: int) -> list[np.ndarray]:
    """Hashes of the words and prefixes with the largest chi-squared statistics for any category.

    One set without each fold's documents, and last one over all.
    """
    width = 1 + n  # documents, and those of each category
    columns = [f"c{f}_{j}" for f in range(FOLDS) for j in range(width)]

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            words, key = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            order = np.argsort(words, kind="stable")
            words, key = words[order], key[order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
            counts = np.zeros((len(columns), len(first)), np.int64)
            for j in range(width):
                some = key[:, j + 1] > 0
                np.add.at(counts, (key[some, 0] * width + j, number[some]), 1)
            return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), *[pa.array(c) for c in counts]], ["word", *columns])

        size = 0
        for batch in batches:
            for part in text_slices(batch, 0, 2 << 20):
                text, hashes = tokens(Words(*utf8_buffers(part.column(0)), NON_ALNUM))
                order = np.lexsort((hashes, text))
                h, t = hashes[order], text[order]
                new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
                h, t = h[new], t[new]
                if not len(h):
                    continue
                marks = np.stack([part.column(1).to_numpy(), np.ones(part.num_rows, int), *[part.column(2 + j).to_numpy() == 1 for j in range(n)]], axis=1).astype(np.int64)
                held.append((h, marks[t]))
                size += len(h)
                if size > 1_000_000:
                    yield merged()
                    size = 0
        if held:
            yield merged()

    counted = labelled.select("text", "fold", *[f"y{j}" for j in range(n)]).mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in columns))
    words = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    totals = np.zeros((FOLDS, width))
    for r in labelled.groupBy("fold").agg(F.count("*"), *[F.sum((F.col(f"y{j}") == 1).cast("long")) for j in range(n)]).collect():
        totals[r[0]] = r[1:]
    scored = []
    for left_out in range(FOLDS + 1):
        used = [f for f in range(FOLDS) if f != left_out]
        every, *positives = totals[used].sum(0)
        of = lambda j: sum((F.col(f"c{f}_{j}") for f in used), F.lit(0))  # noqa: B023, E731
        for j, positive in enumerate(positives, start=1):
            if 0 < positive < every:
                d = of(0).cast("double")
                gap = of(j) * F.lit(float(every)) - d * float(positive)
                spread = d * (F.lit(float(every)) - d) * float(positive) * float(every - positive)
                chi = F.when(of(0) >= LEAST_DOCS, F.try_divide(gap * gap * float(every), spread))
                scored.append(F.struct(F.lit(left_out).alias("left_out"), F.lit(j).alias("category"), chi.alias("chi")))
    chosen: list[set] = [set() for _ in range(FOLDS + 1)]
    if scored:
        long = words.select("word", F.explode(F.array(*scored)).alias("s")).select("word", "s.*").where(F.col("chi") >= LEAST_CHI)
        rank = F.row_number().over(Window.partitionBy("left_out", "category").orderBy(F.desc("chi"), "word"))
        for r in long.withColumn("rank", rank).where(F.col("rank") <= features).select("left_out", "word").collect():
            chosen[r[0]].add(r[1])
    return [np.sort(np.array(sorted(c), dtype=np.int64).view(np.uint64)) for c in chosen]


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], *, sample: int = SAMPLE, features: int = FEATURES, max_broadcast_labels: int = MAX_BROADCAST_LABELS
) -> Chain:
    """Fit a chain over ``categories`` (0/1 columns of ``labels``, null unknown) on ``docs`` (``doc_id, text``).

    The rows to fit on are the ``sample`` least by a hash of the id (ties, repeated rows among
    them: by the hash of the text), so they do not depend on the partitioning.
    """
    labelled = materialize(_labelled(docs, labels, categories, max_broadcast_labels), "labelled")
    *chosen, final = _choose_features(labelled, len(categories), features)
    known = np.unique(np.concatenate([*chosen, final]))
    chain = Chain(final, categories)
    total = labelled.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    # a generous cut first, so that little is ranked; where it leaves too few, all rows are
    near = labelled.where(place < int(1_000_000 * min(1.0, 2 * sample / max(1, total))))
    near = near if total <= sample or near.count() >= sample else labelled
    picked = near.orderBy(place, "doc_id", F.xxhash64("text")).limit(sample)
    marks = [f"y{j}" for j in range(len(categories))]

    def find(batches):
        for batch in batches:
            for part in text_slices(batch, 0, 2 << 20):
                text, feature = presence(Words(*utf8_buffers(part.column(0)), NON_ALNUM), known)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = [feature[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lists, pa.list_(pa.int32()))], ["place", "fold", *marks, "found"])

    kinds = "place long, fold int, " + ", ".join(f"{m} int" for m in marks)
    rows = picked.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("place"), "fold", *marks).mapInArrow(find, f"{kinds}, found array<int>").toArrow()
    rows = rows.sort_by("place")  # sums of the fit in one order
    held = rows.column("found").to_pylist()
    found = (np.repeat(np.arange(len(held)), [len(h) for h in held]), np.array([c for h in held for c in h], dtype=np.int64))
    y = np.stack([rows.column(m).to_numpy() for m in marks], axis=1).astype(float) if rows.num_rows else np.zeros((0, len(categories)))
    return chain.fit(found, known, chosen, y, rows.column("fold").to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``p_<category>`` and ``is_<category>`` for each category.

    A category's flag is set where its probability reaches the threshold with the best
    out-of-fold F1.  Null or empty text has no words and gets the base rates; null ids are
    scored but never used for training; of several labels for an id the largest counts;
    without labels every probability is 0.5 and no flag is set; repeated rows each give a
    row; equal statistics and equal places in the sample are decided by hashes of the word, id
    and text; a flag needs a probability above the threshold; other columns are ignored; an empty table gives an empty result.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chain = fit_chain(mine, labels, categories, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    id_type = mine.schema["doc_id"].dataType.simpleString()

    def score(batches):
        chain = shared.value
        limits = np.array(chain.thresholds)
        for batch in batches:
            for part in text_slices(batch, 1, 2 << 20):
                p = chain.predict(Words(*utf8_buffers(part.column(1)), NON_ALNUM))
                flags = p > limits
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in p.T], *[pa.array(c) for c in flags.T]], names)

    names = ["doc_id", *[f"p_{c}" for c in categories], *[f"is_{c}" for c in categories]]
    schema = f"doc_id {id_type}, " + ", ".join(f"`p_{c}` double" for c in categories) + ", " + ", ".join(f"`is_{c}` boolean" for c in categories)
    return mine.mapInArrow(score, schema)
