"""Chat formatting: transcripts are parsed by a hidden Markov model over their lines.

A transcript is running text in one or more chunks (``conv, at, text``; lines do not cross
chunks).  Its lines show a speaker marker (or none) and features of their form.  The hidden
states are a role and what the line does in its turn: it begins one, stands inside, or is blank.
The model's probabilities are counts over labelled transcripts; scores are whole
millionths of log probabilities, so sums are exact in any grouping.

Viterbi decoding is dealt over chunks: a chunk's best scores from each state before it to each
state at its end form a matrix.  Matrices of consecutive chunks are multiplied in bounded
groups, level by level; going down again, the states at the borders are fixed, and every
chunk is decoded on its own.  So a conversation of any length is decoded without being
gathered, and its turns come out in pieces, one for each chunk they touch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Characters after which a chunk ends with its turn, and bits of the chunk number that a group leaves out.
CHUNK_CHARS, FAN_BITS = 16_384, 10
#: Bits of a chunk's number within the task that writes it.
PART_BITS = 24
#: Speaker markers at the start of a line, and the role that each names.
MARKERS = {
    "user": ("user", "human", "question", "q", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent"),
    "system": ("system", "instruction", "instructions"),
    "other": ("other", "tool", "function", "observer"),
}
ROLES = tuple(MARKERS)
BEGIN, INSIDE, BLANK = range(3)
STATES = 3 * len(ROLES)
_NAMES = {name: i for i, names in enumerate(MARKERS.values()) for name in names}
_MARKER = re.compile(r"\s*(?:<\|(?:im_start\|>\s*)?(\w{1,20})(?:\|>)?|\[(\w{1,20})\]|#{1,4}\s*(\w{1,20})\s*:?|\*{0,2}(\w{1,20})\*{0,2}\s*:)\s*", re.IGNORECASE)
_END = re.compile(r"\s*<\|(?:im_end|end|eot_id)\|>\s*$")
_NEVER = -(10**12)
#: Values of each line feature: marker (a role or none), size, last character, first character.
SHAPE = (len(ROLES) + 1, 17, 8, 6)
_LAST = {c: i for i, c in enumerate("?!.:;,", start=1)}


def split_marker(line: str) -> tuple[int, str]:
    """The role that a leading speaker marker names (-1 without one), and the line without markers."""
    match = _MARKER.match(line)
    if match:
        role = _NAMES.get(next(g for g in match.groups() if g).lower())
        if role is not None:
            return role, _END.sub("", line[match.end() :])
    return -1, _END.sub("", line)


def line_features(lines: list[str]) -> np.ndarray:
    """What each line shows, a column for each entry of :data:`SHAPE`."""
    out = np.zeros((len(lines), len(SHAPE)), np.int64)
    for i, line in enumerate(lines):
        marker, body = split_marker(line)
        body = body.strip()
        first = body[:1]
        form = 0 if not first else 1 if first.isupper() else 2 if first.islower() else 3 if first.isdigit() else 4 if first.isalpha() else 5
        out[i] = marker, min(16, len(body).bit_length()), _LAST.get(body[-1:], 7 if body else 0), form
    out[:, 0] += 1
    return out


# -- transcripts of known turns -----------------------------------------------

#: How a transcript writes a turn: before it, between its marker and its text, after it.
STYLES = (
    (lambda r: f"{r.title()}: ", ""), (lambda r: f"### {r.title()}:\n", ""), (lambda r: f"<|im_start|>{r}\n", "\n<|im_end|>"), (lambda r: f"[{r}] ", ""),
    (lambda r: {"user": "Q: ", "assistant": "A: "}.get(r, f"{r.title()}: "), ""), (lambda r: f"**{r.title()}**: ", "\n"), (lambda r: "", "\n"),
)


def _written(role: int, text: str, style: int, bare: bool) -> tuple[list[str], list[int]]:
    """Lines of a turn and their states."""
    before, after = STYLES[style]
    lines = (("" if bare else before(ROLES[role])) + text + after).split("\n")
    states = [3 * role + (INSIDE if line.strip() else BLANK) for line in lines]
    states[0] = 3 * role + BEGIN
    return lines, states


def write_transcripts(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_chars: int | None = None) -> DataFrame:
    """``conv, at, text, states``: running transcripts of conversations, with the state of every line.

    The style of a transcript follows from its conversation id, and one marker in sixteen is left out.
    Turns are ordered by turn (null first), then text; repeated turns are all written; null
    conversation ids are one conversation; a null text is empty; a role that is no speaker name
    is ``other``, and rows without a role give no states.  Chunks (``at``, ascending) end between
    turns.  Rows are sorted by ranges, so a hot conversation is spread over tasks.
    """
    chunk_chars = chunk_chars or CHUNK_CHARS
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.col(role_col).cast("string")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumns({"style": F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int"), "bare": F.pmod(F.xxhash64("conv", "turn", F.lit(16)), F.lit(16)) == 0, "row": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("text"), F.col("text"), F.col("row")]
    kind = rows.schema["conv"].dataType.simpleString()

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list = []  # one entry a line
        states: list[int] | None = []
        size, own, kept = 0, object(), []

        def flush():
            nonlocal held, states, size, number
            if held:
                kept.append((own, (part << PART_BITS) + number, "\n".join(held), states))
                number += 1
            held, states, size = [], [], 0

        def made():
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], conv_type), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.string()), pa.array([k[3] for k in kept], pa.list_(pa.int32()))],
                ["conv", "at", "text", "states"],
            )
            kept.clear()
            return out

        for batch in batches:
            conv_type = batch.column(0).type
            for conv, role, text, style, bare in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)], strict=True):
                if conv != own or size >= chunk_chars:
                    flush()
                    own = conv
                lines, found = _written(_NAMES.get(role, ROLES.index("other")), text, style, bare)
                held += lines
                states = None if states is None or role is None else states + found
                size += len(text)
            if kept:
                yield made()
        flush()
        if kept:
            yield made()

    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return placed.select("conv", "turn", "role", "text", "style", "bare").mapInArrow(write, f"conv {kind}, at long, text string, states array<int>")


# -- the model ----------------------------------------------------------------


class Model:
    """Scores of states: first line, next line, and each feature's values."""

    def __init__(self, first: np.ndarray, step: np.ndarray, shows: list[np.ndarray], smoothing: float = 0.5):
        """From counts: ``first`` by state, ``step`` by state and next state, ``shows`` by value and state."""
        score = lambda p: np.round(1e6 * np.log(p)).astype(np.int64)
        begins = np.arange(STATES) % 3 == BEGIN
        same = np.arange(STATES)[:, None] // 3 == np.arange(STATES) // 3
        step, first = step + smoothing, (first + smoothing) * begins
        self.first = np.where(begins, score(np.maximum(first / first.sum(), 1e-30)), _NEVER)
        self.step = np.where(begins | same, score(step / (step * (begins | same)).sum(1, keepdims=True)), _NEVER)
        self.shows = []
        for f, counts in enumerate(shows):
            counts = counts + smoothing
            if f == 0:  # a named role is trusted whether or not labelled lines had markers
                counts[np.arange(len(ROLES)) + 1, 3 * np.arange(len(ROLES)) + BEGIN] += 20
                counts[0, np.arange(STATES) % 3 != BEGIN] += 20
            if f == 1:
                counts[0, np.arange(STATES) % 3 == BLANK] += 20
            self.shows.append(score(counts / counts.sum(0)))

    def emission(self, lines: list[str]) -> np.ndarray:
        seen = line_features(lines)
        return sum(s[seen[:, f]] for f, s in enumerate(self.shows))

    def matrix(self, emission: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines (last row: from the start) to each at their end."""
        score = np.vstack([self.step, self.first]) + emission[0]
        for e in emission[1:]:
            score = np.maximum((score[:, :, None] + self.step).max(1), 10 * _NEVER) + e
        return score

    def decode(self, emission: np.ndarray, before: int = -1, after: int = -1) -> np.ndarray:
        """Best states of lines, given the state before them (-1: the start) and perhaps the last one."""
        score = (self.first if before < 0 else self.step[before]) + emission[0]
        back = np.empty((len(emission), STATES), np.int64)
        for i in range(1, len(emission)):
            steps = score[:, None] + self.step
            back[i] = steps.argmax(0)
            score = steps[back[i], np.arange(STATES)] + emission[i]
        out = np.empty(len(emission), np.int64)
        out[-1] = int(score.argmax()) if after < 0 else after
        for i in range(len(emission) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def _before(key: str, at: str, column: str) -> Column:
    """``column`` of the chunk before within the same group of ``FAN_BITS`` chunk numbers."""
    return F.lag(column).over(Window.partitionBy(key, F.shiftright(at, FAN_BITS)).orderBy(at))


def train(transcripts: DataFrame, folds: int, smoothing: float = 0.5) -> list[Model]:
    """A model for each fold, from the labelled transcripts of the other folds (of all, if there is one fold).

    ``transcripts``: ``key, fold, at, text, states``.  All counts merge in any order; a fixed
    number of them (folds x states x feature values) reaches the driver.
    """

    def count(batches):
        shows = {f: [np.zeros((v, STATES), np.int64) for v in SHAPE] for f in range(folds)}
        step = np.zeros((folds, STATES, STATES), np.int64)
        for batch in batches:
            for fold, text, states in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                s = np.array(states)
                seen = line_features(text.split("\n"))
                for f in range(len(SHAPE)):
                    np.add.at(shows[fold][f], (seen[:, f], s), 1)
                np.add.at(step[fold], (s[:-1], s[1:]), 1)
        rows = [(fold, f, int(v), int(s), int(t[v, s])) for fold in range(folds) for f, t in enumerate([*shows[fold], step[fold]]) for v, s in np.argwhere(t)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["fold", "feature", "value", "state", "n"])

    known = transcripts.where("states is not null")
    counted = known.select("fold", "text", "states").mapInArrow(count, "fold long, feature long, value long, state long, n long")
    ends = known.select("key", "fold", "at", F.get("states", F.lit(0)).alias("head"), F.element_at("states", -1).alias("tail"))
    group = F.shiftright("at", FAN_BITS)
    inner = ends.withColumn("before", _before("key", "at", "tail")).where("before is not null").select("fold", "before", "head")
    groups = ends.groupBy("key", "fold", group.alias("g")).agg(F.min_by("head", "at").alias("head"), F.max_by("tail", "at").alias("tail"))
    outer = groups.withColumn("before", F.lag("tail").over(Window.partitionBy("key").orderBy("g"))).where("before is not null").select("fold", "before", "head")
    steps = inner.union(outer).select("fold", F.lit(len(SHAPE)), "before", "head", F.lit(1))
    first = ends.groupBy("key", "fold").agg(F.min_by("head", "at").alias("head")).select("fold", F.lit(len(SHAPE) + 1), F.lit(0), "head", F.lit(1))
    every = counted.union(steps).union(first).groupBy("fold", "feature", "value", "state").agg(F.sum("n").alias("n")).collect()
    models = []
    for own in range(folds):
        tables = [np.zeros((v, STATES)) for v in (*SHAPE, STATES, 1)]
        for r in every:
            if folds == 1 or r["fold"] != own:
                tables[r["feature"]][r["value"], r["state"]] += r["n"]
        models.append(Model(tables[-1][0], tables[-2], tables[:-2], smoothing))
    return models


# -- parsing ------------------------------------------------------------------


def _through(mats: list[np.ndarray], before: int, after: int) -> list[int]:
    """Best states at the ends of consecutive matrices."""
    score, back = mats[0][before], []
    for m in mats[1:]:
        steps = score[:, None] + m[:STATES]
        back.append(steps.argmax(0))
        score = steps.max(0)
    ends = [int(score.argmax()) if after < 0 else after]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def _matrices(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(table.column("at").to_numpy(), kind="stable")
    scores = table.column("score").combine_chunks()
    flat = scores.flatten().to_numpy().reshape(-1, STATES + 1, STATES)
    return order, list(flat[order])


def _borders(scores: DataFrame, fan_bits: int) -> DataFrame:
    """``key, at, before, after``: states before and at the end of every chunk, from ``key, at, score``."""

    def multiply(table: pa.Table) -> pa.Table:
        _, mats = _matrices(table)
        out = mats[0]
        for m in mats[1:]:
            out = np.maximum((out[:, :, None] + m[:STATES]).max(1), 10 * _NEVER)
        at = table.column("at")[0].as_py() >> fan_bits
        return pa.table({"key": table.column("key").slice(0, 1), "at": pa.array([at], pa.int64()), "score": pa.array([out.reshape(-1)], pa.list_(pa.int64()))})

    def fix(table: pa.Table) -> pa.Table:
        order, mats = _matrices(table)
        ends = _through(mats, table.column("before")[0].as_py(), table.column("after")[0].as_py())
        begins = [table.column("before")[0].as_py(), *ends[:-1]]
        return pa.table({"key": table.column("key"), "at": table.column("at").take(pa.array(order)), "before": pa.array(begins, pa.int32()), "after": pa.array(ends, pa.int32())})

    levels = [materialize(scores, "chat-level")]
    spread = levels[0].groupBy("key").agg(F.max("at").bitwiseXOR(F.min("at")).alias("x")).agg(F.max("x")).first()[0] or 0
    for _ in range(-(-spread.bit_length() // fan_bits)):
        grouped = levels[-1].groupBy("key", F.shiftright("at", fan_bits)).applyInArrow(multiply, "key string, at long, score array<long>")
        levels.append(materialize(grouped, "chat-level"))
    # before: the start's row of a matrix; after: free
    known = levels.pop().select("key", "at", F.lit(STATES).alias("before"), F.lit(-1).alias("after"))
    for level in reversed(levels):
        inside = level.withColumn("up", F.shiftright("at", fan_bits)).join(known.withColumnRenamed("at", "up"), ["key", "up"])
        known = materialize(inside.groupBy("key", "up").applyInArrow(fix, "key string, at long, before int, after int"), "chat-borders")
    return known


def render(role: int, begins: bool, lines: list[str]) -> str:
    """Canonical form of a turn, or of a later piece of one: a role line, then the text without blank lines.

    Role lines cannot be forged: ``<|`` inside the text becomes ``<\\|``.
    """
    bodies = [split_marker(line)[1] if i == 0 and begins else _END.sub("", line) for i, line in enumerate(lines)]
    bodies = [b.strip().replace("<|", "<\\|") for b in bodies]
    return "".join([f"<|{ROLES[role]}|>\n"] * begins + [f"{b}\n" for b in bodies if b])


def parse_transcripts(transcripts: DataFrame, models: list[Model], *, fan_bits: int = FAN_BITS) -> DataFrame:
    """``conv, turn, piece, role, text, n_lines`` of the turns in ``key, conv, fold, at, text`` transcripts.

    ``turn`` counts from 0 within a conversation; a turn that crosses chunks has a row in each,
    numbered by ``piece`` (the chunk).  ``text`` is the canonical form; pieces joined in order give
    the turn's.  Null text is an empty line.  The best path is found exactly; of equally good ones, any.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(models)
    conv_kind = transcripts.schema["conv"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).alias("text")

    def measure(batches):
        for batch in batches:
            scores = []
            for fold, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                model = shared.value[fold]
                scores.append(model.matrix(model.emission(words.split("\n"))).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.list_(pa.int64()))], ["key", "at", "score"])

    def decode(batches):
        for batch in batches:
            at, turn, role, texts, lines_of = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in range(2, 6)]
            for i, (fold, words, before, after) in enumerate(zip(*columns, strict=True)):
                model, lines = shared.value[fold], words.split("\n")
                before = -1 if before is None or before == STATES else before
                path = model.decode(model.emission(lines), before, -1 if after is None else after)
                starts = np.unique(np.append(0, np.flatnonzero(path % 3 == BEGIN)))
                number = -1
                for a, b in zip(starts, [*starts[1:], len(path)], strict=True):
                    begins = bool(path[a] % 3 == BEGIN)
                    number += begins
                    at.append(i)
                    turn.append(number)
                    role.append(ROLES[path[a] // 3])
                    texts.append(render(int(path[a]) // 3, begins, lines[a:b]))
                    lines_of.append(int(b - a))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(6).take(take), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(texts, pa.string()), pa.array(lines_of, pa.int64())],
                ["key", "at", "conv", "turn", "role", "text", "n_lines"],
            )

    decoded_type = f"key string, at long, conv {conv_kind}, turn long, role string, text string, n_lines long"
    many = materialize(transcripts.groupBy("key").count().where("count > 1").select("key"), "chat-long")
    alone = transcripts.join(many, "key", "left_anti").select("key", "at", "fold", text, F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"), "conv")
    out = alone.mapInArrow(decode, decoded_type)
    if not many.isEmpty():
        long = transcripts.join(many, "key", "left_semi").select("key", "at", "fold", text, "conv")
        borders = _borders(long.select("key", "at", "fold", "text").mapInArrow(measure, "key string, at long, score array<long>"), fan_bits)
        pieces = long.join(borders, ["key", "at"]).select("key", "at", "fold", "text", "before", "after", "conv").mapInArrow(decode, decoded_type)
        pieces = materialize(pieces, "chat-pieces")
        # turns before a chunk: sums within groups of chunks, and of the groups before
        sums = pieces.groupBy("key", "at").agg((F.max("turn") + 1).alias("n")).withColumn("g", F.shiftright("at", FAN_BITS))
        earlier = lambda w, order: F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = sums.groupBy("key", "g").agg(F.sum("n").alias("n")).select("key", "g", earlier(Window.partitionBy("key"), "g").alias("group_before"))
        counted = sums.select("key", "at", "g", earlier(Window.partitionBy("key", "g"), "at").alias("own_before")).join(groups, ["key", "g"])
        numbered = pieces.join(counted.select("key", "at", (F.col("own_before") + F.col("group_before")).alias("earlier")), ["key", "at"])
        out = out.union(numbered.withColumn("turn", F.col("turn") + F.col("earlier")).drop("earlier"))
    return out.select("conv", "turn", F.col("at").alias("piece"), "role", "text", "n_lines")


def keyed(transcripts: DataFrame, folds: int) -> DataFrame:
    """``transcripts`` with ``key`` (their conversation as a string, null too) and ``fold``."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    return transcripts.withColumns({"key": key, "fold": F.pmod(F.xxhash64(key, F.lit(2)), F.lit(folds)).cast("int")})


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", folds: int = 2, chunk_chars: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per recovered turn (and chunk): ``conv_id, turn, piece, role, text, n_lines``.

    Every conversation is written as a running transcript (:func:`write_transcripts`, which states
    how nulls, ties and repeated rows are ordered), its roles are put aside, and the transcript
    is parsed by a model trained on the conversations of the other folds.  Without any roles the
    markers alone decide.  Other columns are ignored; an empty table gives an empty result.
    """
    written = write_transcripts(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col, chunk_chars=chunk_chars)
    written = materialize(keyed(written, folds), "transcripts")
    models = train(written, folds)
    return parse_transcripts(written.drop("states"), models, fan_bits=fan_bits).withColumnRenamed("conv", "conv_id")
