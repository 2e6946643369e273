"""Personal data: base patterns, and identifiers found through bootstrapped contexts.

One scan finds the base spans (e-mail, IP address, card and phone number), the other
identifier-like tokens, and the lexical contexts (the one or two words before) of both.
Contexts and identifiers make a bipartite graph.  Base spans are the seeds: in each round
Spark scores a context of a kind by the share of its distinct identifiers that are
known, and an identifier by its contexts; identifiers that score high join the known ones.
At last the contexts with high confidence and enough known identifiers mark the
identifier-like tokens that follow them.  The graph lives in shared tables; nothing of
it is collected or broadcast.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize, text_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# at the start of a run of digits only: within a run a later start cannot match where the first does not
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"\S+")
# groups of digits, as in numbers written with spaces, dots, dashes or brackets
_GROUPS = re.compile(r"[0-9]+(?:[\x20().-]{1,2}[0-9]+)++")
_BEFORE, _AFTER = "([{<\"'`*#$%&,;:=", ".,;:!?)]}>\"'`*#$%&"
#: Longer names and words are known by a hash.
_HASHED = 64


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in code points, sorted."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside ``taken``: with four digits or an @, stripped of marks around.

    A token of five characters or more counts, and so does a number in several groups with seven digits or more.
    """
    out, done, i = [], 0, 0
    spans = sorted((s, e) for s, _, e in taken)
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = done = _REST.match(text, mark.start()).end()
        groups = _GROUPS.match(text, mark.start())
        if groups and groups.end() >= end and sum(c.isdigit() for c in groups[0]) >= 7:
            end, done = groups.end(), _REST.match(text, groups.end() - 1).end()
        while start < end and text[start] in _BEFORE:
            start += 1
        while end > start and text[end - 1] in _AFTER:
            end -= 1
        if end - start >= 5:
            while i < len(spans) and spans[i][1] <= start:
                i += 1
            j = i
            while j < len(spans) and spans[j][0] < end and spans[j][1] <= start:
                j += 1
            clear = j == len(spans) or spans[j][0] >= end
            token = text[start:end]
            if clear and (len(_DIGIT.findall(token)) >= 4 or "@" in token[1:-1]):
                out.append((start, end))
        mark = _MARK.search(text, done)
    return out


def _known_as(name: str) -> str:
    return name if len(name) <= _HASHED else hashlib.sha256(name.encode()).hexdigest()


def contexts(text: str, starts: list[int]) -> list[list[str]]:
    """Lexical contexts of places (ascending): the two words before each on its line, and a word before it that
    ends as a label.  The text is split once, up to the last place."""
    out: list[list[str]] = []
    at, words = 0, []  # words of this line before `at`, the last two
    for start in starts:
        line = text.rfind("\n", at, start)
        if line >= 0:
            at, words = line + 1, []
        found = _WORDS.findall(text, at, start)
        before = words[-2:] + found[-2:]
        # a word that goes on behind `start` stays to be read again
        open_ = bool(found) and not text[start - 1].isspace()
        words = (words + (found[:-1] if open_ else found))[-2:]
        at = start - len(found[-1]) if open_ else start
        before = [_DIGIT.sub("0", w.lower().rstrip("\"'([{<")) for w in before[-2:]]
        own = []
        if len(before) == 2 and all(before):
            own.append(" ".join(map(_known_as, before)))
        if before and len(before[-1]) > 1 and before[-1][-1] in ":=#":
            own.append(_known_as(before[-1]))
        out.append(own)
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_MENTION = "struct<start:int,end:int,kind:int,name:string,context:string>"


def scan(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus ``spans`` (base spans) and ``mentions`` (base spans and identifiers, by context)."""
    columns = docs.columns
    at = columns.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mention_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("name", pa.string()), ("context", pa.string())]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, 8 << 20):
                spans, mentions = [], []
                for text in part.column(at).to_pylist():
                    own, seen = [], []
                    if text and _MARK.search(text):
                        own = base_spans(text)
                        places = [(s, e, k) for s, k, e in own] + [(s, e, -1) for s, e in identifiers(text, own)]
                        places.sort()
                        found = contexts(text, [p[0] for p in places])
                        seen = [{"start": s, "end": e, "kind": k, "name": _known_as(text[s:e].lower()), "context": c} for (s, e, k), own in zip(places, found, strict=True) for c in own]
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                    mentions.append(seen)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, span_type), pa.array(mentions, mention_type)], [*columns, "spans", "mentions"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, spans array<{_SPAN}>, mentions array<{_MENTION}>")


def learn_contexts(mentions: DataFrame, *, rounds: int, support: int, confidence: float) -> DataFrame:
    """``context, kind, score`` of the contexts to trust, from ``context, name, kind`` mentions (kind -1: not a seed)."""
    edges = mentions.select("context", "name").distinct()
    wide = edges.groupBy("context").agg(F.count("*").alias("names")).where(F.col("names") >= support)
    edges = materialize(edges.join(wide, "context"), "pii-edges")
    seeds = mentions.where("kind >= 0").select("name", "kind").distinct().withColumn("score", F.lit(1.0))
    known = seeds
    for k in range(rounds):
        scored = edges.join(known, "name").groupBy("context", "kind").agg(
            (F.sum("score") / F.max("names")).alias("score"), F.sum((F.col("score") >= confidence).cast("int")).alias("known"))
        scored = materialize(scored.where(F.col("known") >= support), "pii-contexts")
        if k < rounds - 1:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))
            found = edges.join(scored.select("context", "kind", "score"), "context").groupBy("name", "kind").agg((1 - doubt).alias("score"))
            known = seeds.union(found.where(F.col("score") >= confidence).join(seeds.select("name").distinct(), "name", "left_anti"))
    return scored.where(F.col("score") >= confidence).select("context", "kind", "score")


def _found(docs: DataFrame, text_col: str, rounds: int, support: int, confidence: float, keep_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """Scanned rows under private names with ``spans`` and ``added`` (spans the contexts found)."""
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    mine = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    seen = scan(mine, names[text_col]).withColumn("row", F.monotonically_increasing_id())
    seen = materialize(seen if keep_text else seen.drop(names[text_col]), "pii")
    mentions = seen.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    trusted = learn_contexts(mentions, rounds=rounds, support=support, confidence=confidence)
    hits = mentions.where("kind < 0").select("row", "start", "end", "context").join(trusted, "context")
    best = hits.groupBy("row", "start", "end").agg(F.min(F.struct(-F.col("score"), F.col("kind"))).alias("best"))
    span = F.struct(F.col("start"), F.col("best.kind").alias("kind"), F.col("end"))
    added = best.groupBy("row").agg(F.collect_list(span).alias("added"))
    out = seen.drop("mentions").join(added, "row", "left")
    return out.withColumn("added", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)"))), names


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, added`` - arrays of (start, kind, end).

    Kinds count from 0: e-mail, ip, card, phone.  Offsets are code points, ends exclusive.  A
    context is trusted with ``confidence`` and ``support`` known identifiers at least.  Null
    text counts as empty; a null id stays null; repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, names = _found(mine, "text", rounds, support, confidence, False)
    return found.select(F.col(names["doc_id"]).alias("doc_id"), F.col("spans").alias("base"), "added")


def span_digest(spans):
    """``kind:start:end`` of an array of spans, by start and kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact_pii(docs: DataFrame, *, text_col: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by its kind in angle brackets, as ``<EMAIL>``.

    Overlapping spans are replaced together, by the first one's kind.  Null text stays null, empty text
    empty; repeated rows each give a row; columns may carry any names; an empty table gives an empty result.
    """
    found, names = _found(docs, text_col, rounds, support, confidence, True)
    found = found.select(*names.values(), F.array_sort(F.concat("spans", "added")).alias("spans"))
    at, order = docs.columns.index(text_col), list(names.values())

    def mask(batches):
        for batch in batches:
            for part in text_slices(batch, at, 8 << 20):
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(part.column(len(order)).to_pylist()):
                    if spans:
                        out, done = [], 0
                        for s in spans:
                            if s["start"] >= done:
                                out += [texts[i][done : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                            done = max(done, s["end"])
                        texts[i] = "".join([*out, texts[i][done:]])
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, order)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[:-1])
    return found.mapInArrow(mask, schema).select(*[F.col(n).alias(c) for c, n in names.items()])
