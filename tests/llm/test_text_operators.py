"""Text operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm.queries import QUERIES, tokenizer_path

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, kept boolean, n_words string, spans string, piece string, c0_ string"
LONG = "alpha beta gamma delta epsilon " * 8000
SHARED = " ".join(f"w{i}" for i in range(80))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    texts = [None, "", "   \n\t ", "one", "a b c d", SHARED, SHARED, SHARED + " tail", LONG, "mail me: bob.1@mail.example.com now", "Ünïcode wörds ß 漢字 \U0001f600 end", "x" * 5000, "<|endoftext|> inside", None]
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, None if i % 4 == 0 else 1, 7, None, None, "n", None, "p", "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text under a known id " * 10, None, None, None, None, None, True, None, None, None, None)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def documents(spark, small):
    return {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- decontamination ----------------------------------------------------------


def brute_contamination(docs, items, span=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for k, t in items:
        w = word.findall(lower(t)) if k is not None and t is not None else []
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    sizes = {len(w) for w in windows}
    out = []
    for k, t in docs:
        w = word.findall(lower(t or ""))
        hit, held = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    held |= found
        out.append((k, len(w), len(hit), ",".join(sorted(held))))
    return sorted(out, key=repr)


def contamination_rows(df):
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, edge, empty, block_bytes):
    from sightline.llm.decontaminate import find_contamination, remove_contaminated

    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(12, None), (None, "v1"), (13, ""), (5, SHARED)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(r["doc_id"], r["text"]) for r in edge.collect()]
    df = spark.createDataFrame(docs + more, "doc_id long, text string")
    got = find_contamination(df, bench, block_bytes=block_bytes)
    expected = brute_contamination(docs + more, items)
    assert contamination_rows(got) == expected
    kept = remove_contaminated(edge, bench, block_bytes=block_bytes)
    assert kept.columns == edge.columns
    assert kept.count() == sum(1 for e in brute_contamination(more, items) if e[2] == 0)
    assert find_contamination(empty, bench).count() == 0
    assert remove_contaminated(edge, bench.limit(0)).count() == edge.count()


# -- quality ------------------------------------------------------------------


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, edge, empty, small):
    from sightline.llm.quality import judge_quality, keep_good

    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (edge, spark.read.parquet(f"{small}/documents.parquet")):
        judged = judge_quality(df.withColumn("copy", F.col("text")))
        for r in judged.collect():
            measures = brute_quality(r["copy"])
            assert tuple(r[b] for b in base) == measures
            assert r["base_failed"] == (measures[0] < 50 or 100 * measures[4] > 50 * measures[0])
            assert not (r["base_failed"] and r["kept"])
        assert judge_quality(df, max_broadcast_groups=0).where("kept").count() == judged.where("kept").count()
    good = keep_good(edge)
    assert good.columns == edge.columns and good.count() == judge_quality(edge).where("kept").count()
    assert judge_quality(empty).count() == keep_good(empty).count() == 0


def test_fences_by_brute_force(spark, small):
    """Fences and verdicts equal those of quantiles over the bucketed values, group by group."""
    import math

    from sightline.llm import quality

    docs = spark.read.parquet(f"{small}/documents.parquet")
    measured = quality.measure(docs)
    measured = measured.select(*measured.columns, *[c.alias(m) for m, c in quality._metrics().items()]).cache()
    got = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.sketches(measured, "lang", "source"), prior=8).collect()}
    verdict = {r["doc_id"]: r for r in quality.judge_quality(docs, prior=8).collect()}
    bucket = lambda v: v - v % (1 << max(v.bit_length() - 5, 0))
    rows = measured.collect()
    beyond = set()

    def quartile(values, k):
        v = sorted(map(bucket, values))
        return v[-(-len(v) * k // 4) - 1]

    for (lang, source), r in got.items():
        own = [x for x in rows if x["lang"] == lang and x["source"] == source]
        wider = [x for x in rows if x["lang"] == lang]
        for m, (count, total, unit) in quality.METRICS.items():
            low, mid = (
                (len(own) * quartile([x[f"m_{m}"] for x in own], k) + 8 * ((len(wider) * quartile([x[f"m_{m}"] for x in wider], k) + 8 * quartile([x[f"m_{m}"] for x in rows], k)) // (len(wider) + 8))) // (len(own) + 8)
                for k in (1, 2)
            )
            fence = mid + quality.REACH * max(mid - low, quality.SPREAD)
            assert r[f"f_{m}"] == fence
            beyond |= {x["doc_id"] for x in own if math.floor(1000.0 * (x[count] - 3.0 * math.sqrt(x[count] * unit)) / max(1, x[total])) > fence}
    assert {k for k, r in verdict.items() if r["kept"]} == {k for k, r in verdict.items() if not r["base_failed"]} - beyond


def test_fences_of_a_junk_source(spark, small):
    """Two fifths of one source are symbols: they all go and the rest stays, by the query and the pipeline's stage."""
    import corpus_pipeline
    from sightline.llm.quality import keep_good

    clean = lambda i: " ".join(f"word{(i * 131 + k * k) % 9973}" for k in range(80))
    rows = [(i, clean(i) + " #|<>" * 60 if i % 5 < 2 and i < 400 else clean(i), "en", "junky" if i < 400 else f"s{i % 2}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    junk = {r[0] for r in rows if "#|<>" in r[1]}
    for kept in (keep_good(docs), corpus_pipeline.quality_rules(spark, docs, small)):
        assert len(junk) == 160 and {r["doc_id"] for r in kept.collect()} == set(range(2_000)) - junk


def test_fences_of_a_source_that_differs(spark):
    """A source that is full of symbols by nature keeps its documents; a few marks in a short text prove nothing."""
    from sightline.llm.quality import keep_good

    words = lambda i: " ".join(f"w{(i * 131 + k * k) % 9973}" for k in range(60))
    rows = [(i, words(i) + (" $" * (20 + i % 9) if i < 600 else " ? !" if i % 50 == 0 else ""), "en", "prices" if i < 600 else "prose") for i in range(1_500)]
    assert keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).count() == 1_500


# -- near duplicates ----------------------------------------------------------


def brute_components(docs, percent=75, size=5):
    sets = {}
    for k, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in keys}


def chained_copies(n=60):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"u{rng.randrange(4000)}" for _ in range(80))) for i in range(30)]
    return docs + [(200, "short text"), (201, "Short TEXT"), (202, "other"), (203, None), (204, "")]


@pytest.mark.parametrize("most", [400_000, 0])
def test_near_duplicates(spark, most):
    from sightline.llm.near_duplicates import near_duplicates, remove_near_duplicates

    docs = chained_copies()
    expected = brute_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in near_duplicates(df, max_broadcast_keys=most).collect():
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    kept = sorted(r["doc_id"] for r in remove_near_duplicates(df, max_broadcast_keys=most).collect())
    assert kept == sorted(k for k, (_, c) in expected.items() if k == c)


def test_near_duplicate_edges(spark, edge, empty):
    from sightline.llm.near_duplicates import near_duplicates, remove_near_duplicates

    assert near_duplicates(edge).count() == edge.count()
    kept = remove_near_duplicates(edge)
    assert kept.columns == edge.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts[SHARED] == 1 and texts[SHARED + " tail"] == 0
    assert texts[None] == 2 and texts[""] == 1
    assert near_duplicates(empty).count() == remove_near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    from sightline.llm.near_duplicates import estimate_similarity, merge_registers, registers

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one, two = pool[:1800], pool[600:]
    r = registers(np.concatenate([one, two, pool]), np.array([0, 1800, 4200, 7200]))
    assert (merge_registers(r[0], r[1]) == r[2]).all()
    best, _ = estimate_similarity(r[:1], r[1:2], np.array([1800.0]), np.array([2400.0]), 0.75)
    assert best[0] == pytest.approx(0.4, abs=0.1)


def test_components(spark):
    from sightline.llm.graph import connected_components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# -- repeats ------------------------------------------------------------------


def brute_repeats(docs, length):
    counts = Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for k, b in docs:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((k, len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [2, 500])
def test_repeats(spark, edge, empty, most):
    from sightline.llm.repeats import remove_repeats

    rng = random.Random(2)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 400))) for _ in range(6)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 30) :] + rng.choice(["", "x", "yy", "é"]) for _ in range(rng.randint(0, 4)))) for i in range(50)]
    docs += [(100, "a" * 3000), (101, "ab" * 900), (102, None), (103, ""), (104, "abc" * 500), (105, "x" + "abc" * 400), (106, "a" * 39), (107, "a" * 40)]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=40, gram=12, max_contexts=most).collect()
    rows = sorted(((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got), key=repr)
    assert rows == brute_repeats([(k, (t or "").encode()) for k, t in docs], 40)
    assert remove_repeats(edge).count() == edge.count()
    assert remove_repeats(empty).count() == 0


def test_long_text_in_segments(spark):
    from sightline.llm import repeats

    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh") for _ in range(3000))
    filler = lambda: "".join(rng.choice("abcdefgh") for _ in range(900_000))
    text = f"{part}X{filler()}Y{part}Z{filler()}V{part}"
    r = repeats.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["stop"] - s["start"] for s in r["spans"]] == [3000, 3000, 3000]


@pytest.mark.parametrize("buckets", [4096, 0, 3])
def test_suffix_array(monkeypatch, buckets):
    """Random, periodic and constant strings, with either way of inducing at every level."""
    from sightline.llm import suffix_array

    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    rng = np.random.default_rng(0)
    for _ in range(400):
        x = rng.integers(0, rng.integers(1, 9), rng.integers(0, 50))
        if rng.random() < 0.3:
            x = np.tile(x, 3)
        order = suffix_array.suffix_array(x)
        assert list(order) == sorted(range(len(x)), key=lambda i: list(x[i:]))
        prefix = suffix_array.permuted_lcp(x, order)
        for a, b in zip(order[1:], order[:-1], strict=True):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            assert prefix[a] == k


def test_long_periodic_strings():
    """A run and a period of 300,000 characters take no step for each character."""
    from sightline.llm.suffix_array import permuted_lcp, suffix_array

    n = 300_000
    order = suffix_array(np.ones(n, np.uint16))
    assert (order == np.arange(n)[::-1]).all() and (permuted_lcp(np.ones(n, np.uint16), order) == np.append(np.arange(n)[:0:-1], 0)).all()
    x = np.tile(np.array([3, 1, 2], np.uint16), n // 3)
    order = suffix_array(x)
    assert (np.diff(x[order].astype(int)) >= 0).all() and permuted_lcp(x, order).max() == n - 3


# -- personal data ------------------------------------------------------------

KINDS = ["email", "ip", "card", "phone"]


def brute_pii(t):
    def luhn(s):
        total = 0
        for i, c in enumerate(s[::-1]):
            x = int(c) * (1 + i % 2)
            total += x // 10 + x % 10
        return total % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 12 <= len(g) <= 19 and luhn(g):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    from sightline.llm.pii import base_spans

    rng = random.Random(1)
    for _ in range(30_000):
        t = "".join(rng.choice("aZ0919.25@@+-- ()_%é") for _ in range(rng.randint(1, 40)))
        assert base_spans(t) == brute_pii(t)
    assert base_spans("9" * 200_000 + "@") == []


def test_contexts_of_places():
    """The words before every place, against splitting the text anew for each; no length is too long."""
    from sightline.llm.pii import contexts, identifiers

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["ab", "c:", "12", " ", " ", "\n", "(", "x=", "w" * 70]) for _ in range(rng.randint(1, 30)))
        starts = sorted(rng.randint(0, len(text)) for _ in range(4))
        for start, got in zip(starts, contexts(text, starts), strict=True):
            words = [re.sub("[0-9]", "0", w.lower().rstrip("\"'([{<")) for w in text[:start].rpartition("\n")[2].split()[-2:]]
            names = [w if len(w) <= 64 else hashlib.sha256(w.encode()).hexdigest() for w in words]
            expected = [" ".join(names)] if len(words) == 2 and all(words) else []
            assert got == expected + ([names[-1]] if words and len(words[-1]) > 1 and words[-1][-1] in ":=#" else [])
    assert identifiers("call (555) 123 4567 now 12-34 or x1234y", []) == [(6, 19), (24, 29), (33, 39)]
    assert identifiers("k" * 500 + "1234", []) == [(0, 504)]
    nested = [(0, 0, 50), (5, 0, 8)] + [(60 + i, 0, 61 + i) for i in range(20)]
    assert identifiers("a" * 20 + " 123456 " + "b" * 60, nested) == []


def brute_contexts(mentions, rounds, support, confidence):
    edges = {(c, n) for c, n, _ in mentions}
    names = Counter(c for c, _ in edges)
    edges = {(c, n) for c, n in edges if names[c] >= support}
    seeds = {(n, k): 1.0 for _, n, k in mentions if k >= 0}
    known = dict(seeds)
    for _ in range(rounds):
        scores = defaultdict(float)
        hits = Counter()
        for c, n in edges:
            for (m, k), s in known.items():
                if m == n:
                    scores[c, k] += s / names[c]
                    hits[c, k] += s >= confidence
        scores = {ck: s for ck, s in scores.items() if hits[ck] >= support}
        doubt = defaultdict(lambda: 1.0)
        for c, n in edges:
            for (d, k), s in scores.items():
                if c == d:
                    doubt[n, k] *= max(1 - s, 1e-12)
        seeded = {n for n, _ in seeds}
        known = seeds | {nk: 1 - x for nk, x in doubt.items() if 1 - x >= confidence and nk[0] not in seeded}
    return {(c, k): s for (c, k), s in scores.items() if s >= confidence}


def test_contexts(spark):
    from sightline.llm.pii import learn_contexts

    rng = random.Random(4)
    mentions = [(f"c{i % 5}", f"n{rng.randrange(40)}", rng.choice([0, 0, 1, -1]) if i % 5 else 0) for i in range(300)]
    mentions += [("good", f"g{i}", 2) for i in range(19)] + [("good", "fresh", -1), ("near", "fresh", -1)] + [("near", f"h{i}", 2) for i in range(12)]
    df = spark.createDataFrame(mentions, "context string, name string, kind int")
    got = {(r["context"], r["kind"]): r["score"] for r in learn_contexts(df, rounds=3, support=5, confidence=0.9).collect()}
    expected = brute_contexts(mentions, 3, 5, 0.9)
    assert got.keys() == expected.keys() and ("near", 2) in got
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_pii(spark, edge, empty, small):
    from sightline.llm.pii import find_pii, redact_pii

    docs = documents(spark, small)
    for r in QUERIES["op8_pii"](spark, small).collect():
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute_pii(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert find_pii(edge).count() == edge.count() and find_pii(empty).count() == redact_pii(empty).count() == 0
    clean = redact_pii(edge)
    assert clean.columns == edge.columns
    assert {r["text"] for r in clean.where("doc_id = 9").collect()} == {"mail me: <EMAIL> now"}
    rows = [(i, f"hello write to: user{i}@mail.example.com ok" if i < 8 else "x write to: 12345-99 ok") for i in range(9)]
    learned = redact_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert learned.where("doc_id = 8").first()["text"] == "x write to: <EMAIL> ok"


# -- tokens -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    from sightline.llm.bpe import load

    rng = random.Random(6)
    alphabet = ["a", "b", "é", "漢", "1", "٣", " ", "  ", "\n", "\t", "'s", "'", "’", "!", "##", "<|endoftext|>", "\U0001f600", " ", " ", "ß", "'ll", "z" * 50]
    bpe = load(tokenizer_path())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert bpe.encode(text).tolist() == ids_of(library, text)


@pytest.mark.parametrize("most", [200_000, 3])
def test_token_counts(spark, edge, empty, small, library, most):
    from sightline.llm.token_counts import token_counts

    docs = documents(spark, small)
    df = spark.read.parquet(f"{small}/documents.parquet")
    for r in token_counts(df, tokenizer_path(), max_broadcast_pieces=most).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(docs[r["doc_id"]].encode()), len(ids_of(library, docs[r["doc_id"]])))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts(edge, tokenizer_path(), max_broadcast_pieces=most).collect())
    assert got == Counter((r["doc_id"], len(ids_of(library, r["text"]))) for r in edge.collect())
    assert token_counts(empty, tokenizer_path()).count() == 0


def test_token_counts_of_other_files(spark, tmp_path):
    """A file that lower-cases texts, and a sentencepiece model: counts as the libraries give them."""
    import json

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from sightline.llm.token_counts import token_counts

    config = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    config["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(config), encoding="utf-8")
    texts = ["HELLO World's  End", "", None, "<|endoftext|> ÜBER", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lower_case = Tokenizer.from_file(str(other))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, str(other)).collect()}
    assert got == {i: len(ids_of(lower_case, t)) for i, t in enumerate(texts)}
    folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".model"))[:1]:
        model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, f"{folder}/{name}").collect()}
        assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_packing(spark, edge, empty, library):
    from sightline.llm.packing import pack, sequences

    packed = pack(edge, tokenizer_path())
    rows = packed.collect()
    by_doc, texts = defaultdict(list), defaultdict(list)
    for r in edge.collect():
        texts[r["doc_id"]].append([*ids_of(library, r["text"]), 1])
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for k, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, texts[k]))
        crcs = {zlib.crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for t in texts[k] for p in pieces}
        assert {p["ids_crc32"] for p in pieces} <= crcs
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    assert whole.keys() == fill.keys()
    for r in rows:
        piece = np.array(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    assert pack(empty, tokenizer_path()).count() == 0


def test_cutting_stock():
    from sightline.llm.packing import knapsack, plan_sequences

    rng = np.random.default_rng(3)
    for _ in range(15):
        histogram = {int(s): int(rng.integers(1, 200)) for s in rng.choice(np.arange(1, 65), 20, replace=False)}
        plan = plan_sequences(histogram, 64)
        have = Counter()
        for times, items in plan:
            assert sum(s * k for s, k in items.items()) <= 64
            for s, k in items.items():
                have[s] += times * k
        assert all(have[s] >= n for s, n in histogram.items())
        used = sum(t for t, _ in plan)
        sizes = sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True)
        room: list[int] = []
        for s in sizes:  # first fit decreasing
            i = next((i for i, r in enumerate(room) if r >= s), None)
            if i is None:
                room.append(64 - s)
            else:
                room[i] -= s
        assert used <= 1.03 * len(room) + 1
    # many pieces of three ids: nothing is rounded up, so 682 of them fill a sequence
    assert sum(t for t, _ in plan_sequences({3: 6820}, 2048)) == 10
    value, counts = knapsack(np.array([3.0, 4.0, 5.0]), np.array([3, 4, 6]), 10)
    assert value == 10.0 and (counts * np.array([3, 4, 6])).sum() <= 10


def test_solver_beside_a_running_session(spark):
    """The driver's arithmetic stays out of threaded linear algebra, which can stand still once a JVM runs."""
    from sightline.llm.packing import inverse_of, solve_patterns

    assert spark.range(3).count() == 3
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(200, 200))
    back = np.einsum("ij,jk->ik", matrix, inverse_of(matrix))
    assert np.abs(back - np.eye(200)).max() < 1e-8
    sizes = np.unique(rng.integers(40, 2048, 300))
    patterns, x = solve_patterns(sizes, rng.integers(1, 500, len(sizes)).astype(float), 2048)
    assert ((patterns * sizes).sum(1) <= 2048).all() and (x >= 0).all()


def test_token_files(spark, edge, empty, library, tmp_path):
    from sightline.llm.token_files import ShardReader, read_token_files, write_token_files

    folder = f"file://{tmp_path}/files"
    manifest = write_token_files(edge, folder, tokenizer_path(), shard_bytes=200)
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_token_files(spark, folder).collect()]
    got.sort(key=lambda r: r[1])
    assert Counter((k, tuple(i)) for k, _, i in got) == Counter((r["doc_id"], (*ids_of(library, r["text"]), 0)) for r in edge.collect())
    keys = [-1 if k is None else k for k, _, _ in got]
    assert keys == sorted(keys) and [s for _, s, _ in got] == np.cumsum([0, *(len(i) for _, _, i in got)])[:-1].tolist()
    shards = [r["path"] for r in manifest.collect()]
    dictionary = (tmp_path / "files/dictionary.zdict").read_bytes()
    assert len(shards) > 1 and ShardReader(shards[0], dictionary).ids(0) == np.array(got[0][2], "<u4").tobytes()
    with pytest.raises(ValueError, match="another dictionary"):
        ShardReader(shards[0], dictionary + b"x")
    write_token_files(empty, f"file://{tmp_path}/none", tokenizer_path())
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


# -- toxicity and chat --------------------------------------------------------


def test_toxicity(spark, edge, empty):
    from sightline.llm.toxicity import score_toxicity

    rng = random.Random(9)
    bad = ["grumblish", "grumbling", "vexo", "vexor"]
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic, rough = i % 9 == 0, i % 5 == 0
        if toxic:
            words[rng.randrange(3, 40)] = rng.choice(bad)
        if rough:
            words[:3] = ["###", "zzz", "qqq"]
        docs.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(rough), int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(df, marks, ["low", "toxic"]).collect()}
    held = [got[i] for i in range(600, 900)]
    assert all(r["is_toxic"] == (r["doc_id"] % 9 == 0) and r["is_low"] == (r["doc_id"] % 5 == 0) for r in held)
    assert score_toxicity(edge, marks, ["low", "toxic"]).count() == edge.count()
    assert score_toxicity(empty, marks, ["low"]).count() == 0
    none = score_toxicity(edge, marks.limit(0), ["low", "toxic"]).first()
    assert none["p_toxic"] == 0.5 and not none["is_toxic"]


def test_toxicity_features(spark):
    """The features of every fold against plain counting, and predictions on documents held out."""
    from sightline.llm import toxicity
    from sightline.llm.common import NON_ALNUM, Words, utf8_buffers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = toxicity._labelled(docs, labels, ["toxic"], 10**6).collect()
    got = toxicity._choose_features(toxicity._labelled(docs, labels, ["toxic"], 10**6), 1, 40)
    held = [set(toxicity.tokens(Words(*utf8_buffers(pa.array([r["text"] or ""])), NON_ALNUM))[1].tolist()) for r in rows]
    for f in range(toxicity.FOLDS + 1):
        used = [(h, r["y0"] == 1) for h, r in zip(held, rows, strict=True) if r["fold"] != f]
        count, hits = Counter(x for h, _ in used for x in h), Counter(x for h, y in used if y for x in h)
        n, p = float(len(used)), float(sum(y for _, y in used))
        scored = []
        for x, d in count.items():
            chi = (hits[x] * n - d * p) ** 2 * n / (d * (n - d) * p * (n - p)) if 4 <= d < n else 0
            if chi >= toxicity.LEAST_CHI:
                scored.append((-chi, x if x < 2**63 else x - 2**64))
        assert [int(x) for x in got[f].view(np.int64)] == [v - 2**64 if v >= 2**63 else v for v in sorted(x % 2**64 for _, x in sorted(scored)[:40])]
    scored = toxicity.score_toxicity(docs, labels.where("doc_id % 3 > 0"), ["toxic"])
    tested = scored.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r["is_toxic"] == (r["toxic"] == 1) for r in tested) >= 0.95 * len(tested)
    again = toxicity.score_toxicity(docs.repartition(7), labels.where("doc_id % 3 > 0"), ["toxic"], sample=100)
    once = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_toxicity(docs.coalesce(1), labels.where("doc_id % 3 > 0"), ["toxic"], sample=100).collect()}
    assert {r["doc_id"]: r["p_toxic"] for r in again.collect()} == once  # the fit rows do not depend on the partitioning


def score_of(model, emission, path):
    return model.first[path[0]] + emission[0][path[0]] + sum(model.step[a, b] + emission[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))


def brute_best(model, emission):
    """Best score of any path, by plain dynamic programming over Python integers."""
    n = len(model.first)
    best = [int(model.first[s]) + int(emission[0][s]) for s in range(n)]
    for e in emission[1:]:
        best = [max(best[a] + int(model.step[a, b]) for a in range(n)) + int(e[b]) for b in range(n)]
    return max(best)


def test_viterbi():
    import itertools

    from sightline.llm import chat

    rng = np.random.default_rng(7)
    counts = lambda *shape: rng.integers(0, 30, shape).astype(float)
    for _ in range(5):
        model = chat.Model(counts(chat.STATES), counts(chat.STATES, chat.STATES), [counts(v, chat.STATES) for v in chat.SHAPE])
        emission = -rng.integers(0, 10**6, (4, chat.STATES))
        path = model.decode(emission)
        every = max(score_of(model, emission, p) for p in itertools.product(range(chat.STATES), repeat=4))
        assert score_of(model, emission, path) == every == brute_best(model, emission)
        assert np.maximum((model.matrix(emission[:2])[chat.STATES][:, None] + model.matrix(emission[2:])[: chat.STATES]).max(0), -(10**13)).max() == every


@pytest.mark.parametrize(("scale", "chunk_chars", "fan_bits"), [("0.01", None, 10), ("0.001", 60, 1)])
def test_chat(spark, scale, chunk_chars, fan_bits):
    """The whole query against a plain parse of every transcript, and held-out accuracy; chunks do not matter."""
    from sightline.llm import chat

    turns = spark.read.parquet(f"/root/testdata/sf{scale}/conversations.parquet")
    written = chat.keyed(chat.write_transcripts(turns, chunk_chars=chunk_chars), 2)
    models = chat.train(written, 2)
    convs = defaultdict(list)
    for r in sorted(written.collect(), key=lambda r: r["at"]):
        convs[r["conv"]].append(r)
    got = defaultdict(list)
    for r in chat.format_chats(turns, chunk_chars=chunk_chars, fan_bits=fan_bits).collect():
        got[r["conv_id"]].append(r)
    assert got.keys() == convs.keys() and (chunk_chars is None or max(map(len, convs.values())) > 2)
    right = total = 0
    for conv, chunks in convs.items():
        model = models[chunks[0]["fold"]]
        lines = [line for c in chunks for line in c["text"].split("\n")]
        truth = [s // 3 for c in chunks for s in c["states"]]
        emission = model.emission(lines)
        pieces = sorted(got[conv], key=lambda r: (r["piece"], r["turn"]))
        assert sum(p["n_lines"] for p in pieces) == len(lines)
        path, last = [], None
        for p in pieces:  # the path the rows stand for: a turn's first line begins, others stand inside or are blank
            role = chat.ROLES.index(p["role"])
            at = len(path)
            for i in range(p["n_lines"]):
                begins = i == 0 and p["turn"] != last
                options = [3 * role] if begins else [3 * role + 1, 3 * role + 2]
                path.append(options)
            last = p["turn"]
            body = lines[at : at + p["n_lines"]]
            assert p["text"] == chat.render(role, path[at] == [3 * role], body)
        assert [p["turn"] for p in pieces] == sorted(p["turn"] for p in pieces) and pieces[0]["turn"] == 0
        free = np.full((len(lines), chat.STATES), -(10**13))
        for i, options in enumerate(path):
            free[i, options] = emission[i, options]
        assert brute_best(model, free) == brute_best(model, emission)
        right += sum(t == o[0] // 3 for t, o in zip(truth, path, strict=True))
        total += len(truth)
    assert right >= (0.95 if scale == "0.01" else 0.8) * total  # of few conversations, less is learned


def test_chat_edges(spark):
    from sightline.llm.chat import format_chats, keyed, parse_transcripts, split_marker, train

    assert split_marker("Human: hi") == (0, "hi") and split_marker("<|assistant|> yes<|end|>") == (1, "yes")
    assert split_marker("Note: x") == (-1, "Note: x")
    rows = [(1, 0, None, "User: hi"), (1, 1, None, "Bot: hello"), (None, None, None, None), (2, None, None, ""), (2, 0, None, "x" * 100_000), (1, 1, None, "Bot: hello"), (3, 0, "judge", "a\n<|user|> b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = format_chats(df).collect()
    assert {r["conv_id"] for r in got} == {None, 1, 2, 3} and not any("<|user|> b" in r["text"] for r in got)
    assert format_chats(df.limit(0)).count() == 0
    talk = "User: hi there\nBot: hello\nhow are you?\n\nHuman: fine"
    plain = keyed(spark.createDataFrame([(7, 0, talk, None), (8, 0, None, None)], "conv long, at long, text string, states array<int>"), 1)
    found = parse_transcripts(plain, train(plain, 1)).where("conv = 7").orderBy("turn").collect()
    assert [(r["turn"], r["text"]) for r in found] == [(0, "<|user|>\nhi there\n"), (1, "<|assistant|>\nhello\nhow are you?\n"), (2, "<|user|>\nfine\n")]


def test_hot_conversation(spark):
    """One conversation holds nearly all rows, with repeated turns: it is spread over chunks and stays whole."""
    from sightline.llm.chat import format_chats

    rows = [(1, i // 2, ("user", "assistant")[i % 2], f"line {i}") for i in range(400)] + [(1, 5, "user", "same")] * 50 + [(2, 0, "user", "hello")]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk_chars=100, fan_bits=2).collect()
    hot = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["piece"], r["turn"]))
    words = Counter(x for r in hot for x in r["text"].split("\n") if x and not x.startswith("<|"))
    assert len({r["piece"] for r in hot}) > 20
    assert sum(words.values()) == 450 and words["same"] == 50
