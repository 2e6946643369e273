"""Near duplicates by SetSketch: registers, bands, joint likelihood, exact check.

* A document's set: its distinct shingles of five words (lower-cased A-Z), as 64-bit hashes.
* Documents with equal sets form a class; one row of a class stands for it from then on.
* A class's SetSketch: for register i the least of exponential hash values of the
  shingles, on an exponential scale and truncated to 16 bits.  Registers of unions are
  maxima of registers (:func:`merge_registers`).
* Bands of registers deal classes into buckets.  Every class of a bucket is compared with
  the bucket's least one, then those outside its largest component with one class inside.
  Classes that are still outside are compared with all classes of other components of
  their buckets, on their full sets, in blocks of bounded size that yield one confirmed link
  from a class to a component.  So no pair of a bucket is left out that could join two
  components, and no pairs are listed for a bucket of many copies.
* A candidate pair's similarity is estimated jointly from both sketches by maximum
  likelihood; pairs for which the threshold is out of reach (a likelihood ratio below
  e**-24) are dropped, all others are confirmed on their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SPACES, U64, Words, expand_ranges, gram_hashes, materialize, mix64, text_slices, utf8_buffers
from sightline.llm.graph import connected_components

ROWS, BANDS = 5, 48
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base of the scale, rate of the exponentials, largest register value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Most rows of a table of keys (16 bytes each) that is broadcast.
MAX_BROADCAST_KEYS = 400_000
#: Most rows of a table of buckets that is broadcast: several of them live at a time.
MAX_BROADCAST_BUCKETS = 50_000
#: Shingles on each side of a block of :func:`_across`, about.
BLOCK_SHINGLES = 300_000
_SEED = np.random.default_rng(20)
_FACTORS = (_SEED.integers(0, 2**31, REGISTERS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _SEED.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and n + 1 offsets."""
    words = Words(*utf8_buffers(column), SPACES)
    counts = np.diff(words.first)
    grams = gram_hashes(words.hashes, size)
    rows = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(words.hashes)) + size <= words.first[rows + 1] if len(rows) else np.zeros(0, bool)
    values, owners = grams[inside[: len(grams)]], rows[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([gram_hashes(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] + U64(int(counts[i])) for i in short], dtype=U64)
        values, owners = np.concatenate([values, mix64(whole)]), np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(counts) + 1))


def registers(values: np.ndarray, offsets: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """SetSketch registers (uint16, one row a set) of sets of 64-bit hashes."""
    n = len(offsets) - 1
    least = np.full((REGISTERS, n), np.uint32(2**32 - 1))
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    hashes = (values >> U64(32)).astype(np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):  # whole sets, about `block` values at a time
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
            part = hashes[starts[at] : offsets[full[stop - 1] + 1]]
            cuts = starts[at:stop] - starts[at]
            scratch = np.empty_like(part)
            for i in range(REGISTERS):
                np.multiply(part, _FACTORS[i], out=scratch)
                np.add(scratch, _SHIFTS[i], out=scratch)
                least[i, full[at:stop]] = np.minimum.reduceat(scratch, cuts)
            at = stop
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    out = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)
    out[np.diff(offsets) == 0] = 0
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(j, up, down, equal, u, v):
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = step(u - v * j), step(v - u * j)
    tiny = 1e-12
    return up * np.log(np.maximum(p, tiny)) + down * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))


def estimate_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity of pairs, and the log likelihood ratio against ``threshold``.

    ``a``, ``b``: registers, one row a pair; set sizes are known exactly.
    """
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    args = (up, down, equal, u, v)
    for _ in range(48):
        one, two = low + (high - low) * 0.382, low + (high - low) * 0.618
        better = _log_likelihood(one, *args) > _log_likelihood(two, *args)
        high, low = np.where(better, two, high), np.where(better, low, one)
    best = (low + high) / 2
    limit = np.minimum(threshold, np.minimum(u / v, v / u))
    return best, _log_likelihood(best, *args) - _log_likelihood(limit, *args)


def sign(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` plus ``n_shingles``, two hashes of the set (``s1, s2``) and its registers (``regs``)."""
    columns = docs.columns
    at = columns.index(text)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, 2 << 20):
                values, offsets = shingle_sets(part.column(at), size)
                counts = np.diff(offsets)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate(([U64(0)], np.cumsum(mix64(values + U64(k))))) for k in (1, 2)]
                    one, two = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                regs = registers(values, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())],
                    [*columns, "n_shingles", "s1", "s2", "regs"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, n_shingles long, s1 long, s2 long, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """``band, node``: one row for each band of each class."""

    def run(batches):
        salt = mix64(np.arange(BANDS, dtype=U64) + U64(99))
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(salt, regs.shape[:2]).copy()
                    for i in range(ROWS):
                        key = mix64(key * U64(0x9E3779B97F4A7C15) + regs[:, :, i])
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], ["band", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "band long, node long")


def _small(table: DataFrame, name: str, most: int) -> DataFrame:
    """``table``, written; marked for broadcast if it is small, so that the other side stays where it is."""
    table = materialize(table, name)
    return F.broadcast(table) if table.count() <= min(most, MAX_BROADCAST_BUCKETS) else table


def _restrict(table: DataFrame, keys: DataFrame, on: str, most: int) -> DataFrame:
    """Rows of ``table`` whose ``on`` is in ``keys``: by broadcast while ``keys`` is small, else by shuffle."""
    if keys.count() <= most:
        keys = F.broadcast(keys)
    return table.join(keys, on, "left_semi")


def _confirm(pairs: DataFrame, sets: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """The pairs (``src, dst``) that are linked: ``sets`` has ``node, text, n_shingles, regs``."""
    needed = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "needed")
    held = materialize(_restrict(sets, needed, "node", most), "texts")
    right = held.select(F.col("node").alias("dst"), F.col("text").alias("text_b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    left = held.select(F.col("node").alias("src"), F.col("text").alias("text_a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    joined = pairs.join(right, "dst").join(left, "src")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, 1 << 20):
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (6, 7))
                na, nb = (part.column(c).to_numpy().astype(float) for c in (4, 5))
                best, ratio = estimate_similarity(a, b, na, nb, percent / 100)
                near = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 * best >= percent) | (ratio < 24))
                part = part.filter(pa.array(near))
                ok = np.zeros(part.num_rows, bool)
                if part.num_rows:
                    va, oa = shingle_sets(part.column(2), size)
                    vb, ob = shingle_sets(part.column(3), size)
                    for i in range(part.num_rows):
                        x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                        at = np.searchsorted(x, y)
                        at[at == len(x)] = 0
                        both = int((x[at] == y).sum())
                        ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select(["src", "dst"]).filter(pa.array(ok))

    return joined.select("src", "dst", "text_a", "text_b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "src long, dst long")


def _mixed(members: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """``band, node, component, major``: members of the buckets that hold several components, and each one's largest."""
    named = members.join(components, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    counted = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    major = counted.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", -F.col("component"))).alias("m")).where("parts > 1")
    major = _small(major.select("band", (-F.col("m.col2")).alias("major")), "major", most)
    return materialize(named.join(major, "band"), "mixed")


def _across(mixed: DataFrame, sets: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """Links (``src, dst``) of classes outside their bucket's largest component to other components.

    Blocks of bounded size count the common shingles of full sets; of the links from a class to a
    component, which all join the same two, the closest is returned.
    """
    needed = materialize(mixed.select("node").distinct(), "needed")

    def shingles(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 2 << 20):
                values, offsets = shingle_sets(part.column(1), size)
                held = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(held, pa.binary())], ["node", "n", "held"])

    held = _restrict(sets, needed, "node", most).select("node", "text").mapInArrow(shingles, "node long, n long, held binary")
    held = materialize(held, "shingles")
    sized = mixed.join(held.select("node", "n"), "node").withColumn("rest", F.col("component") != F.col("major"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK_SHINGLES)).cast("int")
    totals = sized.groupBy("band").agg(parts(F.sum("n")).alias("parts"), parts(F.sum(F.when(F.col("rest"), F.col("n")))).alias("rest_parts"))
    placed = sized.join(_small(totals, "totals", most), "band")
    own, rest_own = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "rest_parts").cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = placed.select("band", own.alias("part"), every("rest_parts").alias("rest_part"), "node", "component", F.lit(False).alias("rest"))
    rests = placed.where("rest").select("band", every("parts").alias("part"), rest_own.alias("rest_part"), "node", "component", F.lit(True).alias("rest"))
    rows = members.union(rests).join(held, "node")

    def compare(table: pa.Table) -> pa.Table:
        rest = table.column("rest").to_numpy(zero_copy_only=False)
        node, component, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
        sets = [np.frombuffer(h, U64) for h in table.column("held").to_pylist()]
        inside, outside = np.flatnonzero(~rest), np.flatnonzero(rest)
        src, dst = [], []
        if len(inside) and len(outside):
            # postings of the members, by shingle
            values = np.concatenate([sets[i] for i in inside])
            owner = np.repeat(np.arange(len(inside)), [len(sets[i]) for i in inside])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for i in outside:
                low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
                both = np.bincount(owner[expand_ranges(low, high - low)], minlength=len(inside))
                near = np.flatnonzero((100 * both >= percent * (n[inside] + n[i] - both)) & (component[inside] != component[i]))
                if len(near):
                    near = near[np.lexsort((-both[near] / (n[inside][near] + n[i] - both[near]), component[inside][near]))]
                    first = np.flatnonzero(np.append(True, np.diff(component[inside][near]) != 0))
                    for m in node[inside][near[first]]:
                        src.append(min(node[i], m))
                        dst.append(max(node[i], m))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("band", "part", "rest_part").applyInArrow(compare, "src long, dst long").distinct()


def _link_across(mixed: DataFrame, links: DataFrame, tested: DataFrame, sets: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """Components after the buckets of ``mixed`` were compared across their components."""
    inside = F.when(F.col("component") == F.col("major"), F.struct(F.xxhash64("node").alias("h"), "node"))
    heads = _small(mixed.groupBy("band").agg(F.min(inside)["node"].alias("leader")), "heads", most)
    pairs = mixed.where("component <> major").join(heads, "band").select(F.least("leader", "node").alias("src"), F.greatest("leader", "node").alias("dst")).distinct()
    pairs = materialize(pairs.join(tested, ["src", "dst"], "left_anti"), "pairs")
    links = materialize(links.union(_confirm(pairs, sets, size, percent, most)), "links")
    second = materialize(connected_components(links), "components")
    mixed = _mixed(mixed.select("band", "node"), second, most)
    more = materialize(_across(mixed, sets, size, percent, most), "links")
    return second if more.isEmpty() else materialize(connected_components(links.union(more)), "components")


def _group(docs: DataFrame, size: int, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (private columns plus ``row, node``) and ``node, component`` of linked classes."""
    signed = materialize(sign(docs, "text", size).withColumn("row", F.monotonically_increasing_id()), "signed")
    key = ["n_shingles", "s1", "s2"]
    classes = materialize(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    sets = signed.select(F.col("row").alias("node"), "text", "n_shingles", "regs")
    standing = signed.select(F.col("row").alias("node"), "regs").join(classes.select("node"), "node", "left_semi")
    bands = materialize(_bands(standing), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1")
    member = materialize(bands.join(buckets, "band"), "buckets")
    pairs = member.where("node <> leader").select(F.col("leader").alias("src"), F.col("node").alias("dst")).distinct()
    links = materialize(_confirm(materialize(pairs, "pairs"), sets, size, percent, most), "links")
    first = materialize(connected_components(links), "components")
    # buckets of three or more whose classes are in several components
    components = first
    mixed = _mixed(member.where("members > 2").select("band", "node"), first, most)
    if not mixed.isEmpty():
        components = _link_across(mixed, links, pairs, sets, size, percent, most)
    labelled = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = labelled.join(heads, "component").select(*key, "component", "component_id")
    return signed, labelled


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    Null or empty text has no shingles and is linked with nothing; rows with equal texts are
    linked; a null id counts as larger than any other and, alone, gives a null component;
    other columns are ignored; an empty table gives an empty result.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed, labelled = _group(mine, size, percent, max_broadcast_keys)
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(labelled, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def remove_near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they are.

    The row with the smallest id stays (of several, any one; a null id only where there is no other).
    Rows without shingles (null or empty text) stay.  An empty table gives an empty result.
    """
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    mine = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if c not in (id_col, text_col)], F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed, labelled = _group(mine, size, percent, max_broadcast_keys)
    rows = signed.where("n_shingles > 0").select("row", "doc_id", "n_shingles", "s1", "s2").join(labelled, ["n_shingles", "s1", "s2"])
    rows = materialize(rows.select("row", "doc_id", "component"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = rows.groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    gone = materialize(rows.select("row").join(stay, "row", "left_anti"), "gone")
    if gone.count() <= max_broadcast_keys:
        gone = F.broadcast(gone)
    left = signed.join(gone, "row", "left_anti")
    back = {id_col: "doc_id", text_col: "text"}
    return left.select(*[F.col(back.get(c, names[c])).alias(c) for c in docs.columns])
