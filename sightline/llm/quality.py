"""Quality rules whose thresholds come from the corpus, in DataFrame operations alone.

Every document is measured with integer metrics.  Per language and source, a metric's
distribution is held in a mergeable quantile sketch: counts of log-linear buckets (the
five leading bits of the value, a relative error below 1/16).  Sketches merge by adding
counts, so they are pre-aggregated before any shuffle, come out the same in any order, and
roll up to a language and to the whole corpus.

A threshold is a robust fence: the median plus a multiple of its distance to the lower quartile,
so up to half of a source may be junk without raising it.  The quartiles of a group are
shrunk towards those of its language, and those towards the corpus's, by the weight of
``PRIOR`` documents.  A document is beyond a fence if the least rate that its counts speak for is:
a few marks in a short text prove nothing.  The constants are the same for all metrics; no
metric has a cutoff of its own.  Documents beyond a fence, or failing the base rules, go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Metrics: counted column, column it is a share of, and how many of the first one finding gives at least.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6),  # a window of three words and its copy
    "capitals": ("n_capitals", "word_chars", 1),
    "marks": ("n_marks", "word_chars", 1),
}
#: Distances of the quartiles beyond the median; where a normal curve has its upper quartile plus three quartile distances.
REACH = 7
#: Least distance of the quartiles, per mille.
SPREAD = 2
#: Standard deviations by which a document's counts are lowered before they are compared.
SIGMAS = 3
#: Documents of a parent group that a group's quartiles are mixed with.
PRIOR = 100
SYMBOLS, MARKS, CAPITALS = "#*$%&|<>", "!?", "A-Z"
SPACES = r"\x20\x09-\x0D"


def _count(text, characters: str):
    """How many characters of ``text`` are in the character class ``characters``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus the base measures; ``text_col`` null counts as no words.

    Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+\\z", "")
    steps = docs.select(
        *[c for c in docs.columns if c != text_col],
        F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, CAPITALS).alias("n_capitals"),
        _count(text, MARKS).alias("n_marks"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]")).alias("_lines"),
        F.filter(F.split(inner, f"[{SPACES}]+"), lambda w: w != "").alias("_words"),
    )
    rest = [c for c in steps.columns if c not in ("_lines", "_words")]
    steps = steps.select(
        *rest,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))").alias("_hashes"),
    )
    rest = [c for c in steps.columns if c != "_hashes"]
    # hash and place of each window of three words, equal windows side by side; nothing where none repeats
    windows = "CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN NULL ELSE sort_array(transform(_hashes, (h, i) -> struct(h as h, i as i))) END"
    steps = steps.select(*rest, F.expr(windows).alias("_windows"))
    steps = steps.select(
        *rest,
        F.expr(
            "sort_array(transform(filter(_windows, (x, k) -> coalesce(get(_windows, k - 1).h = x.h, false)"
            " or coalesce(get(_windows, k + 1).h = x.h, false)), x -> x.i))"
        ).alias("_found"),
    )
    covered = "coalesce(aggregate(transform(_found, (p, k) -> least(3, coalesce(get(_found, k + 1) - p, 3))), 0L, (a, x) -> a + x), 0L)"
    return steps.select(*rest, F.expr(covered).alias("n_repeat_words"))


def _metrics() -> dict:
    """Columns of a measured document: ``m_<metric>``, its rate in per mille (0 where there is nothing to count in),
    and ``b_<metric>``, the least rate that the count speaks for."""
    out = {}
    for metric, (count, total, unit) in METRICS.items():
        k, n = F.col(count), F.greatest(F.col(total), F.lit(1))
        out[f"m_{metric}"] = F.floor(F.lit(1000) * k / n).cast("long")
        out[f"b_{metric}"] = F.floor(F.lit(1000.0) * (k - F.lit(float(SIGMAS)) * F.sqrt((k * F.lit(unit)).cast("double"))) / n).cast("long")
    return out


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, metric, bucket, n``: the mergeable sketch of each metric and group."""
    pairs = F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]), F.array(*[F.col(f"m_{m}") for m in METRICS]))
    long = measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("metric", "v"))
    bucket = F.expr("v - v % shiftleft(1L, greatest(length(bin(v)) - 5, 0))")
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Per group of ``keys``: documents, lower quartile and median of every metric, from merged sketches."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.select(*keys, "metric", "bucket", upto.alias("upto"), F.sum("n").over(group).alias("docs"))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket")))
    per_metric = ranked.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(1).alias("low"), at(2).alias("mid"))
    spread = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{mark}{c}_{m}") for m in METRICS for c in ("low", "mid")]
    return per_metric.groupBy(*keys).agg(F.max("docs").alias(f"{mark}docs"), *spread)


def thresholds(sketch: DataFrame, *, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """``lang, source, f_<metric>...``: each group's fences."""
    own = quartiles(sketch, ["lang", "source"], "o_").alias("o")
    by_lang = quartiles(sketch, ["lang"], "l_").withColumnRenamed("lang", "own_lang")
    every = quartiles(sketch.withColumn("all", F.lit(1)), ["all"], "a_").drop("all")
    joined = own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("own_lang"))).join(F.broadcast(every), F.lit(True))  # one row
    mixed = lambda mark, column, parent: F.expr(f"({mark}docs * {mark}{column} + {prior} * {parent}) div ({mark}docs + {prior})")
    out = []
    for m in METRICS:
        for c in ("low", "mid"):
            joined = joined.withColumn(f"p_{c}", mixed("l_", f"{c}_{m}", f"a_{c}_{m}"))
            joined = joined.withColumn(f"{c}_{m}", mixed("o_", f"{c}_{m}", f"p_{c}"))
        out.append((F.col(f"mid_{m}") + F.lit(reach) * F.greatest(F.col(f"mid_{m}") - F.col(f"low_{m}"), F.lit(SPREAD))).alias(f"f_{m}"))
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *out)


#: Most groups whose fences are broadcast; above, the join is a shuffle.
MAX_BROADCAST_GROUPS = 50_000
ADDED = ["word_chars", "n_symbols", "n_capitals", "n_marks", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, reach: int, prior: int, max_broadcast_groups: int, with_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """All columns under private names plus the measures and verdict; column -> private name."""
    mine = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items() if with_text or c != text_col], F.col(text_col).alias("text"))
    measured = measure(slim, "text")
    measured = measured.select(*measured.columns, *[c.alias(m) for m, c in _metrics().items()])
    measured = materialize(measured, "quality")
    limits = materialize(thresholds(sketches(measured, mine[lang_col], mine[source_col]), reach=reach, prior=prior), "quality-fences")
    if limits.count() <= max_broadcast_groups:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col(mine[lang_col]).eqNullSafe(F.col("lang")) & F.col(mine[source_col]).eqNullSafe(F.col("source")), "left")
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    beyond = F.lit(False)
    for m in METRICS:
        beyond = beyond | (F.col(f"b_{m}") > F.col(f"f_{m}"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond), mine


def judge_quality(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    reach: int = REACH,
    prior: int = PRIOR,
    max_broadcast_groups: int = MAX_BROADCAST_GROUPS,
) -> DataFrame:
    """The rows of ``docs`` without the text, with their measures, ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than 50 words or with more than half of
    its words in repeated three-word windows; it is kept if it does not and no metric is
    beyond the fence of its language and source.  Null text has no words; null language
    or source is a group of its own; repeated rows are judged each; columns of ``docs``
    that carry a name this operator adds are not returned; an empty table gives an empty result.
    """
    judged, mine = _judged(docs, text_col, lang_col, source_col, reach, prior, max_broadcast_groups, False)
    carried = [F.col(n).alias(c) for c, n in mine.items() if c != text_col and c.lower() not in ADDED]
    return judged.select(*carried, *ADDED)


def keep_good(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    reach: int = REACH,
    prior: int = PRIOR,
    max_broadcast_groups: int = MAX_BROADCAST_GROUPS,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with all their columns.

    Nulls, repeated rows and empty tables as there; columns may carry any names.
    """
    judged, mine = _judged(docs, text_col, lang_col, source_col, reach, prior, max_broadcast_groups, True)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in mine.items()])
