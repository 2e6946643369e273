"""Summaries of pair tables by target, source or class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import scalars as S

FACTORS = ("weight_terrain", "weight_vegetation", "weight_distance", "weight_static_viewability")


def pair_summary(pairs: DataFrame, key: str, *, role: str = "land") -> DataFrame:
    """Per source or target: pairs, cells, positives, mean, max and sum of every factor, canopy where terrain supports.

    Vegetation does not apply to water: its statistics are null there.
    """
    other = "target_h3" if key == "source_h3" else "source_h3"
    stats = [f(c).alias(f"{n}_{c}") for c in FACTORS for n, f in (("mean", F.avg), ("max", F.max), ("sum", F.sum))]
    supported = F.col("weight_terrain") > 0
    out = pairs.groupBy(key).agg(
        F.count("*").alias("candidate_pairs"), F.countDistinct(other).alias("candidate_cells"), F.count_if(F.col("weight_static_viewability") > 0).alias("positive_static_pairs"), *stats,
        F.avg(F.when(supported, F.col("weight_vegetation"))).alias("mean_canopy_given_terrain_support"), F.count_if(supported).alias("terrain_supported_pairs"),
    )
    out = out.withColumn("positive_static_fraction", S.ratio(F.col("positive_static_pairs"), F.col("candidate_pairs")))
    if role == "water":
        none = F.lit(None).cast("double")
        out = out.withColumns({c: none for c in ("mean_canopy_given_terrain_support", *(f"{n}_weight_vegetation" for n in ("mean", "max", "sum")))})
        out = out.withColumn("canopy_support", F.lit("not_applicable"))
    return out


def view_score(pairs: DataFrame) -> DataFrame:
    """Per target: sum, mean, best, visible and candidate sources, visibility.

    A source counts as visible by its own terrain support; hidden sources do not add one more.
    """
    s, terrain = F.col("weight_static_viewability"), F.max("weight_terrain")
    # one row a source first: two distinct counts side by side would repeat every pair
    sources = pairs.groupBy("target_h3", "source_h3").agg(F.sum(s).alias("s"), F.count(s).alias("n"), F.max(s).alias("best"), terrain.alias("weight_terrain"))
    return sources.groupBy("target_h3").agg(
        F.sum("s").alias("view_score"), S.ratio(F.sum("s"), F.sum("n")).alias("mean_view_score"), F.max("best").alias("best_view_score"),
        F.count(F.when(F.col("weight_terrain") > 0, F.col("source_h3"))).alias("visible_source_count"),
        F.count("source_h3").alias("candidate_source_count"), (terrain > 0).alias("binary_visible"),
    )


def distance_summary(pairs: DataFrame, key: str) -> DataFrame:
    """Per source or target: partners, sum, mean, max and exact 90th percentile of the distance weight, nearest and mean distance."""
    other = "target_h3" if key == "source_h3" else "source_h3"
    w = F.col("weight_distance")
    return pairs.groupBy(key).agg(
        F.countDistinct(other).alias("partners"), F.sum(w).alias("sum_weight"), F.avg(w).alias("mean_weight"), F.max(w).alias("max_weight"),
        F.percentile(w, F.lit(0.9)).alias("p90_weight"), F.min("distance_km").alias("nearest_km"), F.avg("distance_km").alias("mean_km"),
    )


def metric_coverage(value: Column, applies: Column, name: str) -> list[Column]:
    """Aggregates of a nullable metric: complete and available sum, mean, counts, coverage and status."""
    valid, missing = F.count(value), F.count_if(value.isNull() & applies)
    both = valid + missing
    return [
        F.when((valid > 0) & (missing == 0), F.sum(value)).alias(name), F.when(valid > 0, F.sum(value)).alias(f"{name}_available"), F.avg(value).alias(f"{name}_mean_valid"),
        valid.alias(f"{name}_valid_count"), missing.alias(f"{name}_missing_count"), both.alias(f"{name}_applicable_count"), (F.count("*") - both).alias(f"{name}_not_applicable_count"),
        S.ratio(valid, both).alias(f"{name}_coverage_fraction"),
        F.when(both == 0, "not_applicable").when(valid == 0, "unavailable").when(missing > 0, "partial").otherwise("complete").alias(f"{name}_status"),
    ]


def _map_metrics(combined: str) -> list[Column]:
    """Sums with coverage of distance, vegetation, terrain and static weight.

    Vegetation applies only to land pairs with terrain support.
    """
    terrain = F.col("weight_terrain")
    exempt = F.coalesce((F.col("source_type") == "water") | (terrain == 0), F.col("source_type") == "water", F.lit(False))
    vegetation = F.when(~exempt & (terrain > 0), F.col("weight_vegetation"))
    yes = F.lit(True)
    return [
        *metric_coverage(F.col("weight_distance"), yes, "distance_weight_sum"), *metric_coverage(vegetation, ~exempt, "vegetation_weight_sum"),
        *metric_coverage(terrain, yes, "terrain_weight_sum"), *metric_coverage(F.col("net_static_weight"), yes, combined), F.count("*").alias("pair_count"),
    ]


def map_target_sums(edges: DataFrame) -> DataFrame:
    """Per target: sums with coverage; missing is never zero."""
    return edges.groupBy("target_h3").agg(
        *_map_metrics("target_static_kernel_sum"), F.countDistinct("source_h3").alias("candidate_source_count"),
        F.count_if(F.col("weight_terrain") > 0).alias("terrain_visible_source_count"), F.count_if(F.col("net_static_weight") > 0).alias("combined_visible_source_count"),
    )


def static_map_edges(edges: DataFrame, by: str) -> DataFrame:
    """Per source or target: sums with coverage, and pairs with terrain support."""
    if by not in ("source_h3", "target_h3"):
        raise ValueError("by must be source_h3 or target_h3")
    return edges.groupBy(by).agg(*_map_metrics(f"{by[:6]}_static_kernel_sum"), F.count_if(F.col("weight_terrain") > 0).alias("terrain_supported_pair_count"))


def dual_surface_metrics(factors: DataFrame, slack: float = 1e-6) -> DataFrame:
    """One row: pairs, pairs visible on either surface, pairs whose canopy support exceeds the bare one, and the largest excess."""
    excess = F.col("weight_canopy_los_raw") - F.col("weight_terrain")
    return factors.agg(
        F.count("*").alias("pair_count"), F.count_if(F.col("canopy_los_fraction") > F.col("bare_los_fraction") + slack).alias("unweighted_excess_pair_count"),
        F.count_if(excess > slack).alias("substantial_excess_pair_count"), F.count_if(F.col("weight_terrain") > 0).alias("bare_visible_pair_count"),
        F.count_if(F.col("weight_canopy_los") > 0).alias("canopy_visible_pair_count"), F.count_if(excess > 0).alias("excess_pair_count"),
        F.coalesce(F.max(F.greatest(excess, F.lit(0.0))), F.lit(0.0)).alias("largest_excess"),
    )


def overview_maximum(pairs: DataFrame, value: str) -> DataFrame:
    """Per target: largest valid value, counts and state."""
    v = F.col(value)
    out = pairs.groupBy("target_h3").agg(F.max(v).alias("maximum"), F.count(v).alias("valid_count"), F.count("*").alias("candidate_count"))
    missing = F.col("candidate_count") - F.col("valid_count")
    return out.withColumns({"missing_count": missing, "state": F.when(F.col("valid_count") == 0, "unavailable").when(missing > 0, "partial").otherwise("complete")})


def strongest_sources(pairs: DataFrame, value: str) -> DataFrame:
    """Per target: largest value, all sources that reach it (sorted), contributors, and sources outside its candidates."""
    best = pairs.groupBy("target_h3").agg(F.max(value).alias("maximum"), F.count(value).alias("contributors"), F.count("*").alias("candidates"))
    top = pairs.join(best, "target_h3").where(F.col(value) == F.col("maximum"))
    named = top.groupBy("target_h3").agg(F.array_join(F.array_sort(F.collect_set("source_h3")), ",").alias("strongest"))
    every = pairs.agg(F.countDistinct("source_h3").alias("every"))
    return best.join(named, "target_h3", "left").join(F.broadcast(every)).select("target_h3", "maximum", "strongest", "contributors", (F.col("every") - F.col("candidates")).alias("outside"))


def top_source(pairs: DataFrame, weight: str = "weight_terrain") -> DataFrame:
    """The source with most visible targets; ties go to the smallest id."""
    seen = pairs.where(F.coalesce(F.col(weight), F.lit(0.0)) > 0).groupBy("source_h3").agg(F.countDistinct("target_h3").alias("visible_targets"))
    return seen.orderBy(F.desc("visible_targets"), "source_h3").limit(1)


def histogram(pairs: DataFrame, value: str, by: str, bins: int = 20) -> DataFrame:
    """Pairs per bin of [0, 1] and role, and their share of the role."""
    bin_ = F.least(F.greatest(F.floor(F.col(value) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = pairs.groupBy(by, bin_.alias("bin")).agg(F.count("*").alias("pairs"))
    return counted.withColumn("fraction", S.ratio(F.col("pairs"), F.sum("pairs").over(Window.partitionBy(by))))


def distance_bins(pairs: DataFrame, value: str) -> DataFrame:
    """Pairs and mean value per whole kilometre."""
    return pairs.groupBy(F.floor("distance_km").cast("long").alias("km")).agg(F.count("*").alias("pairs"), F.avg(value).alias("mean_value"))


def exact_quantiles(values: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """One row, ``quantiles``: exact quantiles of the values that are not null, interpolated between neighbours.

    Equal values are counted first and dealt by ranges; the place of a value follows from running
    counts inside its range and the totals of the ranges before, so no task holds all values.
    An empty column gives null.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = counted.repartitionByRange(n, "v").withColumn("range", F.spark_partition_id())
    inside = placed.withColumn("own", F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranges = inside.groupBy("range").agg(F.sum("n").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("range", before.alias("earlier"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    ranked = inside.join(starts, "range").withColumn("first", F.col("own") + F.col("earlier"))
    # of every quantile the values at the places below and above it: two rows each at most
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    holds = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("n"))
    sums = []
    for p in probabilities:
        low, high = F.max(F.when(holds(F.floor(place(p))), F.col("v"))), F.max(F.when(holds(F.ceil(place(p))), F.col("v")))
        share = F.max(place(p) - F.floor(place(p)))
        sums.append(low + share * (high - low))
    return ranked.agg(F.array(*sums).alias("quantiles")).withColumn("quantiles", F.when(F.col("quantiles")[0].isNotNull(), F.col("quantiles")))


def factor_quantiles(pairs: DataFrame, value: str) -> DataFrame:
    """One row: mean, exact median and 95th percentile, share of zeros."""
    v = F.col(value)
    rest = pairs.agg(F.avg(v).alias("mean"), S.ratio(F.count_if(v == 0), F.count(v)).alias("zero_fraction"))
    found = exact_quantiles(pairs, value, [0.5, 0.95]).select(F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p95"))
    return rest.join(F.broadcast(found)).select("mean", "p50", "p95", "zero_fraction")  # one row each


def quantile_classes(values: DataFrame, value: str, classes: int = 10) -> DataFrame:
    """``class`` 1..n of positive values by exact quantiles; 0 for none, negative or not finite."""
    v = F.col(value)
    positive = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    breaks = exact_quantiles(values.where(positive), value, [k / classes for k in range(1, classes)])
    found = F.size(F.filter("quantiles", lambda b: b <= v)) + 1
    return values.join(F.broadcast(breaks)).withColumn("class", F.when(positive, found).otherwise(F.lit(0))).drop("quantiles")  # one row


def report_summary(pairs: DataFrame) -> DataFrame:
    """One row: means, share of positive pairs, reduction by canopy."""
    t, s = F.sum("weight_terrain"), F.sum("weight_static_viewability")
    return pairs.agg(
        F.count("*").alias("pairs"), F.avg("weight_terrain").alias("mean_terrain"), F.avg("weight_static_viewability").alias("mean_static"),
        S.ratio(F.count_if(F.col("weight_static_viewability") > 0), F.count("*")).alias("positive_fraction"), (F.lit(1.0) - S.ratio(s, t)).alias("canopy_reduction"),
    )


def ray_statistics(rays: DataFrame, keys: list[str], value: str, requested: int) -> DataFrame:
    """Per pair: mean, median, extremes, population deviation and quartiles of valid rays, counts and valid share."""
    v = F.col(value)
    return rays.groupBy(*keys).agg(
        F.lit(requested).alias("requested_rays"), F.count("*").alias("completed_rays"), F.count(v).alias("valid_rays"), S.ratio(F.count(v), F.count("*")).alias("valid_fraction"),
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"),
    )


def zonal_statistics(pixels: DataFrame, cell: str, value: str) -> DataFrame:
    """Per cell: count, mean, median, extremes and population deviation."""
    v = F.col(value)
    return pixels.groupBy(cell).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"))


def zonal_classes(pixels: DataFrame, cell: str, code: str) -> DataFrame:
    """Per cell: most frequent class (ties: smallest) and its share."""
    counted = pixels.groupBy(cell, code).agg(F.count("*").alias("n"))
    most = F.max_by(F.col(code), F.struct(F.col("n"), -F.col(code)))
    return counted.groupBy(cell).agg(most.alias("mode"), S.ratio(F.max("n"), F.sum("n")).alias("share"), F.count("*").alias("classes"))


def class_shares(pixels: DataFrame, cell: str, code: str, classes: list[int]) -> DataFrame:
    """Per cell: share of each of ``classes``."""
    return pixels.groupBy(cell).agg(*[S.ratio(F.count_if(F.col(code) == c), F.count("*")).alias(f"share_{c}") for c in classes])


def state_counts(samples: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Per key: clear, blocked, unknown, out-of-range samples and the bounds of the mean."""
    s = F.col(state)
    out = samples.groupBy(*keys).agg(F.count_if(s == 1).alias("clear"), F.count_if(s == 0).alias("blocked"), F.count_if(s == -1).alias("unknown"), F.count_if(s == -2).alias("out_of_range"))
    return out.withColumns({"lower": S.ratio(F.col("clear"), F.col("clear") + F.col("blocked") + F.col("unknown")), "upper": S.ratio(F.col("clear") + F.col("unknown"), F.col("clear") + F.col("blocked") + F.col("unknown"))})


def metric_summary(values: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: valid, null, zero and positive counts, sum, mean, and the sum only where nothing is missing."""
    v = F.col(value)
    return values.groupBy(by).agg(
        F.count(v).alias("valid"), F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"),
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.when(F.count_if(v.isNull()) == 0, F.sum(v)).alias("full_total"),
    )


def filter_funnel(pairs: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row: candidates left after each cumulative condition, in one scan."""
    counts, so_far = [], F.lit(True)
    for name, condition in steps:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    return pairs.agg(F.count("*").alias("all_pairs"), *counts)


def merge_coverage(modelled: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Bounds of sites from modelled targets and uncovered ones, weighted by water pixels (columns ``site, pixels, lower, upper``)."""
    missing = uncovered.select("site", "pixels", F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"))
    both = modelled.select("site", "pixels", "lower", "upper").unionByName(missing)
    mean = lambda c: S.ratio(F.sum(F.col(c) * F.col("pixels")), F.sum("pixels"))
    return both.groupBy("site").agg(F.sum("pixels").alias("pixels"), mean("lower").alias("lower"), mean("upper").alias("upper"))


def display_maximum(values: DataFrame, value: str, quantile: float = 0.98) -> DataFrame:
    """One row: quantile of the positive values, the maximum if there is none, at least something above 0."""
    v = F.col(value)
    found = exact_quantiles(values.where(v > 0), value, [quantile]).select(F.col("quantiles")[0].alias("q"))
    most = values.agg(F.max(v).alias("most")).join(F.broadcast(found))  # one row each
    return most.select(F.coalesce(F.when(F.col("q") > 0, F.col("q")), F.when(F.col("most") > 0, F.col("most")), F.lit(1.0)).alias("display_max"))


def sampling_summary(samples: DataFrame, key: str, requested: int) -> DataFrame:
    """One row: sources, samples, fewest, median, mean and most a source, shortfalls."""
    per = samples.groupBy(key).agg(F.count("*").alias("n"))
    n = F.col("n")
    return per.agg(F.count("*").alias("sources"), F.sum(n).alias("samples"), F.min(n).alias("fewest"), F.percentile(n, F.lit(0.5)).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("most"), F.count_if(n < requested).alias("short"))
