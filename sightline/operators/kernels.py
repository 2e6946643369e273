"""Reductions of line-of-sight samples: integer sums first, one division at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators.summaries import exact_quantiles

PAIR = ["source_h3", "target_h3"]


def pixel_accumulate(samples: DataFrame, visible: Column, weight: Column) -> DataFrame:
    """First level: per source, target and pixel - observers, distance and weight sums, mask of observers."""
    metres = F.col("distance_km") * F.lit(1000.0)
    shown = samples.where(visible).withColumns({"mm": S.quantize_distance(metres), "weight_q": S.quantize_weight(weight)})
    return shown.groupBy(*PAIR, "pixel").agg(
        F.count("*").alias("visible_count"), F.sum("mm").alias("distance_mm_sum"), F.min("mm").alias("distance_mm_min"), F.max("mm").alias("distance_mm_max"),
        F.sum("weight_q").alias("weight_q_sum"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("observer") - 1).cast("int"))).alias("observer_mask"),
    )


def pixels_to_targets(pixels: DataFrame) -> DataFrame:
    """Second level: per source and target - pixels, pairs, weights, distances, distinct observers (at most 63)."""
    return pixels.groupBy(*PAIR).agg(
        F.count("*").alias("visible_pixels"), F.sum("visible_count").alias("visible_pairs"), F.max("visible_count").alias("most_observers"),
        F.sum("weight_q_sum").alias("weight_q_sum"), F.min("distance_mm_min").alias("nearest_mm"), F.max("distance_mm_max").alias("farthest_mm"),
        F.sum("distance_mm_sum").alias("distance_mm_sum"), F.bit_count(F.bit_or("observer_mask")).alias("observers"),
    )


def kernel_support(grouped: DataFrame, denominators: DataFrame, *, observers: int, stride: int = 1, pixel_area_m2: float = 900.0, least_pixels: int = 1, least_km2: float = 0.0) -> DataFrame:
    """Fractions of the whole observer x pixel population per pair.

    ``denominators``: ``target_h3, water_pixels, water_km2`` of the whole domain.  Joint and
    distance-weighted fractions, observer and area fractions, all clipped to [0, 1].
    """
    joined = grouped.join(denominators, "target_h3")
    area = F.col("visible_pixels") * F.lit(pixel_area_m2 * stride * stride / 1e6)
    whole = F.lit(float(observers)) * F.col("water_pixels")
    scale = F.lit(float(stride * stride))
    return joined.where((F.col("visible_pixels") >= least_pixels) & (area >= least_km2)).select(
        *PAIR,
        S.clip(S.ratio(F.col("visible_pairs") * scale, whole)).alias("joint_fraction"),
        S.clip(S.ratio(F.col("weight_q_sum") / F.lit(float(S.WEIGHT_SCALE)) * scale, whole)).alias("weighted_fraction"),
        S.clip(S.ratio(F.col("observers"), F.lit(float(observers)))).alias("observer_fraction"),
        S.clip(S.ratio(area, F.col("water_km2"))).alias("area_fraction"),
    )


def water_kernel(samples: DataFrame, visible: Column, weight: Column) -> DataFrame:
    """Pair kernel over all observer x target samples; hidden samples stay in the denominator."""
    marked = samples.withColumns({"seen": F.coalesce(visible, F.lit(False)), "weight_q": S.quantize_weight(weight)})
    grouped = marked.groupBy(*PAIR).agg(
        F.count("*").alias("samples"), F.count_if("seen").alias("visible_pairs"), F.sum(F.when(F.col("seen"), F.col("weight_q")).otherwise(0)).alias("weight_q_sum"),
        F.countDistinct(F.when(F.col("seen"), F.col("pixel"))).alias("seen_targets"), F.countDistinct("pixel").alias("targets"),
        F.countDistinct(F.when(F.col("seen"), F.col("observer"))).alias("seen_observers"), F.countDistinct("observer").alias("observers"),
    )
    return grouped.select(
        *PAIR, "samples", "visible_pairs", (F.col("visible_pairs") > 0).alias("terrain_binary"),
        S.ratio(F.col("visible_pairs"), F.col("samples")).alias("joint_fraction"),
        S.ratio(F.col("weight_q_sum") / F.lit(float(S.WEIGHT_SCALE)), F.col("samples")).alias("weighted_fraction"),
        S.ratio(F.col("seen_targets"), F.col("targets")).alias("union_fraction"), S.ratio(F.col("seen_observers"), F.col("observers")).alias("observer_fraction"),
    )


def support_bounds(states: DataFrame, cell: str, value: str = "value", weight: str = "weight") -> DataFrame:
    """Transmission bounds per cell over its whole population.

    ``value``: transmission in [0, 1], -1 unknown, -2 out of range; both stay in the denominator.
    ``score`` is null where anything is unknown.
    """
    v, w = F.col(value), F.col(weight)
    sums = states.groupBy(cell).agg(
        F.sum(w).alias("total"), F.sum(F.greatest(v, F.lit(0.0)) * w).alias("known"),
        F.sum(F.when(v == -1, w).otherwise(0)).alias("unknown_w"), F.sum(F.when(v == -2, w).otherwise(0)).alias("out_w"),
    )
    lower = S.ratio(F.col("known"), F.col("total"))
    return sums.select(
        cell, F.when(F.col("unknown_w") == 0, lower).alias("score"), lower.alias("lower"), S.ratio(F.col("known") + F.col("unknown_w"), F.col("total")).alias("upper"),
        S.ratio(F.col("unknown_w"), F.col("total")).alias("unknown"), S.ratio(F.col("out_w"), F.col("total")).alias("out_of_range"),
    )


def conditional_weights(states: DataFrame, cell: str) -> DataFrame:
    """Terrain weight and conditional above-ground bounds per cell.

    Rows carry ``bare`` (1, 0, -2), ``joint`` (transmission, -1, -2), ``decay`` and ``weight``.
    Without terrain support the conditional factor does not apply (null), unlike the neutral 1 of
    static weights.
    """
    w = F.col("decay") * F.col("weight")
    sums = states.groupBy(cell).agg(
        F.sum("weight").alias("total"), F.sum(F.when(F.col("bare") == 1, w).otherwise(0)).alias("terrain"),
        F.sum(F.greatest(F.col("joint"), F.lit(0.0)) * w).alias("low"), F.sum(F.when((F.col("joint") == -1) & (F.col("bare") == 1), w).otherwise(0)).alias("missing"),
    )
    t = F.col("terrain")
    lower, upper = S.clip(S.ratio(F.col("low"), t)), S.clip(S.ratio(F.col("low") + F.col("missing"), t))
    return sums.select(
        cell, S.ratio(t, F.col("total")).alias("weight_terrain"), lower.alias("above_ground_lower"), upper.alias("above_ground_upper"),
        F.when(F.col("missing") == 0, lower).alias("weight_above_ground"),
        F.when(t == 0, "not_applicable").when(F.col("missing") > 0, "unknown").otherwise("known").alias("above_ground_status"),
    )


def census_gate(sampled: DataFrame, census: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Sampled values while their largest difference from the census is within tolerance, else the census.

    One row per key: ``value, used`` ("sampled" or "census").
    """
    both = sampled.select(*keys, F.col(value).alias("s")).join(census.select(*keys, F.col(value).alias("c")), keys)
    gap = F.when(F.col("s").isNull() != F.col("c").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.abs(F.col("s") - F.col("c")), F.lit(0.0)))
    both = both.withColumn("gap", gap)
    errors = exact_quantiles(both, "gap", [0.95, 1.0]).select(F.col("quantiles")[1].alias("max_error"), F.col("quantiles")[0].alias("p95_error"))
    joined = both.join(F.broadcast(errors))  # one row
    fits = F.col("max_error") <= tolerance
    return joined.select(*keys, F.when(fits, F.col("s")).otherwise(F.col("c")).alias(value), F.when(fits, "sampled").otherwise("census").alias("used"), "max_error", "p95_error")
