"""Pixel tables: surface composition, repair, water, buildings and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose_above_ground(pixels: DataFrame) -> DataFrame:
    """``height, unknown`` of pixels with ``canopy, canopy_unknown, building, building_unknown, water``.

    The larger height counts; either unknown makes it unknown; water has no height, and a
    height on water is a conflict and so unknown.
    """
    height = F.greatest(F.coalesce("canopy", F.lit(0.0)), F.coalesce("building", F.lit(0.0)))
    conflict = F.col("water") & (height > 0)
    return pixels.withColumns({
        "height": F.when(F.col("water"), F.lit(0.0)).otherwise(height),
        "unknown": conflict | (~F.col("water") & (F.coalesce("canopy_unknown", F.lit(False)) | F.coalesce("building_unknown", F.lit(False)))),
    })


def canopy_surface(pixels: DataFrame, least_height: float = 2.0) -> DataFrame:
    """``surface``: elevation plus canopy on land; low canopy, water and missing canopy add nothing."""
    canopy = F.when(~F.col("water") & (F.col("canopy") >= least_height), F.col("canopy")).otherwise(F.lit(0.0))
    return pixels.withColumn("surface", F.col("dem") + F.coalesce(canopy, F.lit(0.0)))


def clear_observer(pixels: DataFrame, observers: DataFrame, radius: float) -> DataFrame:
    """``canopy`` set to 0 within ``radius`` of the observer of the same source (``x, y`` against ``ox, oy``)."""
    joined = pixels.join(observers, "source_h3")
    away = F.sqrt(F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2)))
    return joined.withColumn("canopy", F.when(away <= radius, F.lit(0.0)).otherwise(F.col("canopy"))).drop("ox", "oy")


def flatten_water(pixels: DataFrame, level: float = 0.0) -> DataFrame:
    """Elevation of marine pixels set to sea level."""
    return pixels.withColumn("dem", F.when(F.col("marine"), F.lit(level)).otherwise(F.col("dem")))


def nodata_policy(pixels: DataFrame, policy: str, barrier: float = 10_000.0) -> DataFrame:
    """Missing elevations raise (``error``) or become an opaque barrier."""
    if policy == "opaque_barrier":
        return pixels.withColumn("dem", F.coalesce("dem", F.lit(barrier)))
    if policy == "error":
        return pixels.withColumn("dem", F.coalesce("dem", F.raise_error(F.lit("elevation missing")).cast("double")))
    raise ValueError(f"unknown policy {policy!r}")


def repair_endpoints(pixels: DataFrame, source: DataFrame) -> DataFrame:
    """Missing elevations filled by the source's value, else by the median of at least three of the eight neighbours.

    ``pixels``: ``row, col, dem``; ``source``: ``row, col, value``.  Only missing pixels are touched, and
    only they take part in the neighbour join.
    """
    missing = pixels.where("dem is null").select("row", "col")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    around = missing.withColumn("s", F.explode(steps)).select(F.col("row").alias("m_row"), F.col("col").alias("m_col"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    near = around.join(pixels.where("dem is not null"), ["row", "col"]).groupBy(F.col("m_row").alias("row"), F.col("m_col").alias("col"))
    near = near.agg(F.percentile("dem", F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    filled = missing.join(source, ["row", "col"], "left").join(near, ["row", "col"], "left")
    filled = filled.select("row", "col", F.coalesce("value", F.when(F.col("n") >= 3, F.col("median"))).alias("fill"))
    return pixels.join(filled, ["row", "col"], "left").withColumn("dem", F.coalesce("dem", "fill")).drop("fill")


def building_pixels(footprints: DataFrame, *, assume_complete: bool) -> DataFrame:
    """Per pixel (``row, col, height``): largest known height, and whether its height is unknown.

    Heights of footprints are null where missing.  With a complete inventory only footprints
    without height are unknown; otherwise pixels without any footprint are too (they are
    absent here, so callers treat absent rows as unknown).
    """
    out = footprints.groupBy("row", "col").agg(F.max("height").alias("height"), F.bool_or(F.col("height").isNull()).alias("missing"))
    return out.withColumn("unknown", F.col("missing")).withColumn("complete", F.lit(assume_complete))


def parse_height(height: Column) -> Column:
    """Building height with negative markers read as missing."""
    return F.when(height >= 0, height)


def resample_max(pixels: DataFrame, factor: int, value: str) -> DataFrame:
    """Largest value of each block of ``factor`` x ``factor`` pixels."""
    return pixels.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.max(value).alias(value))


def area_fractions(pixels: DataFrame, cell: str, land: Column) -> DataFrame:
    """Per cell: pixels, and the land and water shares."""
    share = F.avg(F.when(land, F.lit(1.0)).otherwise(F.lit(0.0)))
    return pixels.groupBy(cell).agg(F.count("*").alias("pixels"), share.alias("land_fraction"), (F.lit(1.0) - share).alias("water_fraction"))


def land_cells(cells: DataFrame, *, least_land: float, most_water: float | None = None, coastal_km: float | None = None) -> DataFrame:
    """Cells with enough land, not too much water, and near enough to water."""
    out = cells.where(F.col("land_fraction") >= least_land)
    if most_water is not None:
        out = out.where(F.col("water_fraction") <= most_water)
    if coastal_km is not None:
        out = out.where(F.col("distance_to_water_km") <= coastal_km)
    return out


def water_denominators(pixels: DataFrame, cell: str, area_m2: float, pixel_m2: float) -> DataFrame:
    """Per cell: water area and equivalent water pixels (rounded half to even, 1 at least)."""
    area = F.count("*") * F.lit(area_m2)
    n = F.when(area > 0, F.greatest(F.lit(1), F.bround(area / F.lit(pixel_m2), 0))).otherwise(0)
    return pixels.groupBy(cell).agg(area.alias("total_water_area_m2"), n.cast("long").alias("equivalent_water_pixel_count"))


def smooth_inside(pixels: DataFrame, value: str, sigma: float) -> DataFrame:
    """``row, col, value``: Gaussian mean of the pixels with a value, at the pixels with a value; what is missing has no weight.

    Every pixel is sent to the pixels within three standard deviations, partial sums are added before the shuffle.
    """
    reach = int(3 * sigma + 0.5)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    known = pixels.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"))
    weigh = lambda d: F.exp(F.lit(-0.5) * F.col(d) * F.col(d) / F.lit(sigma * sigma))
    sent = known.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    sent = sent.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "v", (weigh("dr") * weigh("dc")).alias("w"))
    sums = sent.groupBy("row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))
    return sums.join(known.select("row", "col"), ["row", "col"], "left_semi")
