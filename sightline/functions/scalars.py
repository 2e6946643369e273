"""Column expressions for distances, decay, states and vegetation.

Every function takes and returns columns; none needs a session, so batch and
structured-streaming queries share them.  Null in gives null out unless stated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scientific constants
HAVERSINE_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6_378_137.0
CURVATURE = 0.85714
BETA_PER_M = 0.002
HEIGHT_BREAKS_M = (2.0, 5.0, 15.0)
BAND_OBSTRUCTION = (0.0, 0.25, 0.65, 1.0)
DISTANCE_SCALE, WEIGHT_SCALE = 1_000, 1_000_000
NODATA = -9999.0
# land-cover class -> (obstruction multiplier, obstruction floor, source access): fixed values
CLASS_WEIGHTS = {
    10: (1.00, 0.10, 0.25),
    20: (0.65, 0.15, 0.35),
    30: (0.15, 0.03, 0.65),
    40: (0.25, 0.05, 0.35),
    50: (0.40, 0.20, 0.85),
    60: (0.05, 0.00, 0.75),
    70: (0.05, 0.00, 0.05),
    80: (0.00, 0.00, 0.00),
    90: (0.45, 0.10, 0.20),
    95: (0.90, 0.20, 0.10),
    100: (0.10, 0.03, 0.15),
}
# average edge length of a hexagonal cell in kilometres, by resolution: fixed values
EDGE_KM = (
    1281.256011, 483.056839, 182.512956, 68.979222, 26.071760, 9.854091, 3.724533, 1.406476,
    0.531414, 0.200786, 0.075864, 0.028663, 0.010830, 0.004092, 0.001546, 0.000584,
)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` limited to [low, high]; null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_up(x: Column) -> Column:
    """Rounded half up to a whole number (not to even)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres of points in degrees."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return F.lit(2 * HAVERSINE_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


@dataclass(frozen=True)
class Decay:
    """A distance-decay curve.

    ``kind``: ``logistic`` (``d50``, ``slope``), ``exponential`` (``scale``) or ``piecewise`` (``near``, ``far``).
    ``normalize`` divides by the value at 0; beyond ``cutoff`` the weight is 0.
    """

    kind: str = "logistic"
    d50: float = 9.0
    slope: float = 2.7
    scale: float = 8.0
    near: float = 3.0
    far: float = 30.0
    normalize: bool = True
    cutoff: float = 30.0

    def at(self, d: float) -> float:
        """The curve as a number, before the cutoff."""
        if self.kind == "logistic":
            x = (d - self.d50) / self.slope
            return 1 / (1 + math.exp(x)) if x < 0 else math.exp(-x) / (1 + math.exp(-x))
        if self.kind == "exponential":
            return math.exp(-d / self.scale)
        return min(1.0, max(0.0, (self.far - d) / (self.far - self.near)))

    def weight(self, distance: Column | str) -> Column:
        """Weight in [0, 1] of a distance in kilometres (double)."""
        d = _c(distance)
        if self.kind == "logistic":
            x = (d - F.lit(self.d50)) / F.lit(self.slope)
            e = F.exp(-F.abs(x))  # cannot overflow
            w = F.when(x >= 0, e / (e + F.lit(1.0))).otherwise(F.lit(1.0) / (e + F.lit(1.0)))
        elif self.kind == "exponential":
            w = F.exp(-d / F.lit(self.scale))
        elif self.kind == "piecewise":
            w = (F.lit(self.far) - d) / F.lit(self.far - self.near)
            w = F.when(d <= self.near, F.lit(1.0)).when(d >= self.far, F.lit(0.0)).otherwise(w)
        else:
            raise ValueError(f"unknown curve {self.kind!r}")
        if self.normalize:
            w = w / F.lit(self.at(0.0))
        return F.when(d <= F.lit(self.cutoff), clip(w)).when(d.isNotNull(), F.lit(0.0))


def quantize_weight(w: Column) -> Column:
    """Weight in whole millionths: sums of these are exact in any order."""
    return half_up(w * F.lit(float(WEIGHT_SCALE)))


def quantize_distance(metres: Column) -> Column:
    """Distance in whole millimetres."""
    return half_up(metres * F.lit(float(DISTANCE_SCALE)))


def horizon_m(observer, target, curvature: float = CURVATURE, radius: float = EARTH_RADIUS_M) -> Column:
    """Distance at which two heights (metres) are level with the refracted horizon; infinite on a flat earth."""
    if curvature <= 0:
        return F.lit(math.inf)
    r = radius / curvature

    def one(height) -> Column:
        h = F.greatest(_c(height).cast("double"), F.lit(0.0))
        return F.sqrt(F.lit(2.0 * r) * h + h * h)

    return one(observer) + one(target)


def curvature_drop(height: Column, distance_m: Column, curvature: float = CURVATURE, radius: float = EARTH_RADIUS_M) -> Column:
    """Height seen after the curvature of the earth."""
    return height - F.lit(curvature) * distance_m * distance_m / F.lit(2 * radius)


def beyond_horizon(centre_distance_m: Column, cell_radius_m: Column, horizon: Column) -> Column:
    """Whether every point of a cell is farther than the horizon."""
    return F.greatest(centre_distance_m - cell_radius_m, F.lit(0.0)) > horizon


def disk_rings(max_km: Column, edge_km: float) -> Column:
    """Rings of cells that surely cover a radius."""
    return (F.ceil(max_km / F.lit(edge_km)) + 2).cast("int")


def sample_count(fraction: Column, most: int, least: int = 1) -> Column:
    """Observers of a cell by its active fraction, rounded half up and clamped."""
    return F.least(F.greatest(half_up(fraction * F.lit(float(most))), F.lit(least)), F.lit(most)).cast("int")


def cell_type(land: Column, water: Column, land_least: float = 0.5, water_least: float = 0.5) -> Column:
    """``land``, ``water``, ``mixed`` or ``excluded`` by area fractions."""
    is_land, is_water = land >= land_least, water >= water_least
    return F.when(is_land & is_water, "mixed").when(is_land, "land").when(is_water, "water").otherwise("excluded")


def static_weight(terrain: Column, vegetation: Column) -> Column:
    """Terrain times vegetation; distance is already inside terrain."""
    return clip(terrain * vegetation)


def conditional_canopy(bare: Column, canopy: Column) -> Column:
    """Share of bare support that canopy leaves; the neutral 1 without bare support."""
    return F.when(bare > 0, F.least(canopy, bare) / bare).otherwise(F.when(bare.isNotNull(), F.lit(1.0)))


def weight_state(weight: Column, available: Column) -> Column:
    """``source_unavailable``, ``positive`` or ``derived_zero``."""
    return F.when(~available | weight.isNull(), "source_unavailable").when(weight > 0, "positive").otherwise("derived_zero")


def vegetation_state(role: Column, terrain: Column, vegetation: Column) -> Column:
    """State of a vegetation factor; water and pairs without baseline support are no observations."""
    return (
        F.when(role == "water", "not_applicable")
        .when(vegetation.isNull() | terrain.isNull(), "source_unavailable")
        .when(terrain == 0, "no_baseline_support_neutral")
        .when(vegetation > 0, "positive")
        .otherwise("derived_zero")
    )


def obstruction_band(height: Column, breaks=HEIGHT_BREAKS_M, values=BAND_OBSTRUCTION) -> Column:
    """Obstruction of a canopy height by bands."""
    out = F.lit(values[0])
    for b, v in zip(breaks, values[1:], strict=True):
        out = F.when(height >= b, F.lit(v)).otherwise(out)
    return F.when(height.isNotNull(), out)


def surface_obstruction(band: Column, multiplier: Column, floor: Column, nodata: float = NODATA) -> Column:
    """Obstruction of a surface: band times multiplier, at least the class floor; nodata stays."""
    return F.when(band == nodata, F.lit(nodata)).otherwise(clip(F.greatest(band * multiplier, floor)))


def class_obstruction(height: Column, landcover: Column) -> tuple[Column, Column]:
    """Obstruction coefficient of a pixel, and whether it is missing (unknown class, or water under canopy)."""
    known = landcover.isin(*CLASS_WEIGHTS)
    pick = lambda k: F.coalesce(*[F.when(landcover == c, F.lit(w[k])) for c, w in CLASS_WEIGHTS.items()], F.lit(0.0))
    score = F.greatest(obstruction_band(height) * pick(0), pick(1))
    missing = ~known | ((landcover == 80) & (height > 0))
    return F.when(known, score).otherwise(F.lit(0.0)), F.coalesce(missing, F.lit(True))


def transmission(obstruction: Column, nodata: float = NODATA) -> Column:
    """Share that an obstruction lets through."""
    return F.when(obstruction == nodata, F.lit(nodata)).otherwise(clip(F.lit(1.0) - obstruction))


def length_transmission(depth: Column, beta: float = BETA_PER_M) -> Column:
    """Transmission of a weighted path length through canopy."""
    return F.exp(F.lit(-beta) * depth)


def below_length(start: Column, end: Column, eye: Column, slope: Column, curve: Column, top: Column) -> Column:
    """Length of [start, end] on which ``eye + slope d + curve d**2`` is below ``top``."""
    zero = F.lit(0.0)
    cross = F.try_divide(top - eye, slope)
    straight = (
        F.when(slope == 0, F.when(eye < top, end - start).otherwise(zero))
        .when(slope > 0, F.greatest(zero, F.least(end, cross) - start))
        .otherwise(F.greatest(zero, end - F.greatest(start, cross)))
    )
    inner = slope * slope - F.lit(4.0) * curve * (eye - top)
    root = F.sqrt(F.greatest(inner, zero))
    low, high = F.try_divide(-slope - root, F.lit(2.0) * curve), F.try_divide(-slope + root, F.lit(2.0) * curve)
    bent = F.when(inner <= 0, zero).otherwise(F.greatest(zero, F.least(end, high) - F.greatest(start, low)))
    return F.when(curve == 0, straight).otherwise(bent)


def comparison_mean(clear: Column, blocked: Column, unknown: Column) -> Column:
    """Counts to a struct of total, known, bounds and means; empty populations give nulls."""
    total, known = clear + blocked + unknown, clear + blocked
    return F.struct(
        total.alias("total"), known.alias("known"), ratio(clear, total).alias("lower"), ratio(clear + unknown, total).alias("upper"),
        F.when(unknown == 0, ratio(clear, total)).alias("complete"), ratio(clear, known).alias("known_only"),
    )


def partial_kernel(known: Column, unknown: Column, observers: Column, pixels: Column, bare: Column) -> Column:
    """Bounds of a partly known kernel, capped at the bare kernel, with states."""
    whole = observers * pixels
    lower, upper = F.least(ratio(known, whole), bare), F.least(ratio(known + unknown, whole), bare)
    combined = F.when(lower == upper, lower)
    computed = F.when(combined.isNull(), "partial_unknown_paths").otherwise("computed_canopy_model")
    return F.struct(
        lower.alias("combined_lower"), upper.alias("combined_upper"), combined.alias("weight_combined"),
        F.when(bare > 0, ratio(combined, bare)).alias("weight_vegetation"),
        F.when(bare == 0, "no_baseline_support_neutral").otherwise(computed).alias("vegetation_status"),
        F.when(bare == 0, "zero_baseline_support").otherwise(computed).alias("combined_status"),
    )


def envelope_state(floor: Column, ceiling: Column) -> Column:
    """State between a floor and a ceiling run: range first, then surely blocked, surely clear, unknown."""
    return F.when(floor == -2, -2).when(floor == 0, 0).when(ceiling == 1, 1).otherwise(-1)


def raster_cell(x: Column, y: Column, x0: float, y0: float, pixel: float) -> tuple[Column, Column]:
    """Row and column of a point on a north-up raster."""
    return F.floor((F.lit(y0) - y) / F.lit(pixel)).cast("long"), F.floor((x - F.lit(x0)) / F.lit(pixel)).cast("long")


def selected_path_weight(policy: str, mean: Column, decayed: Column) -> Column:
    """Path weight by policy: ``mean`` or ``length_decay``."""
    if policy not in ("mean", "length_decay"):
        raise ValueError(f"unknown policy {policy!r}")
    return mean if policy == "mean" else decayed


def source_vegetation_weight(access: Column, through: Column, missing: str = "neutral") -> Column:
    """Final vegetation weight of a source; missing values are neutral (1) or zero."""
    return F.coalesce(clip(access * through), F.lit(1.0 if missing == "neutral" else 0.0))
