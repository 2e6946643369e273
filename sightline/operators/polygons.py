"""Polygon overlay in column expressions.

A ring is an array of structs (``x, y``), open (the last corner joins the first).  A ring is
clipped by one half plane after the other, so any simple ring can be met with a convex cell;
areas are signed by the direction of the ring, and a hole is a ring of the other direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.sampling import stable_seed

_ALL = 2_000_000_000


def _edges(ring: Column) -> Column:
    """Array of (a, b): every corner with the next one."""
    after = F.concat(F.slice(ring, 2, _ALL), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), after.alias("b"))


def ring_area(ring: Column) -> Column:
    """Signed area: positive where the corners go against the clock."""
    twice = F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(twice, F.lit(0.0), lambda s, v: s + v) / F.lit(2.0)


def _half_plane(ring: Column, a: Column, b: Column, c: Column) -> Column:
    """The part of a ring where ``a x + b y <= c``."""
    side = lambda p: a * p["x"] + b * p["y"] - c

    def kept(e: Column) -> Column:
        p, q = e["a"], e["b"]
        sp, sq = side(p), side(q)
        t = F.try_divide(sp, sp - sq)
        cross = F.array(F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")))
        own = F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))
        none = F.slice(own, 1, 0)
        return F.concat(F.when(sp <= 0, own).otherwise(none), F.when(sp * sq < 0, cross).otherwise(none))

    return F.flatten(F.transform(_edges(ring), kept))


def clip(rings: DataFrame, *, x: tuple[Column, Column] | None = None, y: tuple[Column, Column] | None = None) -> DataFrame:
    """``rings`` with ``ring`` cut to a range of x, of y, or to a box.

    One step for each side: a ring is named several times in a step, and steps inside one another
    would multiply the expression.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    for limits, a, b in ((x, one, zero), (y, zero, one)):
        if limits is not None:
            for sign, limit in ((-one, limits[0]), (one, limits[1])):
                rings = rings.withColumn("ring", _half_plane(F.col("ring"), sign * a, sign * b, sign * limit))
    return rings


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by the parity of crossings."""

    def crosses(e: Column) -> Column:
        p, q = e["a"], e["b"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < F.coalesce(F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]), F.lit(0.0)) + p["x"])

    return F.pmod(F.size(F.filter(_edges(ring), crosses)), F.lit(2)) == 1


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Box of a ring: least x and y, largest x and y."""
    axis = lambda k: F.transform(ring, lambda p: p[k])
    return F.array_min(axis("x")), F.array_min(axis("y")), F.array_max(axis("x")), F.array_max(axis("y"))


def overlay(polygons: DataFrame, edge: float) -> DataFrame:
    """``polygon, row, col, area`` of the parts that polygons (``polygon, ring``) have in the square cells of ``edge``.

    A ring is cut into columns first and every column into cells, so a long ring is not carried into
    each cell of its box; cells that it does not meet are left out.  Rings of a polygon add up
    (holes subtract).
    """
    step = F.lit(float(edge))
    span = lambda low, high: F.sequence(F.floor(low / step), F.greatest(F.floor(low / step), F.ceil(high / step) - 1))
    x0, _, x1, _ = bounds(F.col("ring"))
    strips = polygons.select("polygon", "ring", F.explode(span(x0, x1)).alias("col"))
    strips = clip(strips, x=(F.col("col") * step, (F.col("col") + 1) * step)).where(F.size("ring") > 2)
    _, y0, _, y1 = bounds(F.col("ring"))
    cells = strips.select("polygon", "ring", "col", F.explode(span(y0, y1)).alias("row"))
    cells = clip(cells, y=(F.col("row") * step, (F.col("row") + 1) * step)).where(F.size("ring") > 2)
    found = cells.select("polygon", "row", "col", ring_area(F.col("ring")).alias("area"))
    return found.groupBy("polygon", "row", "col").agg(F.sum("area").alias("area")).where(F.abs("area") > 0)


def domain_shares(land: DataFrame, edge: float, box: tuple[int, int, int, int]) -> DataFrame:
    """``row, col, land, water`` - shares of every cell of a box (rows and columns, ends exclusive): water is what disjoint land leaves.

    ``land``: ``polygon, ring``.
    """
    r0, c0, r1, c1 = box
    covered = overlay(land, edge).groupBy("row", "col").agg((F.sum("area") / F.lit(edge * edge)).alias("land"))
    cells = land.sparkSession.range(r0, r1).select(F.col("id").alias("row")).select("row", F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1 - 1).cast("long"))).alias("col"))
    joined = cells.join(covered, ["row", "col"], "left").withColumn("land", F.least(F.greatest(F.coalesce("land", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return joined.withColumn("water", F.lit(1.0) - F.col("land"))


def random_points(polygons: DataFrame, n: int, *, seed: int = 42, attempts: int = 1000) -> DataFrame:
    """``polygon, sample_index, x, y``: the first ``n`` of ``attempts`` pseudo-random points of the box that are inside the ring.

    The points follow from the seed, the polygon's id and the attempt alone.  Fewer come out only
    where so many attempts do not find them.
    """
    x0, y0, x1, y1 = bounds(F.col("ring"))
    tried = polygons.select("polygon", "ring", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    unit = lambda axis: stable_seed(seed, F.col("polygon"), F.col("attempt"), F.lit(axis)) / F.lit(float(2**32))
    placed = tried.select("polygon", "ring", "attempt", (F.col("x0") + unit("x") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + unit("y") * (F.col("y1") - F.col("y0"))).alias("y"))
    inside = placed.where(contains(F.col("ring"), F.col("x"), F.col("y")))
    index = F.row_number().over(Window.partitionBy("polygon").orderBy("attempt")) - 1
    return inside.select("polygon", index.alias("sample_index"), "x", "y").where(F.col("sample_index") < n)


def outdoor_cells(points: DataFrame, roofs: DataFrame, edge: float) -> DataFrame:
    """Candidate points (``x, y``) that stand on no roof pixel (``row, col`` of squares of ``edge``): land observers."""
    at = lambda c: F.floor(F.col(c) / F.lit(float(edge))).cast("long")
    return points.withColumns({"row": at("y"), "col": at("x")}).join(roofs.select("row", "col"), ["row", "col"], "left_anti").drop("row", "col")
