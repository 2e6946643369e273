"""Cell grids and pair lookups.

:class:`SquareGrid` works in column expressions: cells are squares of a fixed edge in degrees, ids
are strings, disks are exploded sequences.  :class:`HexGrid` does the same with hexagons of equal area.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import HAVERSINE_RADIUS_KM, haversine_km

#: Slack of the distance between cells.
SLACK_KM = 1e-9


@dataclass(frozen=True)
class SquareGrid:
    """Square cells of ``edge`` degrees."""

    edge: float = 1.0

    def cell(self, lat: Column, lon: Column) -> Column:
        return F.concat_ws("_", F.floor(lat / F.lit(self.edge)).cast("string"), F.floor(lon / F.lit(self.edge)).cast("string"))

    def _part(self, cell: Column, i: int) -> Column:
        return F.split(cell, "_")[i].cast("long")

    def center(self, cell: Column) -> tuple[Column, Column]:
        return tuple((self._part(cell, i) + F.lit(0.5)) * F.lit(self.edge) for i in (0, 1))

    def parent(self, cell: Column, factor: int) -> Column:
        """Cell of a grid ``factor`` times as coarse."""
        return F.concat_ws("_", *[F.floor(self._part(cell, i) / F.lit(factor)).cast("string") for i in (0, 1)])

    def disk(self, cell: Column, rings: int) -> Column:
        """Array of all cells within ``rings``."""
        around = lambda i: F.sequence(self._part(cell, i) - rings, self._part(cell, i) + rings)
        return F.flatten(F.transform(around(0), lambda r: F.transform(around(1), lambda c: F.concat_ws("_", r.cast("string"), c.cast("string")))))

    def reach(self, cell: Column, max_km: float) -> Column:
        """Array of all cells (longitudes of -180 to 180) with a point within ``max_km`` of a point of ``cell``.

        Rows follow the latitude, with one more on each side for cells that stand over a pole; columns
        follow the width of a degree at the cell's outermost latitude, across 180 degrees, and are all
        columns where the radius comes near a pole.
        """
        angle = math.degrees(max_km / HAVERSINE_RADIUS_KM) + 1e-7
        r, c = (self._part(cell, i) for i in (0, 1))
        at = lambda degrees: F.floor(degrees / F.lit(self.edge))
        south, west = r * F.lit(self.edge), c * F.lit(self.edge)
        outer = F.greatest(F.abs(south), F.abs(south + F.lit(self.edge)))
        first, last = math.floor(-180 / self.edge), math.floor(180 / self.edge)
        span = F.degrees(F.asin(F.lit(math.sin(math.radians(min(angle, 90.0)))) / F.cos(F.radians(outer)))) + F.lit(1e-7)
        around = [F.sequence(at(west - span + F.lit(turn)), at(west + F.lit(self.edge) + span + F.lit(turn))) for turn in (-360.0, 0.0, 360.0)]
        wrapped = F.array_distinct(F.filter(F.concat(*around), lambda x: x.between(first, last)))
        columns = F.when(outer + F.lit(angle) < F.lit(90.0 - self.edge), wrapped).otherwise(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
        rows = F.sequence(at(south - F.lit(angle)) - 1, at(south + F.lit(self.edge + angle)) + 1)
        return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: F.concat_ws("_", i.cast("string"), j.cast("string")))))

    def gap_km(self, one: Column, other: Column) -> Column:
        """Distance between the nearest points of two cells, 0 where they touch.

        The nearest points lie on the meridians that face each other, one of them at the end of its side.
        """
        edge = F.lit(self.edge)
        span = lambda cell: tuple(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (self._part(cell, 0) + k) * edge)) for k in (0, 1))
        turn = F.pmod((self._part(other, 1) - self._part(one, 1)) * edge, F.lit(360.0))
        along = F.greatest(F.least(turn, F.lit(360.0) - turn) - edge, F.lit(0.0))
        found = []
        for ends, (low, high) in ((span(one), span(other)), (span(other), span(one))):
            for end in ends:
                foot = F.degrees(F.atan2(F.sin(F.radians(end)), F.cos(F.radians(end)) * F.cos(F.radians(along))))
                found += [haversine_km(end, F.lit(0.0), near, along) for near in (low, F.greatest(low, F.least(high, foot)))]
                found.append(haversine_km(end, F.lit(0.0), high, along))
        return F.least(*found)

    def boundary(self, cell: Column) -> Column:
        """Corner coordinates (lat, lon) of a cell, as an array of structs."""
        r, c = (self._part(cell, i) for i in (0, 1))
        corner = lambda a, b: F.struct(((r + a) * F.lit(self.edge)).alias("lat"), ((c + b) * F.lit(self.edge)).alias("lon"))
        return F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))


@dataclass(frozen=True)
class HexGrid:
    """Hexagonal cells with corners to the north and sides of ``edge`` kilometres on an equal-area plane.

    The plane is the cylinder's (kilometres along the equator; earth radius times the sine of the
    latitude), so all cells have one area; they do not wrap at 180 degrees.  Ids are ``q_r`` in
    axial coordinates.
    """

    edge: float = 10.0

    def plane(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        radius = F.lit(HAVERSINE_RADIUS_KM)
        return radius * F.radians(lon), radius * F.sin(F.radians(lat))

    def axial(self, cell: Column) -> tuple[Column, Column]:
        parts = F.split(cell, "_")
        return parts[0].cast("long"), parts[1].cast("long")

    def name(self, q: Column, r: Column) -> Column:
        return F.concat_ws("_", q.cast("string"), r.cast("string"))

    def cell(self, lat: Column, lon: Column) -> Column:
        """The cell of a point, by rounding its three cube coordinates."""
        x, y = self.plane(lat, lon)
        size = F.lit(self.edge)
        q, r = (F.lit(math.sqrt(3) / 3) * x - y / 3) / size, F.lit(2 / 3) * y / size
        s = -q - r
        up = lambda v: F.floor(v + F.lit(0.5))
        dq, dr, ds = (F.abs(up(v) - v) for v in (q, r, s))
        fixed_q = F.when((dq > dr) & (dq > ds), -up(r) - up(s)).otherwise(up(q))
        fixed_r = F.when((dq > dr) & (dq > ds), up(r)).when(dr > ds, -up(q) - up(s)).otherwise(up(r))
        return self.name(fixed_q.cast("long"), fixed_r.cast("long"))

    def _plane_center(self, cell: Column) -> tuple[Column, Column]:
        q, r = self.axial(cell)
        return F.lit(self.edge * math.sqrt(3)) * (q + r / F.lit(2.0)), F.lit(self.edge * 1.5) * r

    def _degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        high = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / F.lit(HAVERSINE_RADIUS_KM)))
        return F.degrees(F.asin(high)), F.degrees(x / F.lit(HAVERSINE_RADIUS_KM))

    def center(self, cell: Column) -> tuple[Column, Column]:
        return self._degrees(*self._plane_center(cell))

    def boundary(self, cell: Column) -> Column:
        """The six corners (lat, lon), as an array of structs."""
        x, y = self._plane_center(cell)
        corners = []
        for k in range(6):
            angle = math.radians(60 * k + 30)
            lat, lon = self._degrees(x + F.lit(self.edge * math.cos(angle)), y + F.lit(self.edge * math.sin(angle)))
            corners.append(F.struct(lat.alias("lat"), lon.alias("lon")))
        return F.array(*corners)

    def disk(self, cell: Column, rings: int) -> Column:
        """Array of all cells within ``rings`` steps."""
        q, r = self.axial(cell)
        steps = F.sequence(F.lit(-rings), F.lit(rings))
        rows = lambda dq: F.sequence(F.greatest(F.lit(-rings), -dq - rings), F.least(F.lit(rings), -dq + rings))
        return F.flatten(F.transform(steps, lambda dq: F.transform(rows(dq), lambda dr: self.name(q + dq, r + dr))))

    def distance(self, one: Column, other: Column) -> Column:
        """Steps between two cells."""
        (a, b), (c, d) = self.axial(one), self.axial(other)
        return F.greatest(F.abs(a - c), F.abs(b - d), F.abs(a + b - c - d))

    def parent(self, cell: Column, factor: int) -> Column:
        """Cell, of a grid with sides ``factor`` times as long, that holds the centre."""
        return HexGrid(self.edge * factor).cell(*self.center(cell))


def pair_lookup(sources: DataFrame, targets: DataFrame, grid: SquareGrid, rings: int | None, max_km: float, *, self_pairs: bool = False, by_cells: bool = False) -> DataFrame:
    """Pairs of sources and targets (``cell`` ids) within ``max_km`` of each other, through disks.

    Each source's disk is exploded and met with the targets by equality, so no pair outside the
    disks is ever formed; then the centre distance decides.  Without ``rings`` the disk is all that
    ``max_km`` can reach; a number of rings leaves out pairs beyond them, whatever their distance.  With ``by_cells`` a pair also stays
    where its centres are farther apart but the cells themselves come within ``max_km`` (and ``SLACK_KM``).
    """
    disk = grid.reach(F.col("cell"), max_km + SLACK_KM) if rings is None else grid.disk(F.col("cell"), rings)
    near = sources.select(F.col("cell").alias("source_h3"), F.explode(disk).alias("target_h3"))
    near = near.join(targets.select(F.col("cell").alias("target_h3")), "target_h3", "left_semi")
    (a, b), (c, d) = grid.center(F.col("source_h3")), grid.center(F.col("target_h3"))
    near = near.withColumn("distance_km", haversine_km(a, b, c, d))
    within = F.col("distance_km") <= max_km
    if by_cells:
        within = within | (grid.gap_km(F.col("source_h3"), F.col("target_h3")) <= max_km + SLACK_KM)
    near = near.where(within)
    if not self_pairs:
        near = near.where("source_h3 <> target_h3")
    return near.select("source_h3", "target_h3", "distance_km")


def attach_centroids(pairs: DataFrame, centroids: DataFrame, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Source and target coordinates (``cell, lat, lon``) joined to pairs; small dimensions are broadcast after counting them."""
    if centroids.count() <= max_broadcast_rows:
        centroids = F.broadcast(centroids)
    for side in ("source", "target"):
        renamed = centroids.select(F.col("cell").alias(f"{side}_h3"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
        pairs = pairs.join(renamed, f"{side}_h3", "left")
    return pairs


def segment_buckets(segments: DataFrame, size: float) -> DataFrame:
    """Segments (``x0, y0, x1, y1``) with every bucket of a square grid that their box touches."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / F.lit(size)), F.floor(F.greatest(a, b) / F.lit(size)))
    return segments.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))


def blocked_lines(lines: DataFrame, barriers: DataFrame, size: float) -> DataFrame:
    """Ids of ``lines`` (``line, x0..y1``) that cross or touch a barrier segment, by a bucketed segment join.

    A line is tried in each of its buckets up to the first barrier that it meets there (a semi-join),
    so crowded buckets make no pairs. Barriers are never broadcast: their buckets outgrow the estimate of their table.
    """
    a = segment_buckets(lines, size)
    b = segment_buckets(barriers, size).withColumnsRenamed({c: f"b_{c}" for c in ("x0", "y0", "x1", "y1")})
    b = b.withColumnsRenamed({"bx": "b_bx", "by": "b_by"})
    side = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    one = side("x0", "y0", "x1", "y1", "b_x0", "b_y0") * side("x0", "y0", "x1", "y1", "b_x1", "b_y1")
    two = side("b_x0", "b_y0", "b_x1", "b_y1", "x0", "y0") * side("b_x0", "b_y0", "b_x1", "b_y1", "x1", "y1")
    apart = F.lit(False)  # collinear segments meet only where their boxes do
    for u, v in (("x0", "x1"), ("y0", "y1")):
        apart = apart | (F.greatest(u, v) < F.least(f"b_{u}", f"b_{v}")) | (F.least(u, v) > F.greatest(f"b_{u}", f"b_{v}"))
    bucket = (F.col("bx") == F.col("b_bx")) & (F.col("by") == F.col("b_by"))
    return a.join(b.hint("merge"), bucket & (one <= 0) & (two <= 0) & ~apart, "left_semi").select("line").distinct()
