"""Line of sight over a raster table.

A ray becomes the table of cells it crosses; the cells meet the raster by an equality
join, and a ray's state is an aggregate of its cells.  States: 1 clear, 0 blocked, -1
unknown, -2 out of range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import scalars as S

_TINY = 1e-9
_CLEARANCE = 1e-7
#: Cells in a batch that a walk hands on; a longer ray is a batch of its own.
_BATCH_CELLS = 100_000
#: Rays that one unknown cell decides are walked in stages, to these numbers of pixels.
_STAGES = (64, 1024)


def cells_on_ray(ox: float, oy: float, tx: float, ty: float, x0: float, y0: float, pixel: float, first: float = 0.0, last: float = np.inf) -> tuple[np.ndarray, ...]:
    """Rows, columns and entry and exit distances of the cells that a ray crosses over more than a point.

    All crossings with grid lines are sorted; a cell lies between two consecutive ones.  A
    crossing of both kinds at once (a corner) leads straight to the diagonal cell.  Of a window
    of distances, those cells come that are entered in it (from ``first``, before ``last``).
    """
    distance = float(np.hypot(tx - ox, ty - oy))
    if distance == 0:
        return tuple(np.zeros(0) for _ in range(4))
    near, far = (max(0.0, first - 3 * pixel) / distance, min(distance, last + 3 * pixel) / distance)  # a cell is at most 1.5 pixels long
    cuts = [np.array([end for end, share in ((0.0, 0.0), (distance, 1.0)) if near <= share <= far])]
    for a, b in (((ox - x0) / pixel, (tx - x0) / pixel), ((y0 - oy) / pixel, (y0 - ty) / pixel)):
        low, high = min(a, b), max(a, b)
        if near > 0 or far < 1:
            low, high = max(low, min(a + (b - a) * near, a + (b - a) * far)), min(high, max(a + (b - a) * near, a + (b - a) * far))
        lines = np.arange(np.ceil(low), np.floor(high) + 1)
        if a != b:
            cuts.append((lines - a) / (b - a) * distance)
    at = np.unique(np.clip(np.concatenate(cuts), 0, distance))
    enter, leave = at[:-1], at[1:]
    real = (leave - enter > _TINY) & (enter >= first) & (enter < last)
    enter, leave = enter[real], leave[real]
    middle = (enter + leave) / 2 / distance
    cols = np.floor((ox + (tx - ox) * middle - x0) / pixel)
    rows = np.floor((y0 - oy - (ty - oy) * middle) / pixel)
    return rows.astype(np.int64), cols.astype(np.int64), enter, leave


def crossings(rays: DataFrame, x0: float, y0: float, pixel: float, *, carry: tuple[str, ...] = (), first: float = 0.0, last: float = float("inf"), where: str | None = None) -> DataFrame:
    """``ray, row, col, enter, leave`` of the cells each ray (``ray, ox, oy, tx, ty``) crosses, with the columns ``carry`` of the ray.

    ``first`` and ``last`` bound the entry.  With ``where`` (a boolean column) only those rays are
    walked, and every ray has one more row: its source cell, without entry and exit.
    """
    kept = ("ox", "oy", "tx", "ty", *carry) if where else carry
    fields = {f.name: f.dataType.simpleString() for f in rays.schema}

    def cross(batches):
        for batch in batches:
            sides = [batch.column(i).to_numpy() for i in range(1, 5)]
            walked = batch.column(5).to_pylist() if where else None
            at, who, found, many = [batch.column(0), *[batch.column(i) for i in range(batch.num_columns - len(kept), batch.num_columns)]], [], [], 0
            for i in range(batch.num_rows):
                cells = cells_on_ray(*(s[i] for s in sides), x0, y0, pixel, first, last) if walked is None or walked[i] else tuple(np.zeros(0) for _ in range(4))
                if where:
                    own = (np.floor((y0 - sides[1][i]) / pixel), np.floor((sides[0][i] - x0) / pixel), np.nan, np.nan)
                    cells = tuple(np.append(c, v) for c, v in zip(cells, own, strict=True))
                who.append(np.full(len(cells[0]), i))
                found.append(cells)
                many += len(cells[0])
                if many >= _BATCH_CELLS or i == batch.num_rows - 1:
                    rows = pa.array(np.concatenate(who).astype(np.int64))
                    columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                    new = [pa.array(c.astype(k.to_pandas_dtype()), k, from_pandas=True) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in at], *new], names)
                    who, found, many = [], [], 0

    names = ["ray", *kept, "row", "col", "enter", "leave"]
    types = [*[f"{c} {'double' if c in ('ox', 'oy', 'tx', 'ty') else fields[c]}" for c in ("ray", *kept)], "row long", "col long", "enter double", "leave double"]
    sides = [F.col(c).cast("double").alias(c) for c in ("ox", "oy", "tx", "ty")]
    given = [F.col("ray"), *sides, *([F.col(where)] if where else []), *[s.alias(f"{c}_") for c, s in zip(("ox", "oy", "tx", "ty"), sides, strict=True) if where], *[F.col(c) for c in carry]]
    return rays.select(*given).mapInArrow(cross, ", ".join(types))


def _placed(rays: DataFrame, raster: DataFrame, x0: float, y0: float, pixel: float, target_height: float, curve: float) -> DataFrame:
    """Rays with distance, target cell and slope of the line of sight."""
    sr, sc = S.raster_cell(F.col("ox"), F.col("oy"), x0, y0, pixel)
    tr, tc = S.raster_cell(F.col("tx"), F.col("ty"), x0, y0, pixel)
    d = F.sqrt(F.pow(F.col("tx") - F.col("ox"), F.lit(2)) + F.pow(F.col("ty") - F.col("oy"), F.lit(2)))
    placed = rays.withColumns({"s_row": sr, "s_col": sc, "t_row": tr, "t_col": tc, "distance": d})
    ends = raster.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.col("ground").alias("t_ground"), F.col("unknown").alias("t_unknown"))
    placed = placed.join(ends, ["t_row", "t_col"], "left")
    ground = F.coalesce("t_ground", F.raise_error(F.lit("target terrain missing")).cast("double"))
    slope = F.try_divide(ground + F.lit(target_height) - F.col("eye") - F.lit(curve) * d * d, d)
    return placed.withColumn("slope", slope)


def direct_visibility(rays: DataFrame, raster: DataFrame, *, x0: float, y0: float, pixel: float, target_height: float = 0.0, curve: float = 0.0, radius: float = float("inf")) -> DataFrame:
    """``ray, state`` of rays (``ray, ox, oy, tx, ty, eye``) over ``row, col, ground, lower, unknown``.

    The source cell never blocks and the target's own height does not; known obstruction wins
    over unknown cells; rays longer than ``radius`` are out of range.
    """
    placed = _placed(rays, raster, x0, y0, pixel, target_height, curve)
    inside = placed.where((F.col("distance") <= radius) & (F.col("distance") > 0))
    cells = crossings(inside, x0, y0, pixel).join(inside.select("ray", "eye", "slope", "s_row", "s_col", "t_row", "t_col"), "ray")
    cells = cells.where(~((F.col("row") == F.col("s_row")) & (F.col("col") == F.col("s_col"))))
    cells = cells.join(raster.select("row", "col", "ground", "lower", "unknown"), ["row", "col"], "left")
    k = F.lit(curve)
    lowest = F.least(F.col("leave"), F.greatest(F.col("enter"), F.try_divide(-F.col("slope"), 2 * k))) if curve > 0 else F.when(F.col("slope") >= 0, F.col("enter")).otherwise(F.col("leave"))
    ground = F.coalesce("ground", F.raise_error(F.lit("ray terrain missing")).cast("double"))
    above = ground + F.col("lower") - F.col("eye") - F.col("slope") * lowest - k * lowest * lowest
    is_target = (F.col("row") == F.col("t_row")) & (F.col("col") == F.col("t_col"))
    seen = cells.groupBy("ray").agg(F.bool_or(~is_target & (above > _CLEARANCE)).alias("blocked"), F.bool_or("unknown").alias("uncertain"))
    uncertain = F.coalesce("uncertain", F.lit(False)) | F.coalesce("t_unknown", F.lit(False))
    state = F.when(F.col("distance") > radius, -2).when(F.coalesce("blocked", F.lit(False)), 0).when(uncertain, -1).otherwise(1)
    return placed.join(seen, "ray", "left").select("ray", state.cast("int").alias("state"))


def envelope_visibility(rays: DataFrame, raster: DataFrame, **geometry) -> DataFrame:
    """``ray, state`` between a floor and a ceiling of obstacle heights (raster columns ``floor, ceiling``)."""
    low = direct_visibility(rays, raster.withColumn("lower", F.col("floor")), **geometry).withColumnRenamed("state", "low")
    high = direct_visibility(rays, raster.withColumn("lower", F.col("ceiling")), **geometry).withColumnRenamed("state", "high")
    return low.join(high, "ray").select("ray", S.envelope_state(F.col("low"), F.col("high")).cast("int").alias("state"))


def canopy_depth(rays: DataFrame, raster: DataFrame, *, x0: float, y0: float, pixel: float, target_height: float = 0.0, curve: float = 0.0) -> DataFrame:
    """``ray, depth`` - canopy metres weighted by class along clear rays, -1 where height or class is missing.

    Raster: ``row, col, ground, unknown, canopy, coefficient, missing_class``; rays carry ``eye``.
    Rays with the same ends and eye are walked once, and none beyond the stage in which it is found missing.
    """
    sides = ["ox", "oy", "tx", "ty", "eye"]
    rays = rays.select("ray", *[F.col(c).cast("double").alias(c) for c in sides])
    state = _placed(rays.groupBy(*sides).agg(F.min("ray").alias("ray")), raster, x0, y0, pixel, target_height, curve)
    slope = F.when(F.col("distance") > 0, F.col("slope"))
    state = state.select("ray", *sides, slope.alias("slope"), "distance", F.lit(0.0).alias("depth"), F.coalesce((F.col("distance") > 0) & F.col("t_unknown"), F.lit(False)).alias("missing"))
    carried = ["eye", "slope", "distance", "depth", "missing"]
    for first, last in zip((0, *_STAGES), (*_STAGES, float("inf")), strict=True):
        state = state.withColumn("walk", ~F.col("missing") & (F.col("distance") > first * pixel))
        cells = crossings(state, x0, y0, pixel, carry=tuple(carried), first=first * pixel, last=last * pixel, where="walk")
        (sr, sc), (tr, tc) = (S.raster_cell(F.col(x), F.col(y), x0, y0, pixel) for x, y in (("ox", "oy"), ("tx", "ty")))
        own = F.col("enter").isNull()
        ends = ((F.col("row") == sr) & (F.col("col") == sc)) | ((F.col("row") == tr) & (F.col("col") == tc))
        cells = cells.where(own | ~ends).join(raster.select("row", "col", "ground", "unknown", "canopy", "coefficient", "missing_class"), ["row", "col"], "left")
        length = S.below_length(F.col("enter"), F.col("leave"), F.col("eye"), F.col("slope"), F.lit(curve), F.col("ground") + F.col("canopy"))
        touched = ~F.col("unknown") & (F.col("canopy") > 0) & (length > 0)
        more = F.when(~own & touched & ~F.col("missing_class"), F.col("coefficient") * length).otherwise(0.0)
        wrong = F.coalesce(~own & (F.col("unknown") | (touched & F.col("missing_class"))), F.lit(False))
        found = cells.groupBy("ray", "ox", "oy", "tx", "ty", *[F.col(c).alias(f"{c}_") for c in carried]).agg(F.sum(more).alias("more"), F.bool_or(wrong).alias("wrong"))
        state = found.select(
            "ray", "ox", "oy", "tx", "ty", *[F.col(f"{c}_").alias(c) for c in carried[:3]], (F.col("depth_") + F.col("more")).alias("depth"), (F.col("missing_") | F.col("wrong")).alias("missing"))
    state = state.select(*[F.col(c).alias(f"{c}_") for c in sides], F.when(F.col("missing"), F.lit(-1.0)).otherwise(F.col("depth")).alias("depth"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in sides]
    return rays.join(state, same).select("ray", "depth")


def classified_support(depths: DataFrame, beta: float = S.BETA_PER_M) -> DataFrame:
    """Transmission of clear rays from their canopy depth; -1 stays."""
    return depths.select("ray", F.when(F.col("depth") < 0, F.lit(-1.0)).otherwise(S.length_transmission(F.col("depth"), beta)).alias("value"))


def horizon_visibility(ground: np.ndarray, canopy: np.ndarray, unknown: np.ndarray, row: int, col: int, eye: float, pixel: float, curve: float, radius: float, target: float) -> np.ndarray:
    """States of all pixels seen from one by carrying the horizon outward, ring by ring.

    A pixel is hidden where it lies below its parents' interpolated horizon, unknown where
    a parent is; out of range is 0 here, and an unknown observer makes all in range unknown.
    """
    rows, cols = np.indices(ground.shape)
    far = ((rows - row) ** 2 + (cols - col) ** 2) * pixel**2
    if unknown[row, col]:
        return np.where(far > radius**2, 0, -1).astype(np.int8)
    out = np.full(ground.shape, -1, np.int8)
    for down in (-1, 1):
        for right in (-1, 1):
            ys, xs = np.arange(row, -1 if down < 0 else ground.shape[0], down), np.arange(col, -1 if right < 0 else ground.shape[1], right)
            at = np.ix_(ys, xs)
            z = ground[at] - eye - curve * far[at]
            top, blind = z + canopy[at], unknown[at].copy()
            seen, height, width = np.full(z.shape, -np.inf), *z.shape
            carried = np.zeros(z.shape, bool)
            for r in range(2, max(height, width)):
                if r < width:  # the column r: rows up to r
                    j = np.arange(0, min(r, height - 1) + 1)
                    up = np.maximum(j - 1, 0)
                    seen[j, r] = (top[up, r - 1] * j + np.where(j < r, top[np.minimum(j, r - 1), r - 1], 0) * (r - j)) / (r - 1)
                    carried[j, r] = np.where(j > 0, blind[up, r - 1], False) | np.where(j < r, blind[np.minimum(j, r - 1), r - 1], False)
                if r < height:
                    i = np.arange(0, min(r, width - 1) + 1)
                    left = np.maximum(i - 1, 0)
                    seen[r, i] = (top[r - 1, left] * i + np.where(i < r, top[r - 1, np.minimum(i, r - 1)], 0) * (r - i)) / (r - 1)
                    carried[r, i] = np.where(i > 0, blind[r - 1, left], False) | np.where(i < r, blind[r - 1, np.minimum(i, r - 1)], False)
                for ring in ((slice(0, r + 1), slice(r, r + 1)), (slice(r, r + 1), slice(0, r + 1))):
                    top[ring] = np.maximum(top[ring], seen[ring])
                    blind[ring] |= carried[ring]
            state = np.where(z + target < seen, 0, np.where(carried, -1, 1))
            out[at] = np.where(far[at] > radius**2, 0, np.where(unknown[at], -1, state))
    return out


def partial_canopy(pixels: DataFrame, observers: DataFrame, *, pixel: float, curve: float, radius: float, target: float = 0.0) -> DataFrame:
    """``source_h3, row, col, state`` by :func:`horizon_visibility` for every source.

    ``pixels``: ``source_h3, row, col, ground, canopy, unknown``; ``observers``: ``source_h3, o_row, o_col, eye``.
    A horizon comes from nearer pixels only, so just those in range are gathered, at most a square of
    twice the radius for a source; the others are 0 without it.
    """
    schema = "source_h3 string, row long, col long, state int"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        (r0, r1), (c0, c1) = ((min(int(pdf[n].min()), int(one[f"o_{n}"])), max(int(pdf[n].max()), int(one[f"o_{n}"]))) for n in ("row", "col"))
        shape = (r1 - r0 + 1, c1 - c0 + 1)
        grids = {"ground": np.zeros(shape), "canopy": np.zeros(shape), "unknown": np.ones(shape, bool)}
        at = (pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0)
        for name, grid in grids.items():
            grid[at] = pdf[name].to_numpy()
        grids["canopy"][grids["unknown"]] = 0
        state = horizon_visibility(**grids, row=int(one["o_row"]) - r0, col=int(one["o_col"]) - c0, eye=float(one["eye"]), pixel=pixel, curve=curve, radius=radius, target=target)
        return pd.DataFrame({"source_h3": pdf["source_h3"], "row": pdf["row"], "col": pdf["col"], "state": state[at].astype(np.int32)})

    placed = pixels.join(observers, "source_h3")
    far = (F.pow(F.col("row") - F.col("o_row"), F.lit(2)) + F.pow(F.col("col") - F.col("o_col"), F.lit(2))) * F.lit(pixel**2) > F.lit(radius**2)
    near = placed.where(~far).groupBy("source_h3").applyInPandas(solve, schema)
    return near.union(placed.where(far).select("source_h3", "row", "col", F.lit(0).alias("state")))


def ray_scores(cells: DataFrame, keys: list[str], obstruction: str, length: str, *, skip: Column | None = None, beta: float = S.BETA_PER_M) -> DataFrame:
    """Per ray: mean, 10th percentile and least transmission, length decay, and obstruction statistics over its crossed cells."""
    used = cells if skip is None else cells.where(~skip)
    o, t = F.col(obstruction), F.lit(1.0) - F.col(obstruction)
    return used.groupBy(*keys).agg(
        F.avg(t).alias("mean_transmission"), F.percentile(t, F.lit(0.1)).alias("p10_transmission"), F.min(t).alias("least_transmission"), F.avg(o).alias("mean_obstruction"), F.max(o).alias("max_obstruction"),
        S.length_transmission(F.sum(o * F.col(length)), beta).alias("length_decay"), F.sum(length).alias("path_length"), F.count("*").alias("cells"),
    )
