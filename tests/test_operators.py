"""Hand-checked cases of functions and operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators import checks, compose, grids, kernels, rays, sampling, summaries
from sightline.operators.checks import IntegrityError
from sightline.plans import stages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_decay_curves_and_cutoff(spark):
    df = spark.createDataFrame([(d,) for d in (0.0, 1.0, 3.0, 5.0, 9.0, 30.0, 31.0, 1e4)], "d double")
    for curve in (S.Decay(), S.Decay("exponential"), S.Decay("piecewise", normalize=False)):
        rows = df.select("d", curve.weight("d").alias("w")).collect()
        assert rows[0]["w"] == pytest.approx(curve.at(0) / (curve.at(0) if curve.normalize else 1))
        assert all(r["w"] == 0 for r in rows if r["d"] > 30)
        weights = [r["w"] for r in rows]
        assert weights == sorted(weights, reverse=True)
    assert df.where("d is null").select(S.Decay().weight("d")).count() == 0


def test_horizon_and_rounding(spark):
    r = one(spark, S.horizon_m(2.5, 1.5).alias("h"), S.horizon_m(0, 0).alias("z"), S.horizon_m(1, 1, curvature=0).alias("flat"), S.sample_count(F.lit(0.25), 10).alias("a"), S.sample_count(F.lit(0.01), 10).alias("b"), S.sample_count(F.lit(1.5), 10).alias("c"))
    assert r["h"] == pytest.approx(10_824.45, abs=0.1)
    assert (r["z"], r["a"], r["b"], r["c"]) == (0, 3, 1, 10)
    assert math.isinf(r["flat"])


def test_clip_keeps_null(spark):
    r = one(spark, S.clip(F.lit(None).cast("double")).alias("n"), S.clip(F.lit(2.0)).alias("c"))
    assert r["n"] is None and r["c"] == 1.0


@pytest.mark.parametrize(
    ("counts", "expected"),
    [((40, 40, 20), (100, 80, 0.4, 0.6, None, 0.5)), ((0, 0, 0), (0, 0, None, None, None, None)), ((0, 0, 10), (10, 0, 0.0, 1.0, None, None)), ((0, 10, 0), (10, 10, 0.0, 0.0, 0.0, 0.0))],
)
def test_comparison_mean(spark, counts, expected):
    got = one(spark, S.comparison_mean(*(F.lit(c) for c in counts)).alias("m"))["m"]
    assert tuple(got) == expected


def test_support_bounds(spark):
    values = [[0.5, -1.0, -2.0, 0.0], [1.0, 0.0, -2.0, 0.0]]
    codes, weights = [0, 0, 1, 1], [1, 3, 1, 1]
    df = spark.createDataFrame([(codes[j], values[i][j], weights[j]) for i in range(2) for j in range(4)], "cell int, value double, weight int")
    got = {r["cell"]: r for r in kernels.support_bounds(df, "cell").collect()}
    assert tuple(got[0])[1:] == (None, 0.1875, 0.5625, 0.375, 0.0)
    assert tuple(got[1])[1:] == (0.0, 0.0, 0.0, 0.0, 0.5)


def test_conditional_weights(spark):
    bare, joint = [[1, 0, 0], [1, 1, -2]], [[0.5, 0.0, 0.0], [1.0, -1.0, -2.0]]
    decay, codes, weights = [[0.8, 0.2, 0.1], [0.4, 0.2, 0.0]], [0, 0, 1], [3, 1, 1]
    df = spark.createDataFrame([(codes[j], bare[i][j], joint[i][j], decay[i][j], weights[j]) for i in range(2) for j in range(3)], "cell int, bare int, joint double, decay double, weight int")
    got = {r["cell"]: r for r in kernels.conditional_weights(df, "cell").collect()}
    assert got[0]["weight_terrain"] == pytest.approx(3.8 / 8) and got[0]["above_ground_lower"] == pytest.approx(2.4 / 3.8)
    assert got[0]["above_ground_upper"] == pytest.approx(2.6 / 3.8) and got[0]["weight_above_ground"] is None and got[0]["above_ground_status"] == "unknown"
    assert tuple(got[1])[1:] == (0.0, None, None, None, "not_applicable")


def test_compose_fails_closed(spark):
    lookup = spark.createDataFrame([("a", "x"), ("b", "x")], "source_h3 string, target_h3 string")
    terrain = lookup.withColumn("weight_terrain", F.when(F.col("source_h3") == "a", 0.6).otherwise(0.0))
    vegetation = lookup.withColumn("weight_vegetation", F.when(F.col("source_h3") == "a", 0.5).otherwise(1.0))
    got = {r["source_h3"]: r["weight_static_viewability"] for r in compose.compose_static(lookup, terrain, vegetation).collect()}
    assert got == {"a": pytest.approx(0.3), "b": 0.0}
    with pytest.raises(IntegrityError):
        compose.compose_static(lookup, terrain.where("source_h3 = 'a'"), vegetation)
    with pytest.raises(IntegrityError):
        compose.compose_static(lookup, terrain.union(terrain), vegetation)
    with pytest.raises(IntegrityError):
        checks.assert_pair_kernel(terrain.withColumn("weight_terrain", F.lit(float("nan"))), ["source_h3"], ["weight_terrain"])


def test_dual_surface(spark):
    lookup = spark.createDataFrame([("s1", "t1", "land"), ("s1", "t2", "land"), ("w", "t1", "water")], "source_h3 string, target_h3 string, source_type string")
    bare = spark.createDataFrame([("s1", "t1", 0.8)], "source_h3 string, target_h3 string, weight_terrain double")
    canopy = bare.withColumn("weight_terrain", F.lit(0.4))
    got = {r["target_h3"]: r for r in compose.dual_surface(lookup, bare, canopy).collect()}
    assert set(got) == {"t1", "t2"}
    assert (got["t1"]["weight_terrain"], got["t1"]["weight_canopy_los"], got["t1"]["weight_vegetation"]) == (0.8, 0.4, 0.5)
    assert (got["t2"]["weight_terrain"], got["t2"]["weight_canopy_los"], got["t2"]["weight_vegetation"]) == (0.0, 0.0, 1.0)


def test_pair_summary(spark):
    rows = [("a", "x", 0.0, 1.0, 0.4, 0.0), ("b", "x", 0.8, 0.25, 0.6, 0.2)]
    df = spark.createDataFrame(rows, "source_h3 string, target_h3 string, weight_terrain double, weight_vegetation double, weight_distance double, weight_static_viewability double")
    r = summaries.pair_summary(df, "target_h3").first()
    assert (r["candidate_pairs"], r["positive_static_fraction"], r["mean_weight_static_viewability"], r["mean_canopy_given_terrain_support"]) == (2, 0.5, 0.1, 0.25)


def test_missing_is_not_zero(spark):
    rows = [("a", "complete", "land", 0.5, 0.5, 1.0, 0.2), ("a", "partial", "land", 0.5, 0.5, 1.0, 0.2), ("b", "partial", "land", 0.5, 0.5, 1.0, None), ("a", "unknown", "land", 0.5, None, None, None)]
    df = spark.createDataFrame(rows, "source_h3 string, target_h3 string, source_type string, weight_distance double, weight_terrain double, weight_vegetation double, net_static_weight double")
    got = {r["target_h3"]: r for r in summaries.map_target_sums(df).collect()}
    name = "target_static_kernel_sum"
    assert [got[t][name] for t in ("complete", "partial", "unknown")] == [0.2, None, None]
    assert got["partial"][f"{name}_available"] == 0.2 and got["partial"][f"{name}_coverage_fraction"] == 0.5
    assert [got[t][f"{name}_status"] for t in ("complete", "partial", "unknown")] == ["complete", "partial", "unavailable"]
    water = summaries.map_target_sums(df.withColumn("source_type", F.lit("water"))).where("target_h3 = 'partial'").first()
    assert water["vegetation_weight_sum_status"] == "not_applicable" and water["vegetation_weight_sum_not_applicable_count"] == 2


# -- rays on 9 x 9 cells of 10 m, flat earth ---------------------------------


def scene(spark, blocks=(), unknown=()):
    cells = [(r, c, 0.0, float(dict(blocks).get((r, c), 0.0)), (r, c) in unknown) for r in range(9) for c in range(9)]
    return spark.createDataFrame(cells, "row long, col long, ground double, lower double, unknown boolean")


def look(spark, raster, target=(85.0, -45.0), **more):
    ray = spark.createDataFrame([(1, 45.0, -45.0, *target, 1.0)], "ray long, ox double, oy double, tx double, ty double, eye double")
    return rays.direct_visibility(ray, raster, x0=0.0, y0=0.0, pixel=10.0, target_height=1.0, **more).first()["state"]


def test_direct_rays(spark):
    assert look(spark, scene(spark, {(3, 5): 50}.items())) == 1
    assert look(spark, scene(spark, {(4, 5): 50}.items())) == 0
    assert look(spark, scene(spark, unknown={(4, 5)})) == -1
    assert look(spark, scene(spark, {(4, 5): 20}.items(), {(4, 5)})) == 0
    assert look(spark, scene(spark), radius=30.0) == -2
    # through the corner: the diagonal cell blocks, its neighbours do not
    assert look(spark, scene(spark, {(4, 5): 50}.items()), target=(85.0, -5.0)) == 1
    assert look(spark, scene(spark, {(3, 5): 50}.items()), target=(85.0, -5.0)) == 0


def test_canopy_depth(spark):
    canopy = scene(spark).withColumns({"canopy": F.when((F.col("row") == 4) & (F.col("col") == 6), 20.0).otherwise(0.0), "coefficient": F.lit(1.0), "missing_class": F.lit(False)})
    ray = spark.createDataFrame([(1, 45.0, -45.0, 85.0, -45.0, 1.0)], "ray long, ox double, oy double, tx double, ty double, eye double")
    value = rays.classified_support(rays.canopy_depth(ray, canopy, x0=0.0, y0=0.0, pixel=10.0, target_height=1.0)).first()["value"]
    assert value == pytest.approx(math.exp(-0.002 * 10))
    blind = canopy.withColumn("missing_class", F.lit(True))
    assert rays.classified_support(rays.canopy_depth(ray, blind, x0=0.0, y0=0.0, pixel=10.0, target_height=1.0)).first()["value"] == -1


def brute_horizon(ground, canopy, unknown, row, col, eye, pixel, radius, target):
    """Pixel by pixel, in order of rings."""
    top, blind, out = {}, {}, np.zeros(ground.shape, int)
    for r, c in sorted(np.ndindex(ground.shape), key=lambda p: max(abs(p[0] - row), abs(p[1] - col))):
        j, i = abs(r - row), abs(c - col)
        sr, sc = (1 if r >= row else -1), (1 if c >= col else -1)
        z, parent, lost = ground[r, c] - eye, -np.inf, False
        n = max(i, j)
        if n > 1:
            at = lambda b, a: (row + sr * b, col + sc * a)
            if j == 0:
                near = [(at(0, i - 1), i)]
            elif i == 0:
                near = [(at(j - 1, 0), j)]
            elif i == j:
                near = [(at(j - 1, i - 1), i)]
            elif i > j:
                near = [(at(j - 1, i - 1), j), (at(j, i - 1), i - j)]
            else:
                near = [(at(j - 1, i - 1), i), (at(j - 1, i), j - i)]
            parent = sum(top[p] * w for p, w in near) / (n - 1)
            lost = any(blind[p] for p, _ in near)
        top[r, c], blind[r, c] = max(z + canopy[r, c], parent), lost or unknown[r, c]
        far = (i * i + j * j) * pixel**2 > radius**2
        out[r, c] = 0 if far else -1 if unknown[r, c] else 0 if z + target < parent else -1 if lost else 1
    return out


def test_horizon_visibility():
    rng = np.random.default_rng(4)
    for _ in range(25):
        shape = (int(rng.integers(3, 14)), int(rng.integers(3, 14)))
        ground, canopy = rng.integers(0, 6, shape).astype(float), rng.integers(0, 8, shape) * (rng.random(shape) < 0.2)
        unknown = rng.random(shape) < 0.08
        row, col = int(rng.integers(shape[0])), int(rng.integers(shape[1]))
        unknown[row, col], canopy[row, col] = False, 0
        args = (ground, canopy.astype(float), unknown, row, col, ground[row, col] + 1.7, 10.0)
        got = rays.horizon_visibility(*args, 0.0, 75.0, 1.0)
        assert (got == brute_horizon(*args, 75.0, 1.0)).all()


def test_maximin_is_nested():
    rng = np.random.default_rng(5)
    x, y = rng.random(60), rng.random(60)
    assert list(sampling.maximin(x, y, 9))[:5] == list(sampling.maximin(x, y, 5))


def test_stage_plans():
    assert stages.plan(["static-weights"])[-1] == "static-weights"
    assert "elevation" not in stages.plan(["static-weights"], role="water")
    order = stages.plan(["export"])
    assert all(order.index(n) < order.index(s) for s in order for n in stages.DEPENDENCIES[s])
    with pytest.raises(stages.CycleError):
        stages.plan(["a"], dependencies={"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError, match="unknown stage"):
        stages.plan(["a"], dependencies={"a": ("c",)})
    done = stages.execute({s: lambda got, s=s: s for s in stages.DEPENDENCIES}, ["validate"], results={"area": "kept"})
    assert done["area"] == "kept" and done["validate"] == "validate"


def test_product_contract(spark, tmp_path):
    from sightline.sources.products import project_many, read_product, scan_required, write_product

    df = spark.createDataFrame([(i, f"k{i}", i / 7) for i in range(50)], "id long, key string, w double")
    write_product(df, f"{tmp_path}/p", keys=["key"])
    assert read_product(spark, f"{tmp_path}/p").count() == 50
    df.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/p")
    with pytest.raises(IntegrityError):
        read_product(spark, f"{tmp_path}/p")
    with pytest.raises(IntegrityError):
        scan_required(spark, f"{tmp_path}/p", ["nothing"])
    got = project_many(df, {f"{tmp_path}/a": ["id"], f"{tmp_path}/b": ["key", "w"]}, {"top": F.max("w")})
    assert got["row_count"] == 50 and spark.read.parquet(f"{tmp_path}/b").columns == ["key", "w"]


def test_vector_sources(spark, tmp_path):
    from sightline.sources.rasters import point_in_ring, read_ascii_grid, read_buildings, read_geojson

    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert sorted(map(tuple, read_ascii_grid(spark, str(tmp_path / "g.asc")).collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)]
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]]]}}]}')
    shapes = read_geojson(spark, str(tmp_path / "f.json"), "name string")
    inside = point_in_ring(F.lit(1.0), F.lit(2.0), F.col("rings")[0])
    outside = point_in_ring(F.lit(5.0), F.lit(2.0), F.col("rings")[0])
    assert tuple(shapes.select("name", inside, outside).first()) == ("a", True, False)
    spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, -999.0), (9.0, 9.0, 10.0, 10.0, 5.0)], "xmin double, ymin double, xmax double, ymax double, height double").write.parquet(f"{tmp_path}/b")
    assert [r["height"] for r in read_buildings(spark, f"{tmp_path}/b", (0, 0, 2, 2)).collect()] == [None]


@pytest.mark.parametrize(("edge", "max_km"), [(5.0, 900.0), (7.0, 900.0), (20.0, 5_000.0)])
def test_pair_lookup_by_distance_alone(spark, edge, max_km):
    """All pairs within the radius: at high latitudes, over the poles and across 180 degrees."""
    grid = grids.SquareGrid(edge)
    rows, columns = sorted({math.floor(y / edge) for y in np.linspace(-90, 90, 61)}), sorted({math.floor(x / edge) for x in np.linspace(-180, 180, 241)})
    every = [(i, j) for i in rows for j in columns]
    some = every[:: max(1, len(every) // 60)]
    table = lambda at: spark.createDataFrame([(f"{i}_{j}",) for i, j in at], "cell string")
    got = {(r["source_h3"], r["target_h3"]) for r in grids.pair_lookup(table(some), table(every), grid, None, max_km).collect()}
    y, x = (np.radians((np.array(every)[:, k] + 0.5) * edge) for k in (0, 1))
    expected = set()
    for i, j in some:
        p, q = np.radians((i + 0.5) * edge), np.radians((j + 0.5) * edge)
        km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(np.sin((y - p) / 2) ** 2 + np.cos(p) * np.cos(y) * np.sin((x - q) / 2) ** 2, 0, 1)))
        expected |= {(f"{i}_{j}", f"{k}_{m}") for (k, m), d in zip(every, km, strict=True) if d <= max_km and (k, m) != (i, j)}
    assert got == expected


def test_pair_lookup_by_cells(spark):
    """Boxes of 1 km at 0, 2 and 3 km: the second is within 1.5 km though its centre is not."""
    grid = grids.SquareGrid(1 / math.radians(6371.0088))
    cells = spark.createDataFrame([("0_0",), ("0_2",), ("0_3",)], "cell string")
    pairs = lambda **how: sorted(r["target_h3"] for r in grids.pair_lookup(cells.limit(1), cells, grid, None, 1.5, **how).collect())
    assert pairs() == [] and pairs(by_cells=True) == ["0_2"]


def test_gap_of_cells(spark):
    """Distances of cells equal those of dense points on their edges."""
    at = [(0, 0), (0, 1), (11, 0), (11, 3), (-12, 35), (17, 2), (17, 20), (5, -36), (9, 34), (-18, 4), (3, 33)]
    grid, t = grids.SquareGrid(5.0), np.linspace(0, 5, 201)
    cells = spark.createDataFrame([(f"{i}_{j}",) for i, j in at], "cell string")
    both = cells.select(F.col("cell").alias("a")).crossJoin(cells.select(F.col("cell").alias("b")))
    got = {(r["a"], r["b"]): r["km"] for r in both.select("a", "b", grid.gap_km(F.col("a"), F.col("b")).alias("km")).collect()}

    def ring(i, j):
        y, x = np.radians(np.concatenate([i * 5 + t, i * 5 + t, i * 5 + 0 * t, i * 5 + 5 + 0 * t])), np.radians(np.concatenate([j * 5 + 0 * t, j * 5 + 5 + 0 * t, j * 5 + t, j * 5 + t]))
        return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)

    for p in at:
        for q in at:
            chord = np.sqrt(((ring(*p)[:, None] - ring(*q)[None]) ** 2).sum(2).min())
            assert got[(f"{p[0]}_{p[1]}", f"{q[0]}_{q[1]}")] == pytest.approx(2 * 6371.0088 * math.asin(chord / 2), abs=1.5)
