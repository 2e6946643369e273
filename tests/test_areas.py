"""Polygons, hexagons, quantiles and orders of work against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def rings(spark, named):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in named], f"polygon long, ring {RING}")


def test_concave_rings_and_holes(spark):
    """A U shape with a hole: areas in cells add up to the whole; the gap of the U has none."""
    from sightline.operators import polygons

    u = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]
    df = rings(spark, [(1, u), (1, hole)])
    got = {(r["row"], r["col"]): r["area"] for r in polygons.overlay(df, 3.0).collect()}
    assert sum(got.values()) == pytest.approx(81 - 18 - 1)
    assert got[0, 0] == pytest.approx(8) and got[0, 1] == pytest.approx(9) and (1, 1) not in got and got[1, 2] == pytest.approx(9)
    shares = polygons.domain_shares(df, 3.0, (0, 0, 3, 3)).where("row = 2").orderBy("col").collect()
    assert [r["land"] for r in shares] == pytest.approx([1, 0, 1]) and [r["water"] for r in shares] == pytest.approx([0, 1, 0])
    inside = df.limit(1).select(*[polygons.contains(F.col("ring"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("left", 1.5, 5.0), ("gap", 4.5, 5.0), ("out", 10.0, 1.0))]).first()
    assert (inside["left"], inside["gap"], inside["out"]) == (True, False, False)


def test_random_points(spark):
    from sightline.operators import polygons

    df = rings(spark, [(1, [(0, 0), (10, 0), (0, 10)]), (2, [(0, 0), (1000, 0), (1000, 0.001)])])
    got = polygons.random_points(df, 6, attempts=200).collect()
    assert sum(r["polygon"] == 1 for r in got) == 6 and all(r["x"] + r["y"] < 10 for r in got if r["polygon"] == 1)
    again = polygons.random_points(df.repartition(3), 6, attempts=200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert polygons.random_points(df.limit(0), 6).count() == 0


def test_hexagons(spark):
    from sightline.operators.grids import HexGrid

    rng = random.Random(2)
    grid = HexGrid(50.0)
    df = spark.createDataFrame([(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(200)], "lat double, lon double").withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    lat, lon = grid.center(F.col("cell"))
    x, y = grid.plane(F.col("lat"), F.col("lon"))
    cx, cy = grid.plane(lat, lon)
    rows = df.select("cell", grid.cell(lat, lon).alias("again"), F.sqrt(F.pow(x - cx, F.lit(2)) + F.pow(y - cy, F.lit(2))).alias("away"), grid.disk(F.col("cell"), 2).alias("disk"), grid.parent(F.col("cell"), 3).alias("parent")).collect()
    for r in rows:
        assert r["again"] == r["cell"] and r["away"] <= 50.0 + 1e-6 and len(set(r["disk"])) == 19 and r["cell"] in r["disk"] and r["parent"].count("_") == 1
    disk = df.limit(5).select("cell", F.explode(grid.disk(F.col("cell"), 2)).alias("other")).select(grid.distance(F.col("cell"), F.col("other")).alias("d")).groupBy("d").count().collect()
    assert {r["d"]: r["count"] // 5 for r in disk} == {0: 1, 1: 6, 2: 12}
    corners = df.limit(1).select(grid.boundary(F.col("cell")).alias("b")).first()["b"]
    assert len(corners) == 6 and all(math.isfinite(c["lat"]) for c in corners)


def test_exact_quantiles(spark):
    import numpy as np

    from sightline.operators.summaries import exact_quantiles

    rng = random.Random(4)
    values = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, "v", probabilities).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, probabilities)))
    assert exact_quantiles(df.limit(0), "v", [0.5]).first()["quantiles"] is None


def test_orders_of_work(spark):
    from sightline.operators import batches

    df = spark.createDataFrame([(f"s{i:03d}", float(i * 7 % 50), float(i * 3 % 20), i % 4) for i in range(100)], "source_h3 string, lat double, lon double, cost int")
    got = batches.chunk_ids(df, 8, "costly_first", cost=F.col("cost")).collect()
    expected = [r["source_h3"] for r in sorted(df.collect(), key=lambda r: (-r["cost"], r["source_h3"]))]
    assert [r["source_h3"] for r in sorted(got, key=lambda r: r["index"])] == expected and {r["index"] // 8 == r["chunk"] for r in got} == {True}
    with pytest.raises(ValueError, match="strategy"):
        batches.chunk_ids(df, 8, "random")
    with pytest.raises(ValueError, match="positive"):
        batches.source_slice(df, limit=0)
    assert batches.ordered_index(df.limit(0), [F.col("source_h3")]).count() == 0


def test_smoothing_keeps_to_its_support(spark):
    from sightline.operators.surfaces import smooth_inside

    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (9, 9, 5.0)], "row long, col long, v double")
    got = {(r["row"], r["col"]): r["v"] for r in smooth_inside(df, "v", 1.0).collect()}
    w = math.exp(-2)
    assert got == pytest.approx({(0, 0): (1 + 3 * w) / (1 + w), (0, 2): (3 + w) / (1 + w), (9, 9): 5.0})
