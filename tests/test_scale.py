"""Operators whose work must not grow faster than their input."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import checks, grids, rays, summaries
from sightline.plans import domain as D
from sightline.plans.queries import QUERIES

RAY = "ray long, ox double, oy double, tx double, ty double, eye double"
RASTER = "row long, col long, ground double, unknown boolean, canopy double, coefficient double, missing_class boolean"
PLACE = {"x0": 0.0, "y0": 0.0, "pixel": 10.0}


def test_crossings_by_windows():
    """Windows of distances share out a ray's cells without loss."""
    rng = np.random.default_rng(1)
    for ox, oy, tx, ty in [*rng.uniform(-300, 300, (40, 4)), (5, -5, 5, -905), (5, -5, 805, -805), (805, -5, 5, -5)]:
        whole = np.array(rays.cells_on_ray(ox, oy, tx, ty, 0.0, 0.0, 10.0))
        parts = [np.array(rays.cells_on_ray(ox, oy, tx, ty, 0.0, 0.0, 10.0, a, b)) for a, b in ((0, 70), (70, 240), (240, np.inf))]
        assert np.array_equal(np.concatenate(parts, axis=1), whole)


def test_canopy_depth_in_stages(spark, monkeypatch):
    """Stages and equal rays change no depth."""
    raster = spark.range(12000).select(
        F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), (F.col("id") % 7).cast("double").alias("ground"), (F.col("id") % 1501 == 1500).alias("unknown"),
        (F.col("id") % 5).cast("double").alias("canopy"), (F.col("id") % 3 / 2).alias("coefficient"), (F.col("id") % 1201 == 1199).alias("missing_class"))
    ends = [(k, 10.0 * (k * 7 % 10) + 5, -10.0 * (k * 97 % 1200) - 5, 10.0 * (k * 3 % 10) + 5, -10.0 * (k * 389 % 1200) - 5, 2.0) for k in range(40)]
    given = spark.createDataFrame(ends + [(k + 40, *rest) for k, *rest in ends], RAY)
    depths = lambda: dict(rays.canopy_depth(given, raster, curve=6.7e-8, **PLACE).collect())
    staged = depths()
    monkeypatch.setattr(rays, "_STAGES", ())
    assert staged == pytest.approx(depths())
    assert {k: v for k, v in staged.items() if k >= 40} == {k + 40: staged[k] for k in range(40)}
    assert -1 in staged.values() and max(staged.values()) > 0


def test_canopy_depth_stops_where_decided(spark):
    """rays of millions of cells that an unknown cell decides early are not walked to their end."""
    rows = [(0, c, 0.0, c == 3, 0.0, 0.0, False) for c in range(30)] + [(0, 5_000_000 + k, 0.0, False, 0.0, 0.0, False) for k in range(200)]
    given = spark.createDataFrame([(k, 5.0, -5.0, 50_000_005.0 + 10 * k, -5.0, 1.0) for k in range(200)], RAY)
    got = rays.canopy_depth(given, spark.createDataFrame(rows, RASTER), **PLACE).collect()
    assert {r["depth"] for r in got} == {-1.0} and len(got) == 200


def test_blocked_lines_in_a_crowded_bucket(spark):
    """lines are tried up to their first barrier, without a table of pairs."""
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 60, (300, 4)).astype(float), rng.integers(0, 60, (40, 4)).astype(float)
    one[:20, 2:] = one[:20, :2]  # points
    sides = "x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(one)], f"line long, {sides}")
    got = grids.blocked_lines(lines, spark.createDataFrame([tuple(map(float, v)) for v in two], sides), 25.0)
    assert "LeftSemi" in (plan := got._jdf.queryExecution().toString()) and "BroadcastExchange" not in plan
    side = lambda a, b, p: np.sign((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))

    def meet(a, b):
        p, q, r, s = a[:2], a[2:], b[:2], b[2:]
        boxes = all(max(p[k], q[k]) >= min(r[k], s[k]) and max(r[k], s[k]) >= min(p[k], q[k]) for k in (0, 1))
        return boxes and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0

    assert sorted(r["line"] for r in got.collect()) == [k for k, a in enumerate(one) if any(meet(a, b) for b in two)]


def test_partial_canopy_gathers_pixels_in_range(spark):
    """pixels out of range are 0 without being gathered, however far they lie."""
    near = [("s", r, c, float((r * 7 + c * 3) % 9), float(r % 3), (r * c) % 11 == 10) for r in range(12) for c in range(9)]
    grid = lambda k, kind: np.array([p[k] for p in near], kind).reshape(12, 9)
    pixels = spark.createDataFrame([*near, *[("s", 3_000_000 + k, 40, 0.0, 0.0, False) for k in range(5)]], "source_h3 string, row long, col long, ground double, canopy double, unknown boolean")
    observer = spark.createDataFrame([("s", 5, 4, 6.0)], "source_h3 string, o_row long, o_col long, eye double")
    got = {(r["row"], r["col"]): r["state"] for r in rays.partial_canopy(pixels, observer, pixel=10.0, curve=0.0, radius=45.0, target=1.0).collect()}
    unknown = grid(5, bool)
    want = rays.horizon_visibility(grid(3, float), np.where(unknown, 0, grid(4, float)), unknown, 5, 4, 6.0, 10.0, 0.0, 45.0, 1.0)
    assert {k: v for k, v in got.items() if k[0] < 12} == {(r, c): want[r, c] for r in range(12) for c in range(9)}
    assert all(got[3_000_000 + k, 40] == 0 for k in range(5)) and len(got) == 113


def test_samples_are_dealt_by_their_number(spark, small, monkeypatch):
    """tasks grow in number, not in size, beyond the session's partitions; rows stay the same."""
    lines = D.table(spark, small, "lineitem").count()
    whole = [sorted(map(repr, f(spark, small).collect())) for f in (D.samples, D.pairs, D.lookup)]
    monkeypatch.setattr(D, "LINES_PER_TASK", 500)
    assert D.samples(spark, small).rdd.getNumPartitions() == -(-lines // 500) > 3
    assert whole == [sorted(map(repr, f(spark, small).collect())) for f in (D.samples, D.pairs, D.lookup)]


@pytest.mark.parametrize("name", ["map_target_sums", "static_map_edges", "static_viewability_per_target", "factor_quantiles", "factor_states", "invalid_weights", "overview_maximum", "quantile_classes", "report_summary"])
def test_pairs_are_dealt_by_the_number_of_lines(spark, small, monkeypatch, name):
    """No table of lines or pairs is summed by pair in the session's fixed number of tasks; rows stay the same."""
    rows = lambda: sorted(map(repr, QUERIES[name](spark, small).collect()))
    whole = rows()
    monkeypatch.setattr(D, "LINES_PER_TASK", 300)
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(o_custkey#\w+, 5\), REPARTITION_BY_NUM", plan) and "Expand" not in plan
    assert not [by for by in re.findall(r"hashpartitioning\((.*), 3\)", plan) if "," in by]
    assert rows() == whole


@pytest.mark.parametrize("name", ["factor_states", "invalid_weights", "overview_maximum", "quantile_classes", "report_summary"])
def test_pairs_are_dealt_where_the_session_has_more_partitions(spark, small, monkeypatch, name):
    """Partitions that adaptive execution may merge to long tasks are dealt too; rows stay the same."""
    rows = lambda: sorted(map(repr, QUERIES[name](spark, small).collect()))
    whole, session = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(D, "LINES_PER_TASK", 300)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert rows() == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", session)
    lines = D.table(spark, small, "lineitem").count()
    for key in ("o_custkey", "c_custkey", "l_orderkey", "o_orderkey"):  # a join raises its sides to the session's number
        assert re.search(rf"hashpartitioning\({key}#\w+, 40\), REPARTITION_BY_NUM", plan)
    assert re.search(rf"hashpartitioning\(concat.*, {-(-lines // 300)}\), REPARTITION_BY_NUM", plan)
    assert not [by for by in re.findall(r"hashpartitioning\((.*), 40\)", plan) if "," in by]


@pytest.mark.parametrize(("lines_per_task", "parts"), [(20, lambda lines: 200), (5, lambda lines: -(-lines // 20))])
def test_pairs_are_dealt_to_tasks_that_writers_serve_directly(spark, small, monkeypatch, lines_per_task, parts):
    """F16: no shuffle of lines has more than 200 partitions, so that its writer holds no rows, until tasks are four times as long; rows stay the same."""
    rows = lambda: sorted(map(repr, QUERIES["overview_maximum"](spark, small).collect()))
    whole = rows()
    monkeypatch.setattr(D, "LINES_PER_TASK", lines_per_task)
    plan = QUERIES["overview_maximum"](spark, small)._jdf.queryExecution().executedPlan().toString()
    want = parts(D.table(spark, small, "lineitem").count())
    assert want >= 200
    for key in ("l_orderkey#\\w+", "concat.*"):
        assert re.findall(rf"hashpartitioning\({key}, (\d+)\), REPARTITION_BY_NUM", plan) == [str(want)]
    assert rows() == whole


def test_quantile_classes_round_as_sql(spark, monkeypatch):
    """weights at halves of a millionth round as the query's SQL rounds them."""
    given = [(f"S{k}", "T0", 0.02 + (k * 37 - 0.5) * 1e-6) for k in range(1, 2000)]
    monkeypatch.setattr(D, "pairs", lambda spark, d: spark.createDataFrame(given, "source_h3 string, target_h3 string, weight_static_viewability double"))
    got = {r["source_h3"]: r["v"] for r in QUERIES["quantile_classes"](spark, "").collect()}
    sql = dict(duckdb.execute("select s, round(greatest(w - 0.02, 0), 6) from (select unnest(?) as s, unnest(?) as w)", [[g[0] for g in given], [g[2] for g in given]]).fetchall())
    assert got == sql


def test_view_score_counts_sources_once(spark):
    """missing factors, missing sources and repeated pairs count as in one group by target."""
    given = [("a", "t", 0.5, 0.2), ("a", "t", 0.0, None), ("b", "t", 0.0, 0.0), (None, "t", 0.3, 0.3), ("a", "u", None, None), (None, "v", 0.0, 0.1)]
    pairs = spark.createDataFrame(given, "source_h3 string, target_h3 string, weight_terrain double, weight_static_viewability double")
    got = {r[0]: tuple(r)[1:] for r in summaries.view_score(pairs).collect()}
    assert got == {"t": (0.5, pytest.approx(0.5 / 3), 0.3, 1, 2, True), "u": (None, None, None, 0, 1, None), "v": (0.1, 0.1, 0.1, 0, 0, False)}


def scans(df, table):
    """How often a query's plan reads a table."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"/{table}.parquet")


def test_coverage_check_computes_pairs_once(spark, small):
    """the pair universe is not computed again for each of its uses."""
    assert scans(D.lookup(spark, small), "lineitem") == 1
    assert scans(QUERIES["coverage_check"](spark, small), "lineitem") == 0


def test_compose_static_computes_pairs_once(spark, small):
    """lookup, factors and check read one table of pairs."""
    assert scans(QUERIES["compose_static"](spark, small), "lineitem") == 0


def test_contract_checks_count_in_one_pass(spark, small):
    """F8: one aggregation of one table of pairs gives the three counts."""
    assert scans(QUERIES["contract_checks"](spark, small), "lineitem") == 1


def test_check_columns_find_the_same_rows(spark):
    rows = [(0.5, 0.4, 0.3, 0.12, 1000.0, 1.0), (0.3, 0.4, 0.3, 0.12, 1000.0, 1.0), (0.5, 0.4, 0.3, 0.2, 9000.0, 9.0), (None, None, 0.3, 0.12, None, 1.0), (0.5, 0.4, 0.3, None, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "joint double, weight_terrain double, weight_vegetation double, weight_static_viewability double, distance_m double, distance_km double")
    found = [checks.find_weighted_above_joint(df, "joint", "weight_terrain"), checks.find_wrong_products(df), checks.find_wrong_distances(df, 3.0)]
    counts = df.agg(*[F.count_if(c) for c in (checks.weighted_above_joint("joint", "weight_terrain"), checks.wrong_product(), checks.wrong_distance(3.0))]).first()
    assert tuple(counts) == tuple(f.count() for f in found) == (1, 3, 3)


def test_observation_geometry_computes_pairs_once(spark, small):
    """lookup, static and joint factors read one table of pairs."""
    assert scans(QUERIES["observation_geometry"](spark, small), "lineitem") == 0


def test_strongest_sources_computes_edges_once(spark, small):
    """maximum, sources that reach it and their number read one table of edges."""
    assert scans(QUERIES["strongest_sources"](spark, small), "lineitem") == 0
