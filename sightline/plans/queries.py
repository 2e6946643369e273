"""Queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators import checks, compose, grids, kernels, rays, sampling, summaries, surfaces
from sightline.plans import area_queries  # noqa: F401  (registers its queries)
from sightline.plans import domain as D
from sightline.plans import sight_sql as Q
from sightline.plans.registry import ORACLE_SQL, QUERIES, query

PAIR = D.PAIR


# -- flagship ---------------------------------------------------------------


@query(
    """SELECT target_h3, sum(weight_static_viewability) AS view_score, avg(weight_static_viewability) AS mean_view_score, max(weight_static_viewability) AS best_view_score,
    count(DISTINCT CASE WHEN weight_terrain>0 THEN source_h3 END) AS visible_source_count, count(DISTINCT source_h3) AS candidate_source_count, max(weight_terrain)>0 AS binary_visible
    FROM pairs GROUP BY target_h3""",
    with_=D.PAIRS_SQL, doubles="view_score mean_view_score best_view_score",
)
def static_viewability_per_target(spark, d):
    return summaries.view_score(D.pairs(spark, d))


# -- scans and scalars ------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R'", doubles="l_quantity")
def scan_required(spark, d):
    from sightline.sources.products import scan_required as scan

    df = scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag"])
    return df.where((F.col("l_shipdate") >= F.to_timestamp(F.lit("1995-01-01"))) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_partkey", F.col("l_quantity").cast("double"))


def _decay(name: str, curve: S.Decay, sql: str) -> None:
    @query(f"SELECT l_quantity::DOUBLE AS distance_km, count(*) AS n, least(greatest(CASE WHEN l_quantity<=30 THEN {sql} ELSE 0 END,0),1) AS weight FROM lineitem GROUP BY l_quantity", doubles="distance_km weight", name=name)
    def decay(spark, d):
        q = D.table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("distance_km")).agg(F.count("*").alias("n"))
        return q.withColumn("weight", curve.weight("distance_km"))


_decay("decay_logistic", S.Decay(), D.LOGISTIC_SQL.format(d="l_quantity::DOUBLE"))
_decay("decay_exponential", S.Decay("exponential", scale=8.0, normalize=False), "exp(-l_quantity/8.0)")
_decay("decay_piecewise", S.Decay("piecewise", near=3.0, far=30.0, normalize=False), "CASE WHEN l_quantity<=3 THEN 1 WHEN l_quantity>=30 THEN 0 ELSE (30-l_quantity)/27.0 END")


@query(
    f"""SELECT s.id AS supplier, c.id AS customer, 2*6371.0088*asin(sqrt(least(pow(sin((radians(c.lat)-radians(s.lat))/2),2)+cos(radians(s.lat))*cos(radians(c.lat))*pow(sin((radians(c.lon)-radians(s.lon))/2),2),1))) AS km
    FROM {D.points_sql('supplier')} s JOIN {D.points_sql('customer')} c ON s.id=c.id%100+1""",
    doubles="km",
)
def haversine(spark, d):
    s, c = D.points(spark, d, "supplier"), D.points(spark, d, "customer")
    s = s.select(F.col("id").alias("supplier"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    joined = c.join(s, F.col("supplier") == F.col("id") % 100 + 1)
    return joined.select("supplier", F.col("id").alias("customer"), S.haversine_km("slat", "slon", "lat", "lon").alias("km"))


@query(
    """SELECT p_size, h, round(h,6)-0.85714*pow(p_size*1000.0,2)/(2*6378137.0) AS dropped, greatest(p_size*1000.0-1500.0,0)>h AS beyond FROM (
    SELECT DISTINCT p_size, sqrt(2*(6378137.0/0.85714)*(p_size/10.0)+pow(p_size/10.0,2))+sqrt(2*(6378137.0/0.85714)*1.5+1.5*1.5) AS h FROM part)""",
    doubles="h dropped",
)
def horizon_and_curvature(spark, d):
    p = D.table(spark, d, "part").select("p_size").distinct().withColumn("h", S.horizon_m(F.col("p_size") / 10, 1.5))
    m = F.col("p_size") * F.lit(1000.0)
    return p.select("p_size", "h", S.curvature_drop(F.round("h", 6), m).alias("dropped"), S.beyond_horizon(m, F.lit(1500.0), F.col("h")).alias("beyond"))


@query(
    """SELECT p_size, CAST(least(greatest(floor(10*(p_size/50.0)+0.5),1),10) AS INTEGER) AS samples, CAST(ceil(p_size/1.406476)+2 AS INTEGER) AS rings,
    CASE WHEN p_size/50.0>=0.5 AND 1-p_size/50.0>=0.5 THEN 'mixed' WHEN p_size/50.0>=0.5 THEN 'land' WHEN 1-p_size/50.0>=0.5 THEN 'water' ELSE 'excluded' END AS kind FROM (SELECT DISTINCT p_size FROM part)"""
)
def cell_typing_and_counts(spark, d):
    p = D.table(spark, d, "part").select("p_size").distinct()
    f = F.col("p_size") / F.lit(50.0)
    return p.select("p_size", S.sample_count(f, 10, 1).alias("samples"), S.disk_rings(F.col("p_size").cast("double"), S.EDGE_KM[7]).alias("rings"), S.cell_type(f, 1 - f).alias("kind"))


_BAND = "CASE WHEN canopy>=15 THEN 1.0 WHEN canopy>=5 THEN 0.65 WHEN canopy>=2 THEN 0.25 ELSE 0.0 END"
_MULT = "CASE landcover " + " ".join(f"WHEN {c} THEN {w[0]}" for c, w in S.CLASS_WEIGHTS.items()) + " END"
_FLOOR = "CASE landcover " + " ".join(f"WHEN {c} THEN {w[1]}" for c, w in S.CLASS_WEIGHTS.items()) + " END"


@query(
    f"""SELECT "row", col, {_BAND} AS band, greatest({_BAND}*{_MULT}, {_FLOOR}) AS coefficient, landcover=80 AND canopy>0 AS missing, 1-greatest({_BAND}*{_MULT}, {_FLOOR}) AS through,
    exp(-0.002*canopy*greatest({_BAND}*{_MULT}, {_FLOOR})) AS decayed FROM pixels""",
    with_=D.PIXELS_SQL, doubles="band coefficient through decayed",
)
def canopy_obstruction(spark, d):
    p = D.pixels(spark, d)
    score, missing = S.class_obstruction(F.col("canopy"), F.col("landcover"))
    p = p.withColumns({"coefficient": score, "missing": missing, "band": S.obstruction_band(F.col("canopy"))})
    return p.select("row", "col", "band", "coefficient", "missing", S.transmission(F.col("coefficient")).alias("through"), S.length_transmission(F.col("canopy") * F.col("coefficient")).alias("decayed"))


@query(
    f"""SELECT "row", col, CASE WHEN dem IS NULL THEN -9999.0 ELSE least(greatest(greatest({_BAND}*m.multiplier, m.floor),0),1) END AS obstruction FROM pixels JOIN
    (SELECT unnest([{','.join(map(str, S.CLASS_WEIGHTS))}]) AS code, unnest([{','.join(str(w[0]) for w in S.CLASS_WEIGHTS.values())}])::DOUBLE AS multiplier, unnest([{','.join(str(w[1]) for w in S.CLASS_WEIGHTS.values())}])::DOUBLE AS floor) m ON landcover=code""",
    with_=D.PIXELS_SQL, doubles="obstruction",
)
def landcover_weights(spark, d):
    p = D.pixels(spark, d)
    classes = spark.createDataFrame([(c, w[0], w[1]) for c, w in S.CLASS_WEIGHTS.items()], "landcover int, multiplier double, floor double")
    band = F.when(F.col("dem").isNull(), F.lit(S.NODATA)).otherwise(S.obstruction_band(F.col("canopy")))
    return p.join(F.broadcast(classes), "landcover").select("row", "col", S.surface_obstruction(band, F.col("multiplier"), F.col("floor")).alias("obstruction"))  # eleven rows


@query(
    """SELECT p_partkey, CASE WHEN s=0 THEN CASE WHEN 10<c THEN e-b ELSE 0 END WHEN s>0 THEN greatest(0, least(e,(c-10)/s)-b) ELSE greatest(0, e-greatest(b,(c-10)/s)) END AS straight
    FROM (SELECT p_partkey, (p_size%7-3)/10.0::DOUBLE AS s, p_size::DOUBLE AS b, p_size+10.0::DOUBLE AS e, (p_partkey%40)::DOUBLE AS c FROM part)""",
    doubles="straight",
)
def below_length(spark, d):
    p = D.table(spark, d, "part")
    b = F.col("p_size").cast("double")
    return p.select("p_partkey", S.below_length(b, b + 10, F.lit(10.0), (F.col("p_size") % 7 - 3) / F.lit(10.0), F.lit(0.0), (F.col("p_partkey") % 40).cast("double")).alias("straight"))


@query(
    """SELECT source_h3, target_h3, CASE WHEN weight_terrain IS NULL THEN 'source_unavailable' WHEN weight_terrain>0 THEN 'positive' ELSE 'derived_zero' END AS terrain_state,
    CASE WHEN source_type='water' THEN 'not_applicable' WHEN weight_vegetation IS NULL OR weight_terrain IS NULL THEN 'source_unavailable' WHEN weight_terrain=0 THEN 'no_baseline_support_neutral'
    WHEN weight_vegetation>0 THEN 'positive' ELSE 'derived_zero' END AS vegetation_state, CASE WHEN weight_vegetation*weight_terrain IS NULL THEN 1 ELSE least(greatest(weight_vegetation*weight_terrain,0),1) END AS final_weight FROM edges""",
    with_=D.EDGES_SQL, doubles="final_weight",
)
def factor_states(spark, d):
    e = D.nullable_edges(spark, d)
    t, v = F.col("weight_terrain"), F.col("weight_vegetation")
    return e.select(*PAIR, S.weight_state(t, t.isNotNull()).alias("terrain_state"), S.vegetation_state(F.col("source_type"), t, v).alias("vegetation_state"), S.source_vegetation_weight(v, t).alias("final_weight"))


# -- kernels ----------------------------------------------------------------

_PIXELS = """px AS (SELECT source_h3, target_h3, pixel, count(*) AS visible_count, sum(CAST(distance_km*1e6 AS BIGINT))::BIGINT AS distance_mm_sum, min(CAST(distance_km*1e6 AS BIGINT)) AS distance_mm_min,
  max(CAST(distance_km*1e6 AS BIGINT)) AS distance_mm_max, sum(wq)::BIGINT AS weight_q_sum, bit_or(1::BIGINT << (observer-1)) AS observer_mask FROM samples WHERE bare GROUP BY ALL)"""
_TARGETS = """tg AS (SELECT source_h3, target_h3, count(*) AS visible_pixels, sum(visible_count)::BIGINT AS visible_pairs, max(visible_count) AS most_observers, sum(weight_q_sum)::BIGINT AS weight_q_sum,
  min(distance_mm_min) AS nearest_mm, max(distance_mm_max) AS farthest_mm, sum(distance_mm_sum)::BIGINT AS distance_mm_sum, CAST(bit_count(bit_or(observer_mask)) AS INTEGER) AS observers FROM px GROUP BY ALL)"""


@query("SELECT * FROM px", with_=f"{D.SAMPLES_SQL}, {_PIXELS}")
def pixel_accumulate(spark, d):
    return kernels.pixel_accumulate(D.samples(spark, d), F.col("bare"), D.DECAY.weight("distance_km"))


@query("SELECT * FROM tg", with_=f"{D.SAMPLES_SQL}, {_PIXELS}, {_TARGETS}")
def pixels_to_targets(spark, d):
    return kernels.pixels_to_targets(kernels.pixel_accumulate(D.samples(spark, d), F.col("bare"), D.DECAY.weight("distance_km")))


@query(
    """SELECT source_h3, target_h3, least(visible_pairs*4.0/(7.0*water_pixels),1) AS joint_fraction, least(weight_q_sum/1e6*4.0/(7.0*water_pixels),1) AS weighted_fraction, least(observers/7.0,1) AS observer_fraction,
    least(visible_pixels*900.0*4/1e6/water_km2,1) AS area_fraction FROM tg JOIN dn USING (target_h3) WHERE visible_pixels>=2 AND visible_pixels*900.0*4/1e6>=0.0""",
    with_=f"{D.SAMPLES_SQL}, {_PIXELS}, {_TARGETS}, dn AS (SELECT target_h3, count(DISTINCT pixel) AS water_pixels, count(DISTINCT pixel)*900.0*4/1e6 AS water_km2 FROM samples GROUP BY target_h3)",
    doubles="joint_fraction weighted_fraction observer_fraction area_fraction",
)
def kernel_support(spark, d):
    s = D.samples(spark, d)
    n = F.countDistinct("pixel")
    denominators = s.groupBy("target_h3").agg(n.alias("water_pixels"), (n * F.lit(900.0 * 4 / 1e6)).alias("water_km2"))
    grouped = kernels.pixels_to_targets(kernels.pixel_accumulate(s, F.col("bare"), D.DECAY.weight("distance_km")))
    return kernels.kernel_support(grouped, denominators, observers=7, stride=2, least_pixels=2)


@query(
    """SELECT source_h3, target_h3, count(*) AS samples, count(*) FILTER (seen) AS visible_pairs, count(*) FILTER (seen)>0 AS terrain_binary, count(*) FILTER (seen)/count(*) AS joint_fraction,
    coalesce(sum(wq) FILTER (seen),0)/1e6/count(*) AS weighted_fraction, count(DISTINCT CASE WHEN seen THEN pixel END)/count(DISTINCT pixel) AS union_fraction,
    count(DISTINCT CASE WHEN seen THEN observer END)/count(DISTINCT observer) AS observer_fraction FROM (SELECT *, bare AND distance_km*1000<10824.45 AND distance_km<=30 AS seen FROM samples WHERE source_type='water') GROUP BY ALL""",
    with_=D.SAMPLES_SQL, doubles="joint_fraction weighted_fraction union_fraction observer_fraction",
)
def water_kernel(spark, d):
    s = D.samples(spark, d).where("source_type = 'water'")
    m = F.col("distance_km") * 1000
    seen = F.col("bare") & (m < S.horizon_m(2.5, 1.5)) & (m <= 30_000)  # strict at the horizon, inclusive at the range
    return kernels.water_kernel(s, seen, D.DECAY.weight("distance_km"))


@query(
    """SELECT fine_h3, CASE WHEN u=0 THEN k/t END AS score, k/t AS lower, (k+u)/t AS upper, u/t AS unknown, o/t AS out_of_range FROM (
    SELECT fine_h3, sum(weight) AS t, sum(greatest(value,0)*weight) AS k, sum(CASE WHEN value=-1 THEN weight ELSE 0 END) AS u, sum(CASE WHEN value=-2 THEN weight ELSE 0 END) AS o FROM rays GROUP BY fine_h3)""",
    with_=D.RAYS_SQL, doubles="score lower upper unknown out_of_range",
)
def transmission_bounds(spark, d):
    return kernels.support_bounds(D.ray_states(spark, d), "fine_h3")


@query(
    """SELECT fine_h3, t/w AS weight_terrain, CASE WHEN t>0 THEN least(greatest(k/t,0),1) END AS above_ground_lower, CASE WHEN t>0 THEN least(greatest((k+m)/t,0),1) END AS above_ground_upper,
    CASE WHEN t>0 AND m=0 THEN least(greatest(k/t,0),1) END AS weight_above_ground, CASE WHEN t=0 THEN 'not_applicable' WHEN m>0 THEN 'unknown' ELSE 'known' END AS above_ground_status FROM (
    SELECT fine_h3, sum(weight) AS w, sum(CASE WHEN bare=1 THEN decay*weight ELSE 0 END) AS t, sum(greatest(joint,0)*decay*weight) AS k, sum(CASE WHEN joint=-1 AND bare=1 THEN decay*weight ELSE 0 END) AS m
    FROM (SELECT *, value AS joint FROM rays) GROUP BY fine_h3)""",
    with_=D.RAYS_SQL, doubles="weight_terrain above_ground_lower above_ground_upper weight_above_ground",
)
def conditional_weights(spark, d):
    return kernels.conditional_weights(D.ray_states(spark, d), "fine_h3")


@query(
    """SELECT source_h3, c+b+u AS total, c+b AS known, c/nullif(c+b+u,0) AS lower, (c+u)/nullif(c+b+u,0) AS upper, CASE WHEN u=0 THEN c/nullif(c+b+u,0) END AS complete, c/nullif(c+b,0) AS known_only FROM (
    SELECT source_h3, count(*) FILTER (state=1) AS c, count(*) FILTER (state=0) AS b, count(*) FILTER (state=-1) AS u FROM rays GROUP BY source_h3)""",
    with_=D.RAYS_SQL, doubles="lower upper complete known_only",
)
def comparison_means(spark, d):
    s = F.col("state")
    c = D.ray_states(spark, d).groupBy("source_h3").agg(F.count_if(s == 1).alias("c"), F.count_if(s == 0).alias("b"), F.count_if(s == -1).alias("u"))
    return c.select("source_h3", S.comparison_mean(F.col("c"), F.col("b"), F.col("u")).alias("m")).select("source_h3", "m.*")


@query(
    """SELECT target_h3, lo AS combined_lower, hi AS combined_upper, CASE WHEN lo=hi THEN lo END AS weight_combined, CASE WHEN lo=hi AND kb>0 THEN lo/kb END AS weight_vegetation,
    CASE WHEN kb=0 THEN 'no_baseline_support_neutral' WHEN lo<>hi THEN 'partial_unknown_paths' ELSE 'computed_canopy_model' END AS vegetation_status,
    CASE WHEN kb=0 THEN 'zero_baseline_support' WHEN lo<>hi THEN 'partial_unknown_paths' ELSE 'computed_canopy_model' END AS combined_status FROM (
    SELECT target_h3, kb, least(kn/(7.0*n),kb) AS lo, least((kn+un)/(7.0*n),kb) AS hi FROM (
    SELECT target_h3, count(*) AS n, sum(CASE WHEN bare=1 THEN decay ELSE 0 END)/(7.0*count(*)) AS kb, sum(CASE WHEN state=1 THEN decay ELSE 0 END) AS kn, sum(CASE WHEN state=-1 AND observer=7 THEN decay ELSE 0 END) AS un FROM rays GROUP BY target_h3))""",
    with_=D.RAYS_SQL, doubles="combined_lower combined_upper weight_combined weight_vegetation",
)
def partial_kernels(spark, d):
    r = D.ray_states(spark, d)
    n = F.count("*")
    some = lambda c: F.sum(F.when(c, F.col("decay")).otherwise(0.0))
    g = r.groupBy("target_h3").agg(n.alias("n"), S.ratio(some(F.col("bare") == 1), n * 7.0).alias("kb"), some(F.col("state") == 1).alias("kn"), some((F.col("state") == -1) & (F.col("observer") == 7)).alias("un"))
    return g.select("target_h3", S.partial_kernel(F.col("kn"), F.col("un"), F.lit(7.0), F.col("n"), F.col("kb")).alias("k")).select("target_h3", "k.*")


@query(
    """, gap AS (SELECT source_h3, target_h3, s.v AS s, c.v AS c, CASE WHEN (s.v IS NULL)<>(c.v IS NULL) THEN 1 ELSE coalesce(abs(s.v-c.v),0) END AS g FROM smp s JOIN cen c USING (source_h3,target_h3)),
    err AS (SELECT max(g) AS max_error, quantile_cont(g,0.95) AS p95_error FROM gap)
    SELECT source_h3, target_h3, CASE WHEN max_error<=0.05 THEN s ELSE c END AS weight, CASE WHEN max_error<=0.05 THEN 'sampled' ELSE 'census' END AS used, max_error, p95_error FROM gap, err""".lstrip(", ").replace("gap AS", "SELECT * FROM (WITH gap AS", 1) + ")",
    with_=f"{D.SAMPLES_SQL}, cen AS (SELECT source_h3, target_h3, sum(CASE WHEN bare THEN wq ELSE 0 END)/(1e6*count(*)) AS v FROM samples GROUP BY ALL), smp AS (SELECT source_h3, target_h3, sum(CASE WHEN bare THEN wq ELSE 0 END)/(1e6*count(*)) AS v FROM samples WHERE observer<=4 GROUP BY ALL)",
    doubles="weight max_error p95_error",
)
def census_gate(spark, d):
    q = S.quantize_weight(D.DECAY.weight("distance_km"))
    weigh = lambda df: df.groupBy(*PAIR).agg(S.ratio(F.sum(F.when(F.col("bare"), q).otherwise(0)), F.lit(1e6) * F.count("*")).alias("weight"))
    s = D.samples(spark, d)
    return kernels.census_gate(weigh(s.where("observer <= 4")), weigh(s), PAIR, "weight", 0.05)


# -- composition and checks -------------------------------------------------


@query(
    """SELECT l.source_h3, l.target_h3, l.source_type, l.distance_km, CASE WHEN s.weight_terrain IS NULL AND CAST(substr(l.source_h3,2) AS INT)%10<>0 THEN 0 ELSE s.weight_terrain END AS weight_terrain
    FROM pairs l LEFT JOIN (SELECT * FROM pairs WHERE weight_terrain>0.2) s USING (source_h3,target_h3)""",
    with_=D.PAIRS_SQL, doubles="distance_km weight_terrain",
)
def densify_sparse(spark, d):
    p = D.pairs(spark, d)
    completed = p.where(F.substring("source_h3", 2, 9).cast("int") % 10 != 0).select("source_h3").distinct()
    return compose.densify(p.select(*PAIR, "source_type", "distance_km"), p.where("weight_terrain > 0.2"), "weight_terrain", completed)


@query(
    "SELECT source_h3, target_h3, source_type, distance_km, weight_terrain, weight_vegetation, weight_static_viewability FROM pairs", with_=D.PAIRS_SQL,
    doubles="distance_km weight_terrain weight_vegetation weight_static_viewability",
)
def compose_static(spark, d):
    p = _once(spark, D.pairs(spark, d), "pairs")
    return compose.compose_static(p.select(*PAIR, "source_type", "distance_km"), p.select(*PAIR, "weight_terrain"), p.select(*PAIR, "weight_vegetation"))


@query(
    """SELECT source_h3, target_h3, weight_terrain, kc/(n*1e6) AS weight_canopy_los_raw, least(kc/(n*1e6),weight_terrain) AS weight_canopy_los,
    CASE WHEN weight_terrain>0 THEN least(kc/(n*1e6),weight_terrain)/weight_terrain ELSE 1 END AS weight_vegetation, CASE WHEN weight_terrain=0 THEN 'no_baseline_support_neutral' ELSE 'computed_canopy_los' END AS vegetation_status
    FROM pairs JOIN sums USING (source_h3,target_h3) WHERE pairs.source_type='land'""",
    with_=D.PAIRS_SQL, doubles="weight_terrain weight_canopy_los_raw weight_canopy_los weight_vegetation",
)
def dual_surface(spark, d):
    sparse = lambda s: D.kernel(spark, d, s).where("terrain_binary").select(*PAIR, F.col("weighted_fraction").alias("weight_terrain"))
    return compose.dual_surface(D.lookup(spark, d), sparse("bare"), sparse("canopy"))


@query(
    """SELECT l.source_h3, l.target_h3, l.source_type, l.distance_km, j.joint_fraction, s.weight_terrain, s.weight_vegetation, s.weight_static_viewability,
    CASE WHEN s.weight_terrain IS NULL THEN 'source_unavailable' WHEN s.weight_terrain>0 THEN 'positive' ELSE 'derived_zero' END AS terrain_state,
    CASE WHEN j.joint_fraction IS NULL THEN 'source_unavailable' WHEN j.joint_fraction>0 THEN 'positive' ELSE 'derived_zero' END AS joint_state,
    CASE WHEN l.source_type='water' THEN 'not_applicable' WHEN s.weight_terrain IS NULL THEN 'source_unavailable' WHEN s.weight_terrain=0 THEN 'no_baseline_support_neutral' WHEN s.weight_vegetation>0 THEN 'positive' ELSE 'derived_zero' END AS vegetation_state,
    CASE WHEN s.weight_static_viewability IS NULL THEN 'source_unavailable' WHEN s.weight_static_viewability>0 THEN 'positive' ELSE 'derived_zero' END AS static_state
    FROM pairs l LEFT JOIN (SELECT * FROM pairs WHERE distance_km<=2) s USING (source_h3,target_h3) LEFT JOIN (SELECT * FROM pairs WHERE joint_fraction>0.5) j USING (source_h3,target_h3)""",
    with_=D.PAIRS_SQL, doubles="distance_km joint_fraction weight_terrain weight_vegetation weight_static_viewability",
)
def observation_geometry(spark, d):
    p = _once(spark, D.pairs(spark, d), "pairs")
    return compose.observation_geometry(p.select(*PAIR, "source_type", "distance_km"), p.where("distance_km <= 2"), p.where("joint_fraction > 0.5"))


@query("SELECT source_h3, target_h3, max(distance_km) AS weight, bool_and(bare) AS visible, min(CASE WHEN state=1 THEN 'a' ELSE 'b' END) AS method FROM samples GROUP BY ALL", with_=D.SAMPLES_SQL, doubles="weight")
def max_merge(spark, d):
    s = D.samples(spark, d).select(*PAIR, F.col("distance_km").alias("weight"), F.col("bare").alias("visible"), F.when(F.col("state") == 1, "a").otherwise("b").alias("method"))
    return compose.max_merge(s, "weight")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*)>1")
def duplicate_keys(spark, d):
    return checks.find_duplicates(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT source_h3, target_h3, 'missing' AS side FROM pairs WHERE distance_km>1 UNION ALL SELECT 'none', target_h3, 'extra' FROM (SELECT DISTINCT target_h3 FROM pairs)""", with_=D.PAIRS_SQL,
)
def coverage_check(spark, d):
    p = _once(spark, D.lookup(spark, d), "lookup")
    factor = p.where("distance_km <= 1").select(*PAIR).union(p.select(F.lit("none"), "target_h3").distinct())
    return checks.find_uncovered(p, factor, PAIR)


@query(
    "SELECT source_h3, target_h3, concat_ws(',', CASE WHEN weight_terrain IS NULL THEN 'weight_terrain' END, CASE WHEN weight_vegetation IS NULL THEN 'weight_vegetation' END) AS wrong FROM edges WHERE weight_terrain IS NULL OR weight_vegetation IS NULL",
    with_=D.EDGES_SQL,
)
def invalid_weights(spark, d):
    return checks.find_invalid_weights(D.nullable_edges(spark, d), PAIR, ["weight_terrain", "weight_vegetation"]).select(*PAIR, "wrong")


@query(
    """SELECT (SELECT count(*) FROM pairs WHERE weight_terrain>joint_fraction+1e-6) AS weighted_above_joint, (SELECT count(*) FROM pairs WHERE abs(weight_static_viewability-weight_terrain*weight_vegetation)>1e-7) AS wrong_products,
    (SELECT count(*) FROM pairs WHERE distance_km>3.0001) AS wrong_distances""",
    with_=D.PAIRS_SQL,
)
def contract_checks(spark, d):
    p = D.pairs(spark, d).withColumn("distance_m", F.col("distance_km") * 1000)
    return p.agg(
        F.count_if(checks.weighted_above_joint("joint_fraction", "weight_terrain")).alias("weighted_above_joint"), F.count_if(checks.wrong_product()).alias("wrong_products"),
        F.count_if(checks.wrong_distance(3.0)).alias("wrong_distances"),
    )


@query("SELECT count(*) AS wrong_bounds FROM rays WHERE false", with_=D.RAYS_SQL)
def bounds_check(spark, d):
    return checks.find_wrong_bounds(kernels.support_bounds(D.ray_states(spark, d), "fine_h3"), 1e-9).agg(F.count("*").alias("wrong_bounds"))


@query(
    "SELECT count(*) AS row_count, count(DISTINCT source_h3) AS source_h3_count, count(DISTINCT target_h3) AS target_h3_count, min(weight_terrain) AS min_weight, max(weight_terrain) AS max_weight, avg(weight_terrain) AS mean_weight, count(*) FILTER (weight_terrain IS NULL) AS null_weights FROM edges",
    with_=D.EDGES_SQL, doubles="min_weight max_weight mean_weight",
)
def table_audit(spark, d):
    return checks.table_audit(D.nullable_edges(spark, d), PAIR, "weight_terrain")


# -- summaries --------------------------------------------------------------

_STATS = ", ".join(f"{f}({c}) AS {n}_{c}" for c in summaries.FACTORS for n, f in (("mean", "avg"), ("max", "max"), ("sum", "sum")))
_STAT_NAMES = " ".join(f"{n}_{c}" for c in summaries.FACTORS for n in ("mean", "max", "sum"))


@query(
    f"""SELECT target_h3, count(*) AS candidate_pairs, count(DISTINCT source_h3) AS candidate_cells, count(*) FILTER (weight_static_viewability>0) AS positive_static_pairs, {_STATS},
    avg(weight_vegetation) FILTER (weight_terrain>0) AS mean_canopy_given_terrain_support, count(*) FILTER (weight_terrain>0) AS terrain_supported_pairs,
    count(*) FILTER (weight_static_viewability>0)/count(*) AS positive_static_fraction FROM pairs WHERE source_type='land' GROUP BY target_h3""",
    with_=D.PAIRS_SQL, doubles=f"{_STAT_NAMES} mean_canopy_given_terrain_support positive_static_fraction",
)
def summary_by_target(spark, d):
    return summaries.pair_summary(D.pairs(spark, d).where("source_type = 'land'"), "target_h3")


@query(
    f"""SELECT * REPLACE (NULL::DOUBLE AS mean_weight_vegetation, NULL::DOUBLE AS max_weight_vegetation, NULL::DOUBLE AS sum_weight_vegetation), 'not_applicable' AS canopy_support FROM (
    SELECT source_h3, count(*) AS candidate_pairs, count(DISTINCT target_h3) AS candidate_cells, count(*) FILTER (weight_static_viewability>0) AS positive_static_pairs, {_STATS},
    NULL::DOUBLE AS mean_canopy_given_terrain_support, count(*) FILTER (weight_terrain>0) AS terrain_supported_pairs,
    count(*) FILTER (weight_static_viewability>0)/count(*) AS positive_static_fraction FROM pairs WHERE source_type='water' GROUP BY source_h3)""",
    with_=D.PAIRS_SQL, doubles=f"{_STAT_NAMES} positive_static_fraction",
)
def summary_by_water_source(spark, d):
    return summaries.pair_summary(D.pairs(spark, d).where("source_type = 'water'"), "source_h3", role="water")


def _distance_summary(key: str, other: str) -> None:
    @query(
        f"""SELECT {key}, count(DISTINCT {other}) AS partners, sum(weight_distance) AS sum_weight, avg(weight_distance) AS mean_weight, max(weight_distance) AS max_weight, quantile_cont(weight_distance,0.9) AS p90_weight,
        min(distance_km) AS nearest_km, avg(distance_km) AS mean_km FROM pairs GROUP BY {key}""",
        with_=D.PAIRS_SQL, doubles="sum_weight mean_weight max_weight p90_weight nearest_km mean_km", name=f"distance_summary_by_{key.split('_')[0]}",
    )
    def summary(spark, d):
        return summaries.distance_summary(D.pairs(spark, d), key)


_distance_summary("target_h3", "source_h3")
_distance_summary("source_h3", "target_h3")


def _coverage_sql(value: str, applies: str, name: str) -> str:
    v, m = f"count({value})", f"count(*) FILTER (({value}) IS NULL AND {applies})"
    return f"""CASE WHEN {v}>0 AND {m}=0 THEN sum({value}) END AS {name}, CASE WHEN {v}>0 THEN sum({value}) END AS {name}_available, avg({value}) AS {name}_mean_valid, {v} AS {name}_valid_count, {m} AS {name}_missing_count,
    {v}+{m} AS {name}_applicable_count, count(*)-{v}-{m} AS {name}_not_applicable_count, {v}/nullif({v}+{m},0) AS {name}_coverage_fraction,
    CASE WHEN {v}+{m}=0 THEN 'not_applicable' WHEN {v}=0 THEN 'unavailable' WHEN {m}>0 THEN 'partial' ELSE 'complete' END AS {name}_status"""


_EXEMPT = "coalesce(source_type='water' OR weight_terrain=0, source_type='water')"
_METRICS = {"distance_weight_sum": "weight_distance", "vegetation_weight_sum": f"CASE WHEN NOT {_EXEMPT} AND weight_terrain>0 THEN weight_vegetation END", "terrain_weight_sum": "weight_terrain", "target_static_kernel_sum": "net_static_weight"}


@query(
    "SELECT target_h3, " + ", ".join(_coverage_sql(v, f"NOT {_EXEMPT}" if n.startswith("veg") else "true", n) for n, v in _METRICS.items())
    + ", count(*) AS pair_count, count(DISTINCT source_h3) AS candidate_source_count, count(*) FILTER (weight_terrain>0) AS terrain_visible_source_count, count(*) FILTER (net_static_weight>0) AS combined_visible_source_count FROM edges GROUP BY target_h3",
    with_=D.EDGES_SQL, doubles=" ".join(f"{n} {n}_available {n}_mean_valid {n}_coverage_fraction" for n in _METRICS),
)
def map_target_sums(spark, d):
    return summaries.map_target_sums(D.nullable_edges(spark, d))


_SOURCE_METRICS = {n.replace("target_", "source_"): v for n, v in _METRICS.items()}


@query(
    "SELECT source_h3, " + ", ".join(_coverage_sql(v, f"NOT {_EXEMPT}" if n.startswith("veg") else "true", n) for n, v in _SOURCE_METRICS.items())
    + ", count(*) AS pair_count, count(*) FILTER (weight_terrain>0) AS terrain_supported_pair_count FROM edges GROUP BY source_h3",
    with_=D.EDGES_SQL, doubles=" ".join(f"{n} {n}_available {n}_mean_valid {n}_coverage_fraction" for n in _SOURCE_METRICS),
)
def static_map_edges(spark, d):
    return summaries.static_map_edges(D.nullable_edges(spark, d), "source_h3")


@query(
    """SELECT target_h3, max(net_static_weight) AS maximum, count(net_static_weight) AS valid_count, count(*) AS candidate_count, count(*)-count(net_static_weight) AS missing_count,
    CASE WHEN count(net_static_weight)=0 THEN 'unavailable' WHEN count(*)>count(net_static_weight) THEN 'partial' ELSE 'complete' END AS state FROM edges GROUP BY target_h3""",
    with_=D.EDGES_SQL, doubles="maximum",
)
def overview_maximum(spark, d):
    return summaries.overview_maximum(D.nullable_edges(spark, d), "net_static_weight")


@query(
    """SELECT target_h3, m AS maximum, strongest, contributors, every-candidates AS outside FROM (SELECT target_h3, max(w) AS m, count(w) AS contributors, count(*) AS candidates FROM e GROUP BY target_h3)
    LEFT JOIN (SELECT target_h3, string_agg(source_h3, ',' ORDER BY source_h3) AS strongest FROM (SELECT *, max(w) OVER (PARTITION BY target_h3) AS b FROM e) WHERE w=b GROUP BY target_h3) USING (target_h3), (SELECT count(DISTINCT source_h3) AS every FROM e)""",
    with_=f"{D.EDGES_SQL}, e AS (SELECT *, round(net_static_weight,3) AS w FROM edges)", doubles="maximum",
)
def strongest_sources(spark, d):
    edges = D.nullable_edges(spark, d).select(*PAIR, F.round("net_static_weight", 3).alias("w"))
    return summaries.strongest_sources(_once(spark, edges, "edges"), "w")


@query("SELECT source_h3, count(DISTINCT target_h3) AS visible_targets FROM pairs WHERE weight_terrain>0.1 GROUP BY source_h3 ORDER BY 2 DESC, 1 LIMIT 1", with_=D.PAIRS_SQL)
def top_source(spark, d):
    return summaries.top_source(D.pairs(spark, d).withColumn("shown", F.when(F.col("weight_terrain") > 0.1, F.col("weight_terrain"))), "shown")


@query("SELECT source_type, bin, count(*) AS pairs, count(*)/sum(count(*)) OVER (PARTITION BY source_type) AS fraction FROM (SELECT source_type, CAST(least(greatest(floor(weight_terrain*20),0),19) AS INTEGER) AS bin FROM pairs) GROUP BY source_type, bin", with_=D.PAIRS_SQL, doubles="fraction")
def weight_histogram(spark, d):
    return summaries.histogram(D.pairs(spark, d), "weight_terrain", "source_type")


@query("SELECT CAST(floor(distance_km) AS BIGINT) AS km, count(*) AS pairs, avg(state) AS mean_value FROM samples GROUP BY 1", with_=D.SAMPLES_SQL, doubles="mean_value")
def distance_bins(spark, d):
    return summaries.distance_bins(D.samples(spark, d), "state")


@query("SELECT avg(weight_static_viewability) AS mean, quantile_cont(weight_static_viewability,0.5) AS p50, quantile_cont(weight_static_viewability,0.95) AS p95, count(*) FILTER (weight_static_viewability=0)/count(*) AS zero_fraction FROM pairs", with_=D.PAIRS_SQL, doubles="mean p50 p95 zero_fraction")
def factor_quantiles(spark, d):
    return summaries.factor_quantiles(D.pairs(spark, d), "weight_static_viewability")


@query(
    """SELECT source_h3, target_h3, v, CAST(CASE WHEN v>0 THEN 1+len(list_filter(b, lambda x: x<=v)) ELSE 0 END AS INTEGER) AS class FROM (SELECT source_h3, target_h3, round(greatest(weight_static_viewability-0.02,0),6) AS v FROM pairs),
    (SELECT quantile_cont(v, [0.2,0.4,0.6,0.8]) AS b FROM (SELECT round(greatest(weight_static_viewability-0.02,0),6) AS v FROM pairs) WHERE v>0)""",
    with_=D.PAIRS_SQL, doubles="v",
)
def quantile_classes(spark, d):
    # whole millionths as SQL rounds a double: F.round goes by its decimal digits and differs at halves
    v = S.quantize_weight(F.greatest(F.col("weight_static_viewability") - 0.02, F.lit(0.0))) / F.lit(1e6)
    return summaries.quantile_classes(D.pairs(spark, d).select(*PAIR, v.alias("v")), "v", 5)


@query(
    "SELECT count(*) AS pairs, avg(weight_terrain) AS mean_terrain, avg(weight_static_viewability) AS mean_static, count(*) FILTER (weight_static_viewability>0)/count(*) AS positive_fraction, 1-sum(weight_static_viewability)/sum(weight_terrain) AS canopy_reduction FROM pairs",
    with_=D.PAIRS_SQL, doubles="mean_terrain mean_static positive_fraction canopy_reduction",
)
def report_summary(spark, d):
    return summaries.report_summary(D.pairs(spark, d))


@query(
    """SELECT source_h3, 7 AS requested_rays, count(*) AS completed_rays, count(v) AS valid_rays, count(v)/count(*) AS valid_fraction, avg(v) AS mean, quantile_cont(v,0.5) AS median, min(v) AS min, max(v) AS max, stddev_pop(v) AS std,
    quantile_cont(v,0.1) AS p10, quantile_cont(v,0.25) AS p25, quantile_cont(v,0.75) AS p75 FROM (SELECT source_h3, CASE WHEN value>=0 THEN value END AS v FROM rays) GROUP BY source_h3""",
    with_=D.RAYS_SQL, doubles="valid_fraction mean median min max std p10 p25 p75",
)
def ray_statistics(spark, d):
    r = D.ray_states(spark, d).withColumn("v", F.when(F.col("value") >= 0, F.col("value")))
    return summaries.ray_statistics(r, ["source_h3"], "v", 7)


@query("SELECT cell, count(canopy) AS n, avg(canopy) AS mean, quantile_cont(canopy,0.5) AS median, max(canopy) AS max, min(canopy) AS min, stddev_pop(canopy) AS std FROM pixels GROUP BY cell", with_=D.PIXELS_SQL, doubles="mean median max min std")
def zonal_statistics(spark, d):
    return summaries.zonal_statistics(D.pixels(spark, d), "cell", "canopy")


@query("SELECT cell, arg_max(landcover, n*1000-landcover) AS mode, max(n)/sum(n) AS share, count(*) AS classes FROM (SELECT cell, landcover, count(*) AS n FROM pixels GROUP BY ALL) GROUP BY cell", with_=D.PIXELS_SQL, doubles="share")
def zonal_classes(spark, d):
    return summaries.zonal_classes(D.pixels(spark, d), "cell", "landcover")


@query("SELECT cell, count(*) FILTER (landcover=10)/count(*) AS share_10, count(*) FILTER (landcover=80)/count(*) AS share_80 FROM pixels GROUP BY cell", with_=D.PIXELS_SQL, doubles="share_10 share_80")
def class_shares(spark, d):
    return summaries.class_shares(D.pixels(spark, d), "cell", "landcover", [10, 80])


@query(
    "SELECT source_h3, c AS clear, b AS blocked, u AS unknown, o AS out_of_range, c/nullif(c+b+u,0) AS lower, (c+u)/nullif(c+b+u,0) AS upper FROM (SELECT source_h3, count(*) FILTER (state=1) AS c, count(*) FILTER (state=0) AS b, count(*) FILTER (state=-1) AS u, count(*) FILTER (state=-2) AS o FROM samples GROUP BY source_h3)",
    with_=D.SAMPLES_SQL, doubles="lower upper",
)
def state_counts(spark, d):
    return summaries.state_counts(D.samples(spark, d), ["source_h3"], "state")


@query(
    "SELECT source_h3, count(w) AS valid, count(*)-count(w) AS missing, count(*) FILTER (w=0) AS zero, count(*) FILTER (w>0) AS positive, sum(w) AS total, avg(w) AS mean, CASE WHEN count(*)=count(w) THEN sum(w) END AS full_total FROM (SELECT *, weight_terrain AS w FROM edges) GROUP BY source_h3",
    with_=D.EDGES_SQL, doubles="total mean full_total",
)
def metric_summary(spark, d):
    return summaries.metric_summary(D.nullable_edges(spark, d), "weight_terrain", "source_h3")


@query(
    "SELECT count(*) AS all_pairs, count(*) FILTER (source_type='land') AS land, count(*) FILTER (source_type='land' AND weight_terrain>0) AS visible, count(*) FILTER (source_type='land' AND weight_terrain>=0.1) AS supported, count(*) FILTER (source_type='land' AND weight_terrain>=0.1 AND weight_distance>=0.5) AS near FROM edges",
    with_=D.EDGES_SQL,
)
def filter_funnel(spark, d):
    t = F.col("weight_terrain")
    return summaries.filter_funnel(D.nullable_edges(spark, d), [("land", F.col("source_type") == "land"), ("visible", t > 0), ("supported", t >= 0.1), ("near", F.col("weight_distance") >= 0.5)])


@query(
    """SELECT site, sum(pixels)::BIGINT AS pixels, sum(lower*pixels)/sum(pixels) AS lower, sum(upper*pixels)/sum(pixels) AS upper FROM (SELECT source_h3 AS site, count(*) AS pixels, avg((state=1)::INT) AS lower, avg((state IN (1,-1))::INT) AS upper FROM samples WHERE state<>-2 GROUP BY 1
    UNION ALL SELECT source_h3, count(*), 0, 1 FROM samples WHERE state=-2 GROUP BY 1) GROUP BY site""",
    with_=D.SAMPLES_SQL, doubles="lower upper",
)
def merge_coverage(spark, d):
    s = D.samples(spark, d).withColumnRenamed("source_h3", "site")
    seen = s.where("state <> -2").groupBy("site").agg(F.count("*").alias("pixels"), F.avg((F.col("state") == 1).cast("int")).alias("lower"), F.avg(F.col("state").isin(1, -1).cast("int")).alias("upper"))
    return summaries.merge_coverage(seen, s.where("state = -2").groupBy("site").agg(F.count("*").alias("pixels")))


@query("SELECT quantile_cont(weight_terrain,0.98) AS display_max FROM pairs WHERE weight_terrain>0", with_=D.PAIRS_SQL, doubles="display_max")
def display_maximum(spark, d):
    return summaries.display_maximum(D.pairs(spark, d), "weight_terrain")


@query("SELECT count(*) AS sources, sum(n)::BIGINT AS samples, min(n) AS fewest, quantile_cont(n,0.5) AS median, avg(n) AS mean, max(n) AS most, count(*) FILTER (n<600) AS short FROM (SELECT source_h3, count(*) AS n FROM samples GROUP BY 1)", with_=D.SAMPLES_SQL, doubles="median mean")
def sampling_summary(spark, d):
    return summaries.sampling_summary(D.samples(spark, d), "source_h3", 600)


# -- set operations and SQL -------------------------------------------------


@query(
    """SELECT 'union' AS operation, count(*) AS cells FROM (SELECT cell FROM a UNION SELECT cell FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT cell FROM a EXCEPT SELECT cell FROM b)
    UNION ALL SELECT 'intersection', count(*) FROM (SELECT cell FROM a INTERSECT SELECT cell FROM b)""",
    with_="a AS (SELECT DISTINCT l_suppkey AS cell FROM lineitem WHERE l_quantity>49), b AS (SELECT DISTINCT l_suppkey AS cell FROM lineitem WHERE l_quantity<2)",
)
def cell_sets(spark, d):
    l = D.table(spark, d, "lineitem")
    a, b = (l.where(c).select(F.col("l_suppkey").alias("cell")).distinct() for c in ("l_quantity > 49", "l_quantity < 2"))
    sets = {"union": a.union(b).distinct(), "difference": a.join(b, "cell", "left_anti"), "intersection": a.join(b, "cell", "left_semi")}
    parts = [df.agg(F.count("*").alias("cells")).select(F.lit(n).alias("operation"), "cells") for n, df in sets.items()]
    return parts[0].union(parts[1]).union(parts[2])


_PARTS = {"known": "{l}", "blocked": "1 - {u}", "input": "input_unknown - uncovered", "uncovered": "uncovered"}


@query(
    " UNION ALL ".join(f"SELECT site, '{n}' AS part, sum(({e.format(l='lower', u='upper')})*pixels)/sum(pixels) AS share FROM scores GROUP BY site" for n, e in _PARTS.items()),
    with_=f"{D.SAMPLES_SQL}, scores AS (SELECT target_h3 AS site, source_h3, count(*) AS pixels, avg((state=1)::INT) AS lower, avg((state IN (1,-1,-2))::INT) AS upper, avg((state IN (-1,-2))::INT) AS input_unknown, avg((state=-2)::INT) AS uncovered FROM samples GROUP BY ALL)",
    doubles="share",
)
def weighted_parts(spark, d):
    share = lambda *v: F.avg(F.col("state").isin(*v).cast("int"))
    scores = D.samples(spark, d).groupBy(F.col("target_h3").alias("site"), "source_h3").agg(
        F.count("*").alias("pixels"), share(1).alias("lower"), share(1, -1, -2).alias("upper"), share(-1, -2).alias("input_unknown"), share(-2).alias("uncovered"))
    scores.createOrReplaceTempView("target_scores")
    return spark.sql(" UNION ALL ".join(f"SELECT site, '{n}' AS part, sum(({e.format(l='`lower`', u='`upper`')})*pixels)/sum(pixels) AS share FROM target_scores GROUP BY site" for n, e in _PARTS.items()))


# -- surfaces ---------------------------------------------------------------


@query(
    """SELECT "row", col, CASE WHEN water THEN 0 ELSE greatest(canopy, CASE WHEN "row"%3=0 THEN 12.0 ELSE 0 END) END AS height, (water AND greatest(canopy, CASE WHEN "row"%3=0 THEN 12.0 ELSE 0 END)>0) OR (NOT water AND (col%7=0 OR "row"%5=0)) AS unknown FROM pixels""",
    with_=D.PIXELS_SQL, doubles="height",
)
def above_ground_surface(spark, d):
    p = D.pixels(spark, d).withColumns({"canopy_unknown": F.col("col") % 7 == 0, "building": F.when(F.col("row") % 3 == 0, F.lit(12.0)), "building_unknown": F.col("row") % 5 == 0})
    return surfaces.compose_above_ground(p).select("row", "col", "height", "unknown")


@query('SELECT "row", col, CASE WHEN col<5 THEN 0.0 ELSE coalesce(dem,10000.0) END + CASE WHEN NOT water AND canopy>=2 THEN canopy ELSE 0 END AS surface FROM pixels', with_=D.PIXELS_SQL, doubles="surface")
def canopy_surface(spark, d):
    p = surfaces.flatten_water(D.pixels(spark, d).withColumn("marine", F.col("col") < 5))
    return surfaces.canopy_surface(surfaces.nodata_policy(p, "opaque_barrier")).select("row", "col", "surface")


@query(
    """SELECT p."row", p.col, coalesce(p.dem, CASE WHEN p.col%2=0 THEN 7.0 END, CASE WHEN n.n>=3 THEN n.median END) AS dem FROM pixels p LEFT JOIN (
    SELECT a."row", a.col, count(*) AS n, quantile_cont(b.dem,0.5) AS median FROM pixels a JOIN pixels b ON abs(a."row"-b."row")<=1 AND abs(a.col-b.col)<=1 WHERE a.dem IS NULL AND b.dem IS NOT NULL GROUP BY ALL) n USING ("row",col)""",
    with_=D.PIXELS_SQL, doubles="dem",
)
def endpoint_repair(spark, d):
    p = D.pixels(spark, d).select("row", "col", "dem")
    source = p.where("col % 2 = 0").select("row", "col", F.lit(7.0).alias("value"))
    return surfaces.repair_endpoints(p, source)


@query(
    'SELECT "row", col, CASE WHEN sqrt(pow(col*30.0-600,2)+pow("row"*30.0-300,2))<=120 THEN 0 ELSE canopy END AS canopy FROM pixels', with_=D.PIXELS_SQL, doubles="canopy",
)
def observer_clearance(spark, d):
    p = D.pixels(spark, d).withColumns({"source_h3": F.lit("S1"), "x": F.col("col") * 30.0, "y": F.col("row") * 30.0})
    observer = spark.createDataFrame([("S1", 600.0, 300.0)], "source_h3 string, ox double, oy double")
    return surfaces.clear_observer(p, observer, 120.0).select("row", "col", "canopy")


@query('SELECT CAST(floor("row"/3) AS BIGINT) AS "row", CAST(floor(col/3) AS BIGINT) AS col, max(canopy) AS canopy FROM pixels GROUP BY 1,2', with_=D.PIXELS_SQL, doubles="canopy")
def resample_max(spark, d):
    return surfaces.resample_max(D.pixels(spark, d), 3, "canopy")


@query(
    "SELECT cell, count(*) AS pixels, avg((NOT water)::INT) AS land_fraction, 1-avg((NOT water)::INT) AS water_fraction FROM pixels GROUP BY cell HAVING avg((NOT water)::INT)>=0.8", with_=D.PIXELS_SQL, doubles="land_fraction water_fraction",
)
def land_cells(spark, d):
    return surfaces.land_cells(surfaces.area_fractions(D.pixels(spark, d), "cell", ~F.col("water")), least_land=0.8)


@query("SELECT cell, count(*)*850.0 AS total_water_area_m2, CAST(greatest(1, round_even(count(*)*850.0/900.0, 0)) AS BIGINT) AS equivalent_water_pixel_count FROM pixels WHERE water GROUP BY cell", with_=D.PIXELS_SQL, doubles="total_water_area_m2")
def water_denominators(spark, d):
    return surfaces.water_denominators(D.pixels(spark, d).where("water"), "cell", 850.0, 900.0)


@query(
    'SELECT "row"//2 AS "row", col//2 AS col, max(CASE WHEN canopy>=3 THEN canopy END) AS height, bool_or(canopy<3) AS missing, bool_or(canopy<3) AS unknown, true AS complete FROM pixels GROUP BY 1,2', with_=D.PIXELS_SQL, doubles="height",
)
def building_pixels(spark, d):
    height = surfaces.parse_height(F.when(F.col("canopy") < 3, F.lit(-999.0)).otherwise(F.col("canopy")))
    p = D.pixels(spark, d).select((F.floor(F.col("row") / 2)).alias("row"), (F.floor(F.col("col") / 2)).alias("col"), height.alias("height"))
    return surfaces.building_pixels(p, assume_complete=True)


# -- sampling, grids and rays -----------------------------------------------


@query(
    """SELECT code, (p).r AS "row", (p).c AS col, weight FROM (SELECT code, min(struct_pack(a := away, r := "row", c := col)) AS p, count(*) AS weight FROM (
    SELECT cell AS code, "row", col, s, floor("row"/s) AS rb, floor(col/s) AS cb, pow("row"%s+0.5-s/2.0,2)+pow(col%s+0.5-s/2.0,2) AS away FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY cell)<40 THEN 1 ELSE 3 END AS s FROM pixels)) GROUP BY code, rb, cb)""",
    with_=D.PIXELS_SQL,
)
def stride_design(spark, d):
    return sampling.stride_design(D.pixels(spark, d).select(F.col("cell").alias("code"), "row", "col"), 3, census_below=40)


@query("SELECT s_suppkey, CAST(('0x'||substr(sha256('42|S'||s_suppkey||'|p'),9,8)) AS BIGINT) AS seed FROM supplier")
def stable_seed(spark, d):
    s = D.table(spark, d, "supplier")
    return s.select("s_suppkey", sampling.stable_seed(42, F.concat(F.lit("S"), F.col("s_suppkey")), F.lit("p")).alias("seed"))


@query(Q.PICKS_SQL, with_=Q.DESIGN_SQL, doubles="x y")
def maximin_design(spark, d):
    s = D.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("double")
    boxes = s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("source_h3"), k.alias("x0"), (k * 2).alias("y0"), (k + 10 + k % 7).alias("x1"), (k * 2 + 5 + k % 3).alias("y1"))
    return sampling.maximin_design(sampling.candidate_grid(boxes, 12), 7)


@query(
    f"""SELECT s.cell AS source_h3, c.cell AS target_h3, 2*6371.0088*asin(sqrt(least(pow(sin((radians(c.y)-radians(s.y))/2),2)+cos(radians(s.y))*cos(radians(c.y))*pow(sin((radians(c.x)-radians(s.x))/2),2),1))) AS distance_km
    FROM s JOIN c ON abs(s.i-c.i)<=2 AND abs(s.j-c.j)<=2 WHERE s.cell<>c.cell AND 2*6371.0088*asin(sqrt(least(pow(sin((radians(c.y)-radians(s.y))/2),2)+cos(radians(s.y))*cos(radians(c.y))*pow(sin((radians(c.x)-radians(s.x))/2),2),1)))<=900""",
    with_=", ".join(f"{n} AS (SELECT DISTINCT floor(lat/5)::BIGINT AS i, floor(lon/5)::BIGINT AS j, floor(lat/5)::BIGINT||'_'||floor(lon/5)::BIGINT AS cell, (floor(lat/5)+0.5)*5 AS y, (floor(lon/5)+0.5)*5 AS x FROM {D.points_sql(t)})" for n, t in (("s", "supplier"), ("c", "customer"))),
    doubles="distance_km",
)
def grid_lookup(spark, d):
    grid = grids.SquareGrid(5.0)
    cells = lambda t: D.points(spark, d, t).select(grid.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    return grids.pair_lookup(cells("supplier"), cells("customer"), grid, 2, 900.0)


_CELLS_SQL = ", ".join(f"{n} AS (SELECT DISTINCT floor(lat/5)::BIGINT AS i, floor(lon/5)::BIGINT AS j, floor(lat/5)::BIGINT||'_'||floor(lon/5)::BIGINT AS cell FROM {D.points_sql(t)})" for n, t in (("s", "supplier"), ("c", "customer")))
_ARC = "2*6371.0088*asin(sqrt(least(pow(sin((radians({q})-radians({p}))/2),2)+cos(radians({p}))*cos(radians({q}))*pow(sin(radians({along})/2),2),1)))"
_CENTRES = _ARC.format(p="(s.i*5+2.5)", q="(c.i*5+2.5)", along="((c.j-s.j)*5)")


@query(f"SELECT s.cell AS source_h3, c.cell AS target_h3, {_CENTRES} AS distance_km FROM s, c WHERE s.cell<>c.cell AND {_CENTRES}<=900", with_=_CELLS_SQL, doubles="distance_km")
def grid_pairs(spark, d):
    """As ``grid_lookup`` without its bound of two rings: distance alone decides."""
    grid = grids.SquareGrid(5.0)
    cells = lambda t: D.points(spark, d, t).select(grid.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    return grids.pair_lookup(cells("supplier"), cells("customer"), grid, None, 900.0)


def _gap_sql() -> str:
    """Distance of the boxes of ``s`` and ``c`` from the ends of their facing sides to the nearest points across."""
    along = "greatest(least(((c.j-s.j)*5+720)%360,360-((c.j-s.j)*5+720)%360)-5,0)"
    side = {t: (f"least({t}.i*5,90)", f"least({t}.i*5+5,90)") for t in "sc"}
    arcs = []
    for a, b in ("sc", "cs"):
        for end in side[a]:
            foot = f"degrees(atan2(sin(radians({end})),cos(radians({end}))*cos(radians({along}))))"
            arcs += [_ARC.format(p=end, q=q, along=along) for q in (*side[b], f"greatest({side[b][0]},least({side[b][1]},{foot}))")]
    return f"least({','.join(arcs)})"


@query(f"SELECT s.cell AS source_h3, c.cell AS target_h3, {_CENTRES} AS distance_km FROM s, c WHERE s.cell<>c.cell AND ({_CENTRES}<=900 OR {_gap_sql()}<=900+1e-9)", with_=_CELLS_SQL, doubles="distance_km")
def grid_cutoff(spark, d):
    """As ``grid_pairs``, and pairs whose cells reach into the radius though their centres do not."""
    grid = grids.SquareGrid(5.0)
    cells = lambda t: D.points(spark, d, t).select(grid.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    return grids.pair_lookup(cells("supplier"), cells("customer"), grid, None, 900.0, by_cells=True)


@query(
    f"""SELECT source_h3, target_h3, s.lat AS source_lat, s.lon AS source_lon, t.lat AS target_lat, t.lon AS target_lon FROM pairs LEFT JOIN {D.points_sql('supplier')} s ON source_h3='S'||s.id LEFT JOIN {D.points_sql('supplier')} t ON target_h3='S'||t.id""",
    with_=D.PAIRS_SQL, doubles="source_lat source_lon target_lat target_lon",
)
def attach_centroids(spark, d):
    c = D.points(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("id")).alias("cell"), "lat", "lon")
    return grids.attach_centroids(D.lookup(spark, d).select(*PAIR), c).select(*PAIR, "source_lat", "source_lon", "target_lat", "target_lon")


_SEGMENT = "SELECT p_partkey AS line, (p_partkey*37%997)::DOUBLE AS x0, (p_partkey*61%983)::DOUBLE AS y0, (p_partkey*37%997+p_size-25)::DOUBLE AS x1, (p_partkey*61%983+p_partkey%40-20)::DOUBLE AS y1 FROM part"
_SIDE = "sign(({q}.x1-{q}.x0)*({p}.{y}-{q}.y0)-({q}.y1-{q}.y0)*({p}.{x}-{q}.x0))"


@query(
    f"""SELECT DISTINCT a.line FROM seg a JOIN seg b ON a.line%2=0 AND b.line%2=1 WHERE {_SIDE.format(q='a', p='b', x='x0', y='y0')}*{_SIDE.format(q='a', p='b', x='x1', y='y1')}<=0 AND {_SIDE.format(q='b', p='a', x='x0', y='y0')}*{_SIDE.format(q='b', p='a', x='x1', y='y1')}<=0
    AND greatest(a.x0,a.x1)>=least(b.x0,b.x1) AND greatest(b.x0,b.x1)>=least(a.x0,a.x1) AND greatest(a.y0,a.y1)>=least(b.y0,b.y1) AND greatest(b.y0,b.y1)>=least(a.y0,a.y1)""",
    with_=f"seg AS ({_SEGMENT})",
)
def blocked_lines(spark, d):
    k = F.col("p_partkey")
    seg = D.table(spark, d, "part").select(
        k.alias("line"), (k * 37 % 997).cast("double").alias("x0"), (k * 61 % 983).cast("double").alias("y0"), (k * 37 % 997 + F.col("p_size") - 25).cast("double").alias("x1"), (k * 61 % 983 + k % 40 - 20).cast("double").alias("y1"))
    return grids.blocked_lines(seg.where("line % 2 = 0"), seg.where("line % 2 = 1").drop("line"), 25.0)


def _scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rays between cells of the pixel raster (10 m pixels), and the raster."""
    p = D.pixels(spark, d)
    rows = F.lit((D.table(spark, d, "part").count() - 1) // 50 + 1)
    raster = p.select("row", "col", F.coalesce("dem", F.lit(3.0)).alias("ground"), F.when(F.col("canopy") > 20, F.col("canopy")).otherwise(0.0).alias("lower"), (F.col("canopy") == 7).alias("unknown"), "canopy", "landcover")
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    cell = lambda a, n: F.pmod(k * a, n) * 10 + F.lit(5.0)
    r = o.select(k.alias("ray"), cell(7, 50).alias("ox"), (-cell(3, rows)).alias("oy"), cell(11, 50).alias("tx"), (-cell(5, rows)).alias("ty"), F.lit(120.0).alias("eye"))
    return r, raster


_GEOMETRY = {"x0": 0.0, "y0": 0.0, "pixel": 10.0, "target_height": 1.5, "curve": S.CURVATURE / (2 * S.EARTH_RADIUS_M)}


@query(Q.DIRECT_SQL, with_=Q.SCENE_SQL)
def direct_visibility(spark, d):
    r, raster = _scene(spark, d)
    return rays.direct_visibility(r, raster, radius=350.0, **_GEOMETRY)


@query(Q.ENVELOPE_SQL, with_=Q.SCENE_SQL)
def envelope_visibility(spark, d):
    r, raster = _scene(spark, d)
    return rays.envelope_visibility(r, raster.withColumns({"floor": F.lit(0.0), "ceiling": F.col("lower")}), radius=350.0, **_GEOMETRY)


@query(Q.TRANSMISSION_SQL, with_=Q.SCENE_SQL, doubles="value")
def canopy_transmission(spark, d):
    r, raster = _scene(spark, d)
    score, missing = S.class_obstruction(F.col("canopy"), F.col("landcover"))
    raster = raster.withColumns({"coefficient": score, "missing_class": missing})
    return rays.classified_support(rays.canopy_depth(r, raster, **_GEOMETRY))


@query(Q.HORIZON_STATES_SQL, with_="RECURSIVE " + Q.HORIZON_SQL)
def partial_canopy_visibility(spark, d):
    p = D.pixels(spark, d)
    size = D.table(spark, d, "part").count() // 50
    windows = p.select(F.lit("S1").alias("source_h3"), "row", "col", F.coalesce("dem", F.lit(3.0)).alias("ground"), F.lit(0.0).alias("canopy"), F.lit(False).alias("unknown"))
    observer = spark.createDataFrame([("S1", size // 2, 25, 110.0)], "source_h3 string, o_row long, o_col long, eye double")
    return rays.partial_canopy(windows, observer, pixel=10.0, curve=0.0, radius=200.0, target=1.5)


@query(
    """SELECT source_h3, target_h3, avg(1-o) AS mean_transmission, quantile_cont(1-o,0.1) AS p10_transmission, min(1-o) AS least_transmission, avg(o) AS mean_obstruction, max(o) AS max_obstruction, exp(-0.002*sum(o*distance_km)) AS length_decay,
    sum(distance_km) AS path_length, count(*) AS cells FROM (SELECT *, observer/8.0 AS o FROM samples WHERE NOT distance_km<3) GROUP BY ALL""",
    with_=D.SAMPLES_SQL, doubles="mean_transmission p10_transmission least_transmission mean_obstruction max_obstruction length_decay path_length",
)
def ray_scores(spark, d):
    s = D.samples(spark, d).withColumn("o", F.col("observer") / F.lit(8.0))
    return rays.ray_scores(s, PAIR, "o", "distance_km", skip=F.col("distance_km") < 3)


# -- sources and streaming --------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session; only a session on one machine has a default."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _once(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder: what is read several times is not computed each time."""
    path = _scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT source_h3, target_h3, source_type, distance_km FROM pairs", with_=D.PAIRS_SQL, doubles="distance_km")
def product_round_trip(spark, d):
    from sightline.sources.products import read_product, write_product

    path = _scratch(spark, "lookup")
    write_product(D.lookup(spark, d), path, keys=PAIR, metadata={"grain": "pair"})
    return read_product(spark, path)


@query('SELECT "row", col, canopy AS value FROM pixels WHERE "row">=5 AND "row"<20 AND col>=10 AND col<33', with_=D.PIXELS_SQL, doubles="value")
def tile_window(spark, d):
    from sightline.sources.rasters import pixels_from_tiles, tiles_from_pixels

    path = _scratch(spark, "tiles")
    tiles_from_pixels(D.pixels(spark, d), 16, "canopy").write.parquet(path)
    return pixels_from_tiles(spark.read.parquet(path), 16, (5, 10, 20, 33))


@query(
    f"""SELECT 'S'||(user_id%50) AS source_h3, 'T'||event_type AS target_h3, count(*) AS samples, count(*) FILTER (value>20) AS visible_pairs, coalesce(sum(CAST(floor(({D.decay_sql('floor(abs(value))')})*1e6+0.5) AS BIGINT)) FILTER (value>20),0)::BIGINT AS weight_q_sum,
    bit_or(CASE WHEN value>20 THEN 1::BIGINT << (event_id%7) ELSE 0 END) AS observer_mask FROM events GROUP BY time_bucket(INTERVAL '1 day', ts), 1, 2"""
)
def streaming_kernel(spark, d):
    from sightline.streaming.kernel import run_to_memory, windowed_kernel

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = events.select(
        F.concat(F.lit("S"), F.col("user_id") % 50).alias("source_h3"), F.concat(F.lit("T"), F.col("event_type")).alias("target_h3"), (F.col("event_id") % 7).cast("int").alias("observer"),
        F.floor(F.abs("value")).cast("double").alias("distance_km"), (F.col("value") > 20).alias("clear"), F.col("ts").cast("timestamp").alias("ts"))
    name = "stream_" + _scratch(spark, "k").rsplit("-", 1)[1]
    run_to_memory(windowed_kernel(s, time="ts", late="3650 days", window="1 day"), name)
    return spark.table(name).drop("window")


@query(
    "SELECT count(*) AS row_count, count(DISTINCT source_h3) AS source_h3_count, count(DISTINCT target_h3) AS target_h3_count, count(*) FILTER (weight_static_viewability IS NULL) AS null_weights FROM pairs WHERE source_type='land' AND distance_km<=30",
    with_=D.PAIRS_SQL,
)
def component_build(spark, d):
    from sightline.api import build

    got = build(spark, D.samples(spark, d), _scratch(spark, "build"), ["validate"])
    return got["validate"].select("row_count", "source_h3_count", "target_h3_count", "null_weights")
