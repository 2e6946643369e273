"""Derived domain: the engine's tables made from the driver's relational tables.

A line item is one observer x target sample: supplier = source cell, nation of the order's
customer = target cell, line number = observer, order = pixel, quantity = distance in
kilometres, return flag and line status = line-of-sight states.  ``*_SQL`` say the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators import kernels as K

DECAY = S.Decay()
PAIR = ["source_h3", "target_h3"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Lines that one task sorts and aggregates; beyond the tasks that a session is sure to use, tables are dealt out by this number.
LINES_PER_TASK = 500_000
#: How much longer tasks may become before they are more than Spark's shuffle writer serves without holding rows.
STRETCH = 4


def _deal(df: DataFrame, rows: int, *by: Column | str) -> DataFrame:
    """``df`` in as many partitions by ``by`` as ``rows`` need; unchanged where a task a core is enough.

    A session's partitions are no measure: they may be many, and adaptive execution then merges them by bytes, down to a task a core.
    Up to a number of partitions a shuffle's writer passes rows straight to their files; beyond it, it holds those of a whole file split.
    """
    parts, spark = -(-rows // LINES_PER_TASK), df.sparkSession
    direct = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if parts > direct:
        parts = max(direct, -(-rows // (STRETCH * LINES_PER_TASK)))
    sure = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by) if parts > sure else df


def _meet(left: DataFrame, right: DataFrame, rows: int, left_key: str, right_key: str) -> DataFrame:
    """Join on one key; long tables are dealt by it and merged, as a broadcast would be chosen by the size of packed files."""
    dealt = _deal(right, rows, right_key)
    if dealt is not right:
        left, right = _deal(left, rows, left_key), dealt.hint("merge")
    return left.join(right, F.col(left_key) == F.col(right_key))


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Samples by the tables' own keys and their number, partitioned by pixel (the order): short rows, dealt to as many tasks as there are lines for."""
    l, o, c = (table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    clear = F.col("l_returnflag") != "A"
    state = F.when(F.col("l_quantity") > 30, -2).when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1)
    lines = l.select(
        "l_orderkey", F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("observer"), F.col("l_quantity").cast("double").alias("distance_km"),
        state.alias("state"), clear.alias("bare"), (clear & (F.col("l_linestatus") == "O")).alias("canopy"),
    )
    rows = l.count()
    placed = _meet(o, c, o.count(), "o_custkey", "c_custkey").select("o_orderkey", F.col("c_nationkey").alias("nation"))
    return _meet(lines, placed, rows, "l_orderkey", "o_orderkey").withColumnRenamed("l_orderkey", "pixel").drop("o_orderkey"), rows


def _by_pair(spark: SparkSession, folder: str) -> GroupedData:
    """Samples grouped by pair (and ``supplier``, which the source names), long tables dealt by pair to as many tasks as there are lines for.

    The deal is by the pair's names, so later groups by both names need no further shuffle. A pair's
    lines stream through one task, which holds a row for each of its pairs.
    """
    lines, rows = _lines(spark, folder)
    source, target, _ = _named()
    return _deal(lines, rows, source, target).withColumns({"source_h3": source, "target_h3": target}).groupBy(*PAIR, "supplier")


def _named() -> list[Column]:
    """Ids of source and target, and the source's role, from the tables' keys."""
    role = F.when(F.col("supplier") % 2 == 0, "land").otherwise("water")
    return [F.concat(F.lit("S"), F.col("supplier")), F.concat(F.lit("T"), F.col("nation")), role.alias("source_type")]


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """All samples: keys, role, observer, pixel, distance, ray state and clear flags."""
    source, target, role = _named()
    fine = F.concat(F.lit("P"), F.col("part")).alias("fine_h3")
    return _lines(spark, folder)[0].select(source.alias("source_h3"), target.alias("target_h3"), fine, role, "observer", "pixel", "distance_km", "state", "bare", "canopy", "part")


LOGISTIC_SQL = "(1/(1+exp(({d}-9.0)/2.7)))/(1/(1+exp(-9.0/2.7)))"


def decay_sql(d: str) -> str:
    """The production curve of a distance, with cutoff, for DuckDB."""
    return f"CASE WHEN {d}<=30 THEN least(greatest({LOGISTIC_SQL.format(d=d)},0),1) ELSE 0 END"


SAMPLES_SQL = f"""samples AS (
  SELECT 'S'||l_suppkey AS source_h3, 'T'||c_nationkey AS target_h3, 'P'||l_partkey AS fine_h3, CASE WHEN l_suppkey%2=0 THEN 'land' ELSE 'water' END AS source_type,
    l_linenumber AS observer, l_orderkey AS pixel, CAST(l_quantity AS DOUBLE) AS distance_km, l_partkey AS part,
    CASE WHEN l_quantity>30 THEN -2 WHEN l_returnflag='R' THEN 1 WHEN l_returnflag='A' THEN 0 ELSE -1 END AS state,
    l_returnflag<>'A' AS bare, l_returnflag<>'A' AND l_linestatus='O' AS canopy,
    CAST(floor(({decay_sql('CAST(l_quantity AS DOUBLE)')})*1e6+0.5) AS BIGINT) AS wq
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey)"""


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The pair universe: every source x target pair with samples, its role and nearest distance."""
    return _by_pair(spark, folder).agg(F.min("distance_km").alias("distance_km")).select(*PAIR, _named()[2], "distance_km")


def kernel(spark: SparkSession, folder: str, surface: str = "bare") -> DataFrame:
    """Joint and distance-weighted fraction per pair on the bare or canopy surface."""
    return K.water_kernel(samples(spark, folder), F.col(surface), DECAY.weight("distance_km"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with every factor, from one pass over the samples."""
    q = S.quantize_weight(DECAY.weight("distance_km"))
    one = lambda c: F.sum(F.when(F.col(c), q).otherwise(0))
    sums = _by_pair(spark, folder).agg(
        F.count("*").alias("n"), F.count_if("bare").alias("j"), one("bare").alias("kb"), one("canopy").alias("kc"), F.min("distance_km").alias("distance_km"))
    whole = F.col("n") * F.lit(float(S.WEIGHT_SCALE))
    out = sums.select(
        *PAIR, _named()[2], "distance_km", S.ratio(F.col("j"), F.col("n")).alias("joint_fraction"), S.ratio(F.col("kb"), whole).alias("weight_terrain"),
        S.ratio(F.least("kc", "kb"), whole).alias("weight_canopy_los"), S.conditional_canopy(F.col("kb").cast("double"), F.col("kc").cast("double")).alias("weight_vegetation"),
    )
    return out.withColumns({"weight_distance": DECAY.weight("distance_km"), "weight_static_viewability": S.static_weight(F.col("weight_terrain"), F.col("weight_vegetation"))})


PAIRS_SQL = f"""{SAMPLES_SQL},
sums AS (SELECT source_h3, target_h3, source_type, count(*) AS n, count(*) FILTER (bare) AS j, coalesce(sum(wq) FILTER (bare),0)::BIGINT AS kb, coalesce(sum(wq) FILTER (canopy),0)::BIGINT AS kc,
  min(distance_km) AS distance_km FROM samples GROUP BY ALL),
factors AS (SELECT source_h3, target_h3, source_type, distance_km, j/n AS joint_fraction, kb/(n*1e6) AS weight_terrain, least(kb,kc)/(n*1e6) AS weight_canopy_los,
  CASE WHEN kb>0 THEN least(kb,kc)/kb::DOUBLE ELSE 1.0 END AS weight_vegetation, {decay_sql('distance_km')} AS weight_distance FROM sums),
pairs AS (SELECT *, least(greatest(weight_terrain*weight_vegetation,0),1) AS weight_static_viewability FROM factors)"""


def nullable_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose factors are missing on some keys, for the operators that must not read missing as zero."""
    k = F.substring("source_h3", 2, 9).cast("long") * 31 + F.substring("target_h3", 2, 9).cast("long")
    p = pairs(spark, folder)
    return p.select(
        *PAIR, "source_type", "weight_distance", F.when(k % 7 != 0, F.col("weight_terrain")).alias("weight_terrain"), F.when(k % 5 != 0, F.col("weight_vegetation")).alias("weight_vegetation"),
        F.when(k % 11 != 0, F.col("weight_static_viewability")).alias("net_static_weight"),
    )


EDGES_SQL = f"""{PAIRS_SQL},
keyed AS (SELECT *, CAST(substr(source_h3,2) AS BIGINT)*31+CAST(substr(target_h3,2) AS BIGINT) AS k FROM pairs),
edges AS (SELECT source_h3, target_h3, source_type, weight_distance, CASE WHEN k%7<>0 THEN weight_terrain END AS weight_terrain, CASE WHEN k%5<>0 THEN weight_vegetation END AS weight_vegetation,
  CASE WHEN k%11<>0 THEN weight_static_viewability END AS net_static_weight FROM keyed)"""


def ray_states(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as classified rays: value (transmission, -1 unknown, -2 out of range), bare, joint, decay and weight."""
    s = samples(spark, folder)
    value = F.when(F.col("state") == 1, F.col("observer") / F.lit(8.0)).otherwise(F.col("state").cast("double"))
    bare = F.when(F.col("state") == -2, -2).when(F.col("state") == 0, 0).otherwise(1)
    decay = S.quantize_weight(DECAY.weight("distance_km")) / F.lit(1e6)
    return s.select(*PAIR, "fine_h3", "state", value.alias("value"), bare.alias("bare"), value.alias("joint"), decay.alias("decay"), (F.lit(1) + F.col("part") % 3).alias("weight"), "observer")


RAYS_SQL = f"""{SAMPLES_SQL},
rays AS (SELECT source_h3, target_h3, fine_h3, state, observer, CASE WHEN state=1 THEN observer/8.0::DOUBLE ELSE state::DOUBLE END AS value,
  CASE WHEN state=-2 THEN -2 WHEN state=0 THEN 0 ELSE 1 END AS bare, wq/1e6 AS decay, 1+part%3 AS weight FROM samples)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as pixels of a 50-column raster: elevation, canopy, land-cover class, water."""
    p, k = table(spark, folder, "part"), F.col("p_partkey")
    codes = (10, 20, 30, 40, 50, 60, 80, 90)
    return p.select(
        F.floor(k / 50).cast("long").alias("row"), (k % 50).cast("long").alias("col"), F.when(k % 13 != 0, F.floor("p_retailprice") % 97).cast("double").alias("dem"),
        (F.col("p_size") % 25).cast("double").alias("canopy"), F.get(F.array(*[F.lit(c) for c in codes]), (F.col("p_size") % 8).cast("int")).alias("landcover"),
        (F.col("p_size") % 8 == 6).alias("water"), F.concat(F.lit("C"), F.floor(k / 500).cast("long") * 10 + F.floor((k % 50) / 5).cast("long")).alias("cell"), F.col("p_retailprice").alias("price"),
    )


PIXELS_SQL = """pixels AS (SELECT CAST(floor(p_partkey/50) AS BIGINT) AS "row", CAST(p_partkey%50 AS BIGINT) AS col,
  CASE WHEN p_partkey%13<>0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT)%97 AS DOUBLE) END AS dem, CAST(p_size%25 AS DOUBLE) AS canopy,
  [10,20,30,40,50,60,80,90][p_size%8+1] AS landcover, p_size%8=6 AS water,
  'C'||(CAST(floor(p_partkey/500) AS BIGINT)*10+CAST(floor((p_partkey%50)/5) AS BIGINT)) AS cell, p_retailprice AS price FROM part)"""


def points(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Customers or suppliers as points in degrees."""
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    k = F.col(key)
    return table(spark, folder, name).select(k.alias("id"), (((k * 37) % 1200) / 10 - 60).alias("lat"), (((k * 91) % 3600) / 10 - 180).alias("lon"))


def points_sql(name: str) -> str:
    """The same points for DuckDB."""
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
    return f"(SELECT {key} AS id, (({key}*37)%1200)/10.0::DOUBLE-60 AS lat, (({key}*91)%3600)/10.0::DOUBLE-180 AS lon FROM {name})"
