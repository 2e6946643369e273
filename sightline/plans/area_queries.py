"""Queries over polygons, hexagons, slices and orders of work, each with SQL that says it another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.scalars import HAVERSINE_RADIUS_KM
from sightline.operators import batches, grids, polygons, sampling, summaries, surfaces
from sightline.plans import domain as D
from sightline.plans.registry import query

# -- polygons -----------------------------------------------------------------

#: Suppliers as disjoint triangles, one in each field of 20 x 20, corners against the clock.
TRIANGLES_SQL = """tri AS (SELECT s_suppkey AS polygon, x AS x1, y AS y1, x+5+s_suppkey%9 AS x2, y+s_suppkey%4 AS y2, x+s_suppkey%5 AS x3, y+6+s_suppkey%11 AS y3
  FROM (SELECT s_suppkey, (s_suppkey%10*20+1+s_suppkey%3)::DOUBLE AS x, (s_suppkey//10%10*20+1+s_suppkey%2)::DOUBLE AS y FROM supplier WHERE s_suppkey<100))"""
_EDGE = 4.0
#: Area of a triangle in a cell: each side's signed integral over the cell's columns of its height, held to the cell's rows.
_OVERLAY_SQL = f"""{TRIANGLES_SQL},
side AS (SELECT polygon, unnest([{{'px':x1,'py':y1,'qx':x2,'qy':y2}},{{'px':x2,'py':y2,'qx':x3,'qy':y3}},{{'px':x3,'py':y3,'qx':x1,'qy':y1}}]) AS s FROM tri),
cells AS (SELECT polygon, unnest(range(floor(least(y1,y2,y3)/{_EDGE})::BIGINT, ceil(greatest(y1,y2,y3)/{_EDGE})::BIGINT)) AS "row", c AS col FROM (
  SELECT *, unnest(range(floor(least(x1,x2,x3)/{_EDGE})::BIGINT, ceil(greatest(x1,x2,x3)/{_EDGE})::BIGINT)) AS c FROM tri)),
cut AS (SELECT polygon, "row", col, "row"*{_EDGE}::DOUBLE AS low, least(greatest(s.px,col*{_EDGE}),(col+1)*{_EDGE})::DOUBLE AS u, least(greatest(s.qx,col*{_EDGE}),(col+1)*{_EDGE})::DOUBLE AS v, s.px AS px, s.py AS py, (s.qy-s.py)/(s.qx-s.px) AS m
  FROM cells JOIN side USING (polygon) WHERE s.px<>s.qx),
part AS (SELECT *, py+(u-px)*m-low AS h, py+(v-px)*m-low AS k FROM cut),
overlay AS (SELECT polygon, "row", col, -sum(CASE WHEN m=0 THEN least(greatest(h,0),{_EDGE})*(v-u)
  ELSE ((CASE WHEN k<0 THEN 0 WHEN k<={_EDGE} THEN k*k/2 ELSE {_EDGE}*(k-{_EDGE}/2) END)-(CASE WHEN h<0 THEN 0 WHEN h<={_EDGE} THEN h*h/2 ELSE {_EDGE}*(h-{_EDGE}/2) END))/m END) AS area FROM part GROUP BY ALL)"""


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 10 * 20 + 1 + k % 3).cast("double"), (F.floor(k / 10) % 10 * 20 + 1 + k % 2).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x, y), corner(x + 5 + k % 9, y + k % 4), corner(x + k % 5, y + 6 + k % 11))
    return D.table(spark, d, "supplier").where("s_suppkey < 100").select(k.alias("polygon"), ring.alias("ring"))


@query('SELECT polygon, "row", col, area FROM overlay WHERE area>1e-6', with_=_OVERLAY_SQL, doubles="area")
def polygon_overlay(spark, d):
    return polygons.overlay(_triangles(spark, d), _EDGE).where("area > 1e-6")


@query(
    f"""SELECT "row", col, least(greatest(coalesce(area,0)/{_EDGE * _EDGE},0),1) AS land, 1-least(greatest(coalesce(area,0)/{_EDGE * _EDGE},0),1) AS water FROM (SELECT unnest(range(0,30)) AS "row") CROSS JOIN (SELECT unnest(range(2,40)) AS col)
    LEFT JOIN (SELECT "row", col, sum(area) AS area FROM overlay GROUP BY ALL) USING ("row", col)""",
    with_=_OVERLAY_SQL, doubles="land water",
)
def domain_shares(spark, d):
    return polygons.domain_shares(_triangles(spark, d), _EDGE, (0, 2, 30, 40))


_UNIT = "CAST(('0x'||substr(sha256('42|'||polygon||'|'||attempt||'|{axis}'),9,8)) AS BIGINT)/4294967296.0::DOUBLE"
_SIDE = "((x{q}-x{p})*(y-y{p})-(y{q}-y{p})*(x-x{p})>0)"


@query(
    f"""SELECT polygon, CAST(i AS INTEGER) AS sample_index, x, y FROM (SELECT *, row_number() OVER (PARTITION BY polygon ORDER BY attempt)-1 AS i FROM tried
    WHERE {_SIDE.format(p=1, q=2)} AND {_SIDE.format(p=2, q=3)} AND {_SIDE.format(p=3, q=1)}) WHERE i<5""",
    with_=f"""{TRIANGLES_SQL},
tried AS (SELECT *, least(x1,x2,x3)+{_UNIT.format(axis='x')}*(greatest(x1,x2,x3)-least(x1,x2,x3)) AS x, least(y1,y2,y3)+{_UNIT.format(axis='y')}*(greatest(y1,y2,y3)-least(y1,y2,y3)) AS y FROM (SELECT *, unnest(range(0,60)) AS attempt FROM tri))""",
    doubles="x y",
)
def random_points(spark, d):
    return polygons.random_points(_triangles(spark, d), 5, attempts=60)


_GRID_SQL = "grid AS (SELECT 'S'||s_suppkey AS source_h3, s_suppkey%40+30.0::DOUBLE*i/13 AS x, s_suppkey%7+30.0::DOUBLE*j/13 AS y FROM supplier CROSS JOIN (SELECT unnest(range(1,13)) AS i) CROSS JOIN (SELECT unnest(range(1,13)) AS j))"


@query('SELECT source_h3, x, y FROM grid WHERE NOT EXISTS (SELECT 1 FROM pixels WHERE canopy>=20 AND "row"=floor(y/2) AND col=floor(x/2))', with_=f"{D.PIXELS_SQL}, {_GRID_SQL}", doubles="x y")
def outdoor_candidates(spark, d):
    s = D.table(spark, d, "supplier")
    x, y = (F.col("s_suppkey") % 40).cast("double"), (F.col("s_suppkey") % 7).cast("double")
    boxes = s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("source_h3"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 30).alias("y1"))
    return polygons.outdoor_cells(sampling.candidate_grid(boxes, 12), D.pixels(spark, d).where("canopy >= 20"), 2.0).select("source_h3", "x", "y")


# -- hexagons -----------------------------------------------------------------

_HEX = 250.0


def _hex_sql(table: str, name: str) -> str:
    """Cells of points as the nearest of the centres around."""
    return f"""{name} AS (SELECT id, arg_min({{'q':q,'r':r}}, pow({_HEX}*sqrt(3.0)*(q+r/2.0)-x,2)+pow({_HEX}*1.5*r-y,2)) AS h FROM (
  SELECT id, x, y, floor((x*sqrt(3.0)/3-y/3)/{_HEX})::BIGINT+i AS q, floor(y*2/3/{_HEX})::BIGINT+j AS r FROM (SELECT id, {HAVERSINE_RADIUS_KM}*radians(lon) AS x, {HAVERSINE_RADIUS_KM}*sin(radians(lat)) AS y FROM {D.points_sql(table)})
  CROSS JOIN (SELECT unnest(range(-1,3)) AS i) CROSS JOIN (SELECT unnest(range(-1,3)) AS j)) GROUP BY id)"""


def _hex_points(spark: SparkSession, d: str, table: str) -> DataFrame:
    return D.points(spark, d, table).select("id", grids.HexGrid(_HEX).cell(F.col("lat"), F.col("lon")).alias("cell"))


@query(
    f"""SELECT id, h.q||'_'||h.r AS cell, degrees(asin(least(greatest({_HEX}*1.5*h.r/{HAVERSINE_RADIUS_KM},-1),1))) AS lat, degrees({_HEX}*sqrt(3.0)*(h.q+h.r/2.0)/{HAVERSINE_RADIUS_KM}) AS lon FROM c""",
    with_=_hex_sql("customer", "c"), doubles="lat lon",
)
def hex_cells(spark, d):
    lat, lon = grids.HexGrid(_HEX).center(F.col("cell"))
    return _hex_points(spark, d, "customer").select("id", "cell", lat.alias("lat"), lon.alias("lon"))


_STEPS = "greatest(abs(a.q-b.q),abs(a.r-b.r),abs(a.q+a.r-b.q-b.r))"


@query(
    f"SELECT a.q||'_'||a.r AS source_h3, b.q||'_'||b.r AS target_h3, {_STEPS} AS steps FROM (SELECT DISTINCT h.q AS q, h.r AS r FROM s) a JOIN (SELECT DISTINCT h.q AS q, h.r AS r FROM c) b ON {_STEPS}<=3",
    with_=f"{_hex_sql('supplier', 's')}, {_hex_sql('customer', 'c')}",
)
def hex_disks(spark, d):
    grid = grids.HexGrid(_HEX)
    near = _hex_points(spark, d, "supplier").select(F.col("cell").alias("source_h3")).distinct().withColumn("target_h3", F.explode(grid.disk(F.col("source_h3"), 3)))
    near = near.join(_hex_points(spark, d, "customer").select(F.col("cell").alias("target_h3")), "target_h3", "left_semi")
    return near.select("source_h3", "target_h3", grid.distance(F.col("source_h3"), F.col("target_h3")).alias("steps"))


# -- slices, chunks and orders --------------------------------------------------


@query(
    "SELECT source_h3, count(*) AS pairs FROM (SELECT *, dense_rank() OVER (ORDER BY source_h3) AS place FROM pairs) WHERE place BETWEEN 4 AND 13 GROUP BY source_h3", with_=D.PAIRS_SQL,
)
def source_slice(spark, d):
    return batches.source_slice(D.lookup(spark, d), start=3, limit=10).groupBy("source_h3").agg(F.count("*").alias("pairs"))


@query(
    "SELECT source_h3, target_h3, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY source_h3 ORDER BY distance_km, target_h3) AS place FROM pairs) WHERE place<=3", with_=D.PAIRS_SQL, doubles="distance_km",
)
def limit_per_source(spark, d):
    return batches.limit_per_source(D.lookup(spark, d), 3, [F.col("distance_km"), F.col("target_h3")]).select(*D.PAIR, "distance_km")


_ORDERS = {"sequential": "source_h3", "spatial_sort": "lon, lat, source_h3", "parent": "parent, source_h3", "costly_first": "cost DESC, source_h3"}


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS strategy, source_h3, i AS index, i//7 AS chunk FROM (SELECT source_h3, row_number() OVER (ORDER BY {o})-1 AS i FROM src)" for n, o in _ORDERS.items()),
    with_=f"src AS (SELECT 'S'||id AS source_h3, lat, lon, floor(lat/20)::BIGINT||'_'||floor(lon/20)::BIGINT AS parent, id*7%13 AS cost FROM {D.points_sql('supplier')})",
)
def chunk_orders(spark, d):
    src = D.points(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("id")).alias("source_h3"), "lat", "lon", "id")
    parts = [
        batches.chunk_ids(src, 7, n, cost=F.col("id") * 7 % 13, parent=grids.SquareGrid(20.0).cell(F.col("lat"), F.col("lon"))).select(F.lit(n).alias("strategy"), "source_h3", "index", "chunk")
        for n in _ORDERS
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# -- surfaces -------------------------------------------------------------------


@query(
    """SELECT count(*) AS pair_count, count(*) FILTER (l>joint_fraction+1e-6) AS unweighted_excess_pair_count, count(*) FILTER (r-weight_terrain>1e-6) AS substantial_excess_pair_count, count(*) FILTER (weight_terrain>0) AS bare_visible_pair_count,
    count(*) FILTER (least(r,weight_terrain)>0) AS canopy_visible_pair_count, count(*) FILTER (r-weight_terrain>0) AS excess_pair_count, greatest(max(r-weight_terrain),0) AS largest_excess
    FROM (SELECT *, weight_canopy_los*(1+CAST(substr(target_h3,2) AS BIGINT)%5/4.0::DOUBLE) AS r, joint_fraction*(1+(CAST(substr(target_h3,2) AS BIGINT)%3-1)/8.0::DOUBLE) AS l FROM pairs)""",
    with_=D.PAIRS_SQL, doubles="largest_excess",
)
def dual_surface_metrics(spark, d):
    k = F.substring("target_h3", 2, 9).cast("long")
    p = D.pairs(spark, d).withColumns({"weight_canopy_los_raw": F.col("weight_canopy_los") * (1 + k % 5 / F.lit(4.0)), "bare_los_fraction": F.col("joint_fraction"), "canopy_los_fraction": F.col("joint_fraction") * (1 + (k % 3 - 1) / F.lit(8.0))})
    return summaries.dual_surface_metrics(p.withColumn("weight_canopy_los", F.least("weight_canopy_los_raw", "weight_terrain")))


@query(
    """SELECT a."row", a.col, sum(b.dem*exp(-0.5*(pow(a."row"-b."row",2)+pow(a.col-b.col,2))/1.44))/sum(exp(-0.5*(pow(a."row"-b."row",2)+pow(a.col-b.col,2))/1.44)) AS dem
    FROM pixels a JOIN pixels b ON abs(a."row"-b."row")<=4 AND abs(a.col-b.col)<=4 WHERE a.dem IS NOT NULL AND b.dem IS NOT NULL GROUP BY ALL""",
    with_=D.PIXELS_SQL, doubles="dem",
)
def smooth_inside(spark, d):
    return surfaces.smooth_inside(D.pixels(spark, d), "dem", 1.2)
