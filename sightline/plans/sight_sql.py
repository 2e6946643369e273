"""SQL for DuckDB of the line-of-sight and sampling queries, stated independently of the engine's operators.

Crossings of a ray with the grid lines are listed and sorted; a carried horizon is a recursion over
rings; a maximin design is a chain of picks.
"""

from __future__ import annotations

from sightline.functions import scalars as S
from sightline.plans import domain as D

#: Drop of the line of sight per squared metre.
BEND = S.CURVATURE / (2 * S.EARTH_RADIUS_M)

_BAND = "CASE WHEN canopy>=15 THEN 1.0 WHEN canopy>=5 THEN 0.65 WHEN canopy>=2 THEN 0.25 ELSE 0.0 END"
_KNOWN = f"landcover IN ({','.join(map(str, S.CLASS_WEIGHTS))})"
_WEIGHT = [f"CASE landcover {' '.join(f'WHEN {c} THEN {w[k]}' for c, w in S.CLASS_WEIGHTS.items())} ELSE 0 END" for k in (0, 1)]


def _lines(a: str, b: str) -> str:
    """Distances at which a ray from ``a`` to ``b`` (in cells) meets the grid lines of one direction."""
    return f"""CASE WHEN {a}={b} THEN [] ELSE list_transform(range(ceil(least({a},{b}))::BIGINT, floor(greatest({a},{b}))::BIGINT+1),
      lambda k: least(greatest((k-{a})/({b}-{a})*d, 0.0), d)) END"""


SCENE_SQL = f"""{D.PIXELS_SQL},
raster AS (SELECT "row", col, coalesce(dem,3.0)::DOUBLE AS ground, CASE WHEN canopy>20 THEN canopy ELSE 0 END::DOUBLE AS lower, canopy=7 AS unknown, canopy, landcover FROM pixels),
ray AS (SELECT o_orderkey AS ray, ((o_orderkey*7)%50*10+5)::DOUBLE AS ox, -((o_orderkey*3)%k*10+5)::DOUBLE AS oy, ((o_orderkey*11)%50*10+5)::DOUBLE AS tx, -((o_orderkey*5)%k*10+5)::DOUBLE AS ty, 120::DOUBLE AS eye
  FROM orders, (SELECT (count(*)-1)//50+1 AS k FROM part)),
measured AS (SELECT *, sqrt(pow(tx-ox,2)+pow(ty-oy,2)) AS d, ox/10 AS fx, tx/10 AS gx, -oy/10 AS fy, -ty/10 AS gy FROM ray),
placed AS (SELECT m.*, t.unknown AS t_unknown, (t.ground+1.5-eye-{BEND!r}::DOUBLE*d*d)/nullif(d,0) AS slope FROM measured m LEFT JOIN raster t ON t."row"=floor(gy) AND t.col=floor(gx)),
cut AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, d], {_lines('fx', 'gx')}, {_lines('fy', 'gy')}))) AS cuts FROM placed WHERE d>0),
piece AS (SELECT *, cuts[i] AS enter, cuts[i+1] AS leave FROM (SELECT *, unnest(range(1, len(cuts))) AS i FROM cut)),
crossed AS (SELECT *, floor((ox+(tx-ox)*((enter+leave)/2/d))/10)::BIGINT AS c, floor((-oy-(ty-oy)*((enter+leave)/2/d))/10)::BIGINT AS r FROM piece WHERE leave-enter>1e-9),
met AS (SELECT x.*, g.ground, g.lower, g.unknown, g.canopy, g.landcover, x.r=floor(gy) AND x.c=floor(gx) AS at_target FROM crossed x JOIN raster g ON g."row"=x.r AND g.col=x.c WHERE NOT (x.r=floor(fy) AND x.c=floor(fx)))"""


def _states(lower: str) -> str:
    """``ray, state`` of all rays over an obstacle height, out of range beyond 350 m."""
    lowest = f"least(leave, greatest(enter, -slope/(2*{BEND!r}::DOUBLE)))"
    return f"""(SELECT p.ray, CASE WHEN d>350 THEN -2 WHEN coalesce(blocked,false) THEN 0 WHEN coalesce(uncertain,false) OR coalesce(t_unknown,false) THEN -1 ELSE 1 END::INTEGER AS state FROM placed p LEFT JOIN (
      SELECT ray, bool_or(NOT at_target AND ground+{lower}-eye-slope*low-{BEND!r}::DOUBLE*low*low>1e-7) AS blocked, bool_or(unknown) AS uncertain FROM (SELECT *, {lowest} AS low FROM met WHERE d<=350) GROUP BY ray) USING (ray))"""


DIRECT_SQL = f"SELECT * FROM {_states('lower')}"
ENVELOPE_SQL = f"""SELECT ray, CASE WHEN a.state=-2 THEN -2 WHEN a.state=0 THEN 0 WHEN b.state=1 THEN 1 ELSE -1 END::INTEGER AS state FROM {_states('0')} a JOIN {_states('lower')} b USING (ray)"""

TRANSMISSION_SQL = f"""SELECT p.ray, CASE WHEN coalesce(missing,false) OR d>0 AND coalesce(t_unknown,false) THEN -1 ELSE exp(-0.002*coalesce(depth,0)) END AS value FROM placed p LEFT JOIN (
  SELECT ray, sum(CASE WHEN touched AND NOT wrong THEN coefficient*span ELSE 0 END) AS depth, bool_or(unknown OR touched AND wrong) AS missing FROM (
    SELECT *, NOT unknown AND canopy>0 AND span>0 AS touched, NOT {_KNOWN} OR landcover=80 AND canopy>0 AS wrong, CASE WHEN {_KNOWN} THEN greatest({_BAND}*{_WEIGHT[0]}, {_WEIGHT[1]}) ELSE 0 END AS coefficient FROM (
      SELECT *, CASE WHEN q<=0 THEN 0 ELSE greatest(0, least(leave,(-slope+sqrt(q))/(2*{BEND!r}::DOUBLE))-greatest(enter,(-slope-sqrt(q))/(2*{BEND!r}::DOUBLE))) END AS span FROM (
        SELECT *, slope*slope-4*{BEND!r}::DOUBLE*(eye-(ground+canopy)) AS q FROM met WHERE NOT at_target))) GROUP BY ray) USING (ray)"""

#: A horizon carried outward from one observer, quadrant by quadrant, ring by ring.
HORIZON_SQL = f"""{D.PIXELS_SQL},
o AS (SELECT (count(*)//50)//2 AS o_row, 25 AS o_col FROM part),
box AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pixels),
grid AS (SELECT y, x, coalesce(p.ground, 0)::DOUBLE AS ground, p.ground IS NULL AS unknown FROM (SELECT unnest(range(r0, r1+1)) AS y FROM box) CROSS JOIN (SELECT unnest(range(c0, c1+1)) AS x FROM box)
  LEFT JOIN (SELECT "row", col, coalesce(dem,3.0) AS ground FROM pixels) p ON p."row"=y AND p.col=x),
cell AS (SELECT dy, dx, abs(y-o_row) AS a, abs(x-o_col) AS b, greatest(abs(y-o_row), abs(x-o_col)) AS ring, y, x, ground-110 AS z, unknown FROM grid, o, (VALUES (-1),(1)) q(dy), (VALUES (-1),(1)) w(dx) WHERE (y-o_row)*dy>=0 AND (x-o_col)*dx>=0),
walk AS (SELECT dy, dx, a, b, ring, y, x, z, z AS top, unknown AS blind, unknown, NULL::DOUBLE AS seen, false AS carried FROM cell WHERE ring<2 UNION ALL
  SELECT c.dy, c.dx, c.a, c.b, c.ring, c.y, c.x, c.z, greatest(c.z, sum(p.top*(CASE WHEN least(p.a,p.b)=least(c.a,c.b)-1 OR c.a=c.b THEN least(c.a,c.b) ELSE c.ring-least(c.a,c.b) END))/(c.ring-1)),
    c.unknown OR bool_or(p.blind), c.unknown, sum(p.top*(CASE WHEN least(p.a,p.b)=least(c.a,c.b)-1 OR c.a=c.b THEN least(c.a,c.b) ELSE c.ring-least(c.a,c.b) END))/(c.ring-1), bool_or(p.blind)
  FROM walk p JOIN cell c ON c.dy=p.dy AND c.dx=p.dx AND c.ring=p.ring+1 AND c.ring>1 AND (
    c.a=c.b AND p.a=p.b OR c.a>c.b AND p.a=c.a-1 AND p.b BETWEEN c.b-1 AND c.b OR c.b>c.a AND p.b=c.b-1 AND p.a BETWEEN c.a-1 AND c.a)
  GROUP BY c.dy, c.dx, c.a, c.b, c.ring, c.y, c.x, c.z, c.unknown)"""
HORIZON_STATES_SQL = """SELECT DISTINCT 'S1' AS source_h3, "row", col, CASE WHEN (a*a+b*b)*100.0>40000 THEN 0 WHEN unknown THEN -1 WHEN z+1.5<seen THEN 0 WHEN carried THEN -1 ELSE 1 END::INTEGER AS state FROM walk JOIN pixels ON "row"=y AND col=x"""


def _picks(n: int) -> str:
    """A chain of picks: the point nearest the centroid, then the one farthest from all picks; ties to the least (y, x)."""
    steps = ["p0 AS (SELECT source_h3, 0 AS sample_index, arg_min(k, (round(sqrt(pow(x-mx,2)+pow(y-my,2)),6), k)) AS k FROM (SELECT *, avg(x) OVER (PARTITION BY source_h3) AS mx, avg(y) OVER (PARTITION BY source_h3) AS my FROM point) GROUP BY source_h3)"]
    for i in range(1, n):
        steps.append(
            f"""p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT source_h3, {i}, arg_max(k, (away, -k)) FROM (SELECT c.source_h3, c.k, round(min(sqrt(pow(c.x-t.x,2)+pow(c.y-t.y,2))),6) AS away
  FROM point c JOIN p{i - 1} p USING (source_h3) JOIN point t ON t.source_h3=p.source_h3 AND t.k=p.k GROUP BY c.source_h3, c.k HAVING bool_and(c.k<>p.k)) GROUP BY source_h3)"""
        )
    return ",\n".join(steps)


DESIGN_SQL = f"""point AS (SELECT source_h3, x, y, row_number() OVER (PARTITION BY source_h3 ORDER BY y, x) AS k FROM (
  SELECT 'S'||s_suppkey AS source_h3, x0+(x1-x0)*i/13.0::DOUBLE AS x, y0+(y1-y0)*j/13.0::DOUBLE AS y FROM (SELECT s_suppkey, s_suppkey::DOUBLE AS x0, s_suppkey*2::DOUBLE AS y0, s_suppkey+10+s_suppkey%7::DOUBLE AS x1, s_suppkey*2+5+s_suppkey%3::DOUBLE AS y1 FROM supplier)
  CROSS JOIN (SELECT unnest(range(1,13)) AS i) CROSS JOIN (SELECT unnest(range(1,13)) AS j))),
{_picks(7)}"""
PICKS_SQL = "SELECT p.source_h3, p.sample_index::INTEGER AS sample_index, x, y FROM p6 p JOIN point c ON c.source_h3=p.source_h3 AND c.k=p.k"
