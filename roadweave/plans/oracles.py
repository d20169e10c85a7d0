"""DuckDB SQL for the registered queries, written from the rules and not from the Spark plans.

Lengths are compared as whole 1/10,000 m and driving times as whole 1/100 s, so that rounding is exact.
"""

from __future__ import annotations

import math

# fixed values: refused access, road classes
_NO = "('no','private','customers','permit','agricultural','forestry','delivery','destination')"
_CLASSES = (
    "['motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link',"
    "'tertiary','tertiary_link','unclassified','residential','living_street','service','track','footway']"
)


def _xy(c: str, r: str, n: str) -> str:
    return (
        f"(430000 + 100*{c} + (37*{c} + 91*{r}) % 21 - 10)::DOUBLE AS x{n},"
        f" (5930000 + 100*{r} + (53*{c} + 29*{r}) % 21 - 10)::DOUBLE AS y{n}"
    )


GRID = f"""
o AS (SELECT o_orderkey AS i, o_custkey AS cust, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price,
        (o_orderkey // 2) % 100 AS c1, o_orderkey // 200 AS r1 FROM orders),
g AS (SELECT *, c1 + (1 - i % 2) AS c2, r1 + i % 2 AS r2 FROM o),
seg AS (SELECT *, i AS edge_id, i // 4 AS osm_id, {_xy('c1', 'r1', '1')}, {_xy('c2', 'r2', '2')} FROM g)"""

WAYS = GRID + f""",
ways AS (SELECT *, {_CLASSES}[cust % 16 + 1] AS highway,
  CASE i % 10 WHEN 3 THEN 'private' WHEN 4 THEN 'yes' END AS access,
  CASE i % 23 WHEN 3 THEN 'private' WHEN 4 THEN 'yes' END AS vehicle,
  CASE i % 29 WHEN 3 THEN 'private' WHEN 4 THEN 'yes' END AS motor_vehicle,
  CASE i % 31 WHEN 3 THEN 'private' WHEN 4 THEN 'yes' END AS motorcar,
  CASE WHEN i % 41 = 0 THEN 'parking_aisle' END AS service,
  CASE i % 11 WHEN 0 THEN 'none' WHEN 1 THEN 'walk' WHEN 2 THEN '30' WHEN 3 THEN '50' WHEN 4 THEN '100' END AS maxspeed,
  CASE i % 17 WHEN 0 THEN 'DE:rural' WHEN 1 THEN 'DE:urban' WHEN 2 THEN 'DE:zone30' WHEN 3 THEN 'DE:zone20' END AS maxspeed_type,
  CASE i % 19 WHEN 0 THEN 'DE:rural' WHEN 1 THEN 'DE:urban' END AS zone_traffic,
  CASE WHEN st = 'O' THEN CASE i % 8 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'true' WHEN 3 THEN '1' WHEN 4 THEN 'no' END END AS oneway,
  CASE WHEN pr <> '5-LOW' THEN pr END AS name,
  CASE WHEN i % 3 = 0 THEN 'K' || (i % 50) END AS ref FROM seg),
allowed AS (SELECT *, (access IS NULL OR access NOT IN {_NO}) AND (vehicle IS NULL OR vehicle NOT IN {_NO})
  AND (motor_vehicle IS NULL OR motor_vehicle NOT IN {_NO}) AND (motorcar IS NULL OR motorcar NOT IN {_NO}) AS ok FROM ways),
car AS (SELECT * FROM allowed WHERE ok AND highway NOT IN ('track','footway')
  AND (service IS NULL OR service NOT IN ('parking_aisle','emergency_access')))"""

# fixed values: speeds by dedication
_DEDICATION = "CASE widmung WHEN 1301 THEN 130 WHEN 1303 THEN 100 WHEN 1305 THEN 70 WHEN 1306 THEN 50 WHEN 1307 THEN 30 WHEN 9999 THEN 30 END"
# fixed values: speeds by class and tags; given speeds come first here, last in the operator, whose rules only fill gaps
_SPEED = """CASE
  WHEN (maxspeed = 'none' OR maxspeed IS NULL) AND highway = 'motorway' THEN '130'
  WHEN (maxspeed = 'none' OR maxspeed IS NULL) AND highway = 'motorway_link' THEN '55'
  WHEN maxspeed IS NULL AND (maxspeed_type = 'DE:rural' OR zone_traffic = 'DE:rural') THEN '100'
  WHEN maxspeed IS NULL AND (maxspeed_type = 'DE:urban' OR zone_traffic = 'DE:urban') THEN '50'
  WHEN maxspeed = 'none' THEN '130'
  WHEN maxspeed = 'walk' THEN '7'
  WHEN maxspeed IS NOT NULL THEN maxspeed
  WHEN highway = 'trunk' THEN '100' WHEN highway = 'trunk_link' THEN '55'
  WHEN highway = 'primary' THEN '70' WHEN highway = 'primary_link' THEN '50'
  WHEN highway = 'secondary' THEN '60' WHEN highway = 'tertiary' THEN '50'
  WHEN highway IN ('secondary_link','tertiary_link') THEN '40' WHEN highway = 'unclassified' THEN '50'
  WHEN highway = 'residential' OR maxspeed_type = 'DE:zone30' THEN '30'
  WHEN highway = 'service' OR maxspeed_type = 'DE:zone20' THEN '20'
  WHEN highway = 'living_street' THEN '7' END"""

# metres in 1/10,000 and seconds in 1/100, both rounded half up
_CS = "(72 * len4 + 1000 * v) // (2000 * v)"
_SEC = lambda c: f"({c} / 100.0)::DECIMAL(8,2)"
_LEN = "(len4 / 10000.0)::DECIMAL(9,4)"

EDGES = WAYS + f""",
tagged AS (SELECT DISTINCT ON (osm_id) osm_id, highway, maxspeed, maxspeed_type, zone_traffic, oneway, name, ref FROM car ORDER BY osm_id, edge_id),
ce AS (SELECT seg.edge_id, seg.cust, seg.x1, seg.y1, seg.x2, seg.y2, tagged.*,
  round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) * 10000)::BIGINT AS len4 FROM seg JOIN tagged USING (osm_id)),
cw AS (SELECT *, CASE WHEN oneway = '-1' THEN -100 ELSE {_CS} END AS w, CASE WHEN oneway IN ('yes','true','1') THEN -100 ELSE {_CS} END AS wr
  FROM (SELECT *, ({_SPEED})::BIGINT AS v FROM ce))"""

AXES = GRID + """,
ax AS (SELECT *, x1 + 1 AS ax1, y1 - 1 AS ay1, (x1 + 1 + (x2 + 1)) / 2 + (i % 5 - 2) AS ax2, (y1 - 1 + (y2 - 1)) / 2 + (i % 3 - 1) AS ay2,
  x2 + 1 AS ax3, y2 - 1 AS ay3, lpad(i::VARCHAR, 12, '0') AS num, cust::VARCHAR AS istTeilVon,
  CASE WHEN i % 27 = 0 THEN 1808 END AS funktion, CASE WHEN i % 59 = 0 THEN 2100 WHEN i % 61 = 0 THEN 4000 END AS zustand,
  CASE WHEN i % 7 = 0 THEN 2 END AS inner_sig,
  CASE pr WHEN '5-LOW' THEN []::INT[] WHEN '2-HIGH' THEN [0, 1] ELSE [0] END AS hits FROM seg),
models AS (SELECT *, unnest(hits) AS model_pos FROM ax),
base AS (SELECT * FROM models WHERE funktion IS NULL OR funktion <> 1808),
roads AS (
  SELECT 1 AS axis_kind, 'A' || num AS gml_id, * EXCLUDE (inner_sig), inner_sig FROM base
    WHERE istTeilVon NOT IN (SELECT istTeilVon FROM ax WHERE price >= 495000)
  UNION ALL SELECT 2, 'F' || num, * EXCLUDE (inner_sig), NULL FROM base WHERE price >= 495000),
street AS (SELECT c_custkey::VARCHAR AS gml, CASE c_nationkey % 8 WHEN 0 THEN 1301 WHEN 1 THEN 1303 WHEN 2 THEN 1305 WHEN 3 THEN 1306
  WHEN 4 THEN 1307 WHEN 5 THEN 9999 WHEN 6 THEN 9997 END AS widmung,
  CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS bezeichnung FROM customer)"""

AUTH = AXES + f""",
ae AS (SELECT roads.* EXCLUDE (edge_id), widmung, name, bezeichnung, row_number() OVER (ORDER BY axis_kind, gml_id, model_pos) AS edge_id,
  round((sqrt((ax2-ax1)*(ax2-ax1)+(ay2-ay1)*(ay2-ay1)) + sqrt((ax3-ax2)*(ax3-ax2)+(ay3-ay2)*(ay3-ay2))) * 10000)::BIGINT AS len4
  FROM roads LEFT JOIN street ON istTeilVon = gml WHERE widmung IS DISTINCT FROM 9997),
aw AS (SELECT *, CASE WHEN zustand IS NOT NULL THEN -100 ELSE {_CS} END AS w
  FROM (SELECT *, {_DEDICATION} AS v FROM ae))"""


def _q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.lstrip(',').strip()} {select}"


def _completeness() -> str:
    def row(name, table, motorway, ref, speed, oneway):
        part = lambda cond: f"sum(CASE WHEN {cond} THEN len4 END)::BIGINT"
        return (
            f"SELECT '{name}' AS b, sum(len4)::BIGINT AS n, {part(motorway)} AS m, {part('name IS NOT NULL')} AS a,"
            f" {part(f'name IS NULL AND {ref} IS NULL')} AS r, {part(speed) if speed else 'NULL::BIGINT'} AS s,"
            f" {part(oneway) if oneway else 'NULL::BIGINT'} AS w FROM {table}"
        )

    length = lambda c, n: f"({c} / 10000.0)::DECIMAL(18,4) AS {n}"
    ratio = lambda c, n: f"(((2 * {c} * 10000 + n) // (2 * n)) / 100.0)::DECIMAL(5,2) AS {n}"
    both = row("authority", "ae", "widmung = 1301", "bezeichnung", None, None) + " UNION ALL " + row(
        "community", "ce", "highway IN ('motorway','motorway_link')", "ref", "maxspeed IS NOT NULL", "oneway = 'yes'"
    )
    ctes = EDGES + AUTH[len(GRID):] + f", t AS ({both})"
    return _q(
        ctes,
        "SELECT b AS data_basis, "
        + ", ".join([length("n", "network_length"), length("m", "motorway_length"), length("a", "name_length"), length("r", "no_name_ref_length"), length("s", "maxspeed_length"), length("w", "oneway_length")])
        + ", "
        + ", ".join([ratio("a", "name_ratio"), ratio("r", "no_name_ref_ratio"), ratio("s", "maxspeed_ratio"), ratio("w", "oneway_ratio")])
        + " FROM t",
    )


# ---------------------------------------------------------------- study area

_BOX = (431000.5, 5930100.25, 437000.75, 5935000.5)
_EXTENT = """,
ea AS (SELECT min(least(ax1,ax2,ax3)) AS xmin, min(least(ay1,ay2,ay3)) AS ymin, max(greatest(ax1,ax2,ax3)) AS xmax, max(greatest(ay1,ay2,ay3)) AS ymax FROM ax),
ec AS (SELECT min(least(x1,x2)) AS xmin, min(least(y1,y2)) AS ymin, max(greatest(x1,x2)) AS xmax, max(greatest(y1,y2)) AS ymax FROM seg),
common AS (SELECT greatest(ea.xmin, ec.xmin) AS xmin, greatest(ea.ymin, ec.ymin) AS ymin, least(ea.xmax, ec.xmax) AS xmax, least(ea.ymax, ec.ymax) AS ymax FROM ea, ec)"""
_GIVEN = _EXTENT + f""",
bx AS (SELECT greatest(xmin, {_BOX[0]}::DOUBLE) AS xmin, greatest(ymin, {_BOX[1]}::DOUBLE) AS ymin, least(xmax, {_BOX[2]}::DOUBLE) AS xmax, least(ymax, {_BOX[3]}::DOUBLE) AS ymax FROM common)"""
_ADDR = "addr AS (SELECT c_custkey AS id, 430000 + (1511 * c_custkey) % 10000 + 0.5::DOUBLE AS x, 5930000 + 5 * c_custkey + 0.25::DOUBLE AS y FROM customer)"


def _clip() -> str:
    d = {"x": "x2 - x1", "y": "y2 - y1"}

    def lo(a):
        return (
            f"CASE WHEN {d[a]} > 0 THEN ({a}min - {a}1) / ({d[a]}) WHEN {d[a]} < 0 THEN ({a}max - {a}1) / ({d[a]})"
            f" WHEN {a}1 BETWEEN {a}min AND {a}max THEN 0 ELSE 2 END"
        )

    def hi(a):
        return f"CASE WHEN {d[a]} > 0 THEN ({a}max - {a}1) / ({d[a]}) WHEN {d[a]} < 0 THEN ({a}min - {a}1) / ({d[a]}) ELSE 1 END"

    at = lambda t, a: f"CASE WHEN {t} <= 0 THEN {a}1 WHEN {t} >= 1 THEN {a}2 ELSE {a}1 + {t} * ({a}2 - {a}1) END"
    ctes = AXES + _GIVEN + f""",
t AS (SELECT edge_id, x1, y1, x2, y2, greatest(0, {lo('x')}, {lo('y')}) AS t0, least(1, {hi('x')}, {hi('y')}) AS t1 FROM seg, bx),
p AS (SELECT edge_id, {at('t0', 'x')} AS px, {at('t0', 'y')} AS py, {at('t1', 'x')} AS qx, {at('t1', 'y')} AS qy FROM t WHERE t0 < t1)"""
    return _q(ctes, "SELECT edge_id, 1::INTEGER AS part_no, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py))::DECIMAL(9,4) AS distance, least(px, qx)::DECIMAL(14,3) AS xmin, greatest(py, qy)::DECIMAL(14,3) AS ymax FROM p")


def _utm(source: str) -> str:
    """Krüger series in third flattening n, from source (id, lon, lat)."""
    f = 1 / 298.257222101
    n, e, radius = f / (2 - f), math.sqrt(f * (2 - f)), 6378137.0
    big = radius / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    al = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4,
    ]
    north = " + ".join(["u"] + [f"{a!r}::DOUBLE * sin({2 * k} * u) * cosh({2 * k} * v)" for k, a in enumerate(al, 1)])
    east = " + ".join(["v"] + [f"{a!r}::DOUBLE * cos({2 * k} * u) * sinh({2 * k} * v)" for k, a in enumerate(al, 1)])
    return (
        f"WITH src AS ({source}), a AS (SELECT id, sin(radians(lat)) AS s, radians(lon - 9.0) AS l FROM src),"
        f" b AS (SELECT id, l, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS tau FROM a),"
        " c AS (SELECT id, atan2(tau, cos(l)) AS u, atanh(sin(l) / sqrt(1 + tau * tau)) AS v FROM b)"
        f" SELECT id, 25832 AS srid, (500000 + {0.9996 * big!r}::DOUBLE * ({east}))::DECIMAL(14,3) AS x,"
        f" ({0.9996 * big!r}::DOUBLE * ({north}))::DECIMAL(14,3) AS y FROM c"
    )


# ---------------------------------------------------------------- topology

_X = 1_000_000_000_000_000
CHECK = WAYS + f""",
sup AS (SELECT {_X} + s_suppkey AS edge_id, (430050 + 100 * (s_suppkey % 100))::DOUBLE AS x, (5929950 + 1000 * (s_suppkey // 100))::DOUBLE AS y FROM supplier),
st0 AS (SELECT n_nationkey AS n, {_xy('(4*n_nationkey)', '0', '1')}, {_xy('(4*n_nationkey+1)', '0', '2')} FROM nation),
st1 AS (SELECT n, (x1+x2)/2 AS mx, (y1+y2)/2 AS my, (y1-y2)/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS nx, (x2-x1)/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS ny FROM st0),
pieces AS (
  SELECT edge_id, 1 AS k, x1, y1, x2, y2, oneway FROM ways
  UNION ALL SELECT edge_id, 1, x, y, x, y + 700, NULL FROM sup
  UNION ALL SELECT {2 * _X} + r_regionkey, k, (420000 + 50 * r_regionkey + a)::DOUBLE, (5920000 + a % 20)::DOUBLE, (420000 + 50 * r_regionkey + b)::DOUBLE, (5920000 + b % 20)::DOUBLE, NULL
    FROM region, (VALUES (1, 0, 10), (2, 10, 20), (3, 20, 0)) AS v(k, a, b)
  UNION ALL SELECT {3 * _X} + n, 1, mx + 0.3::DOUBLE * nx, my + 0.3::DOUBLE * ny, mx + 40 * nx, my + 40 * ny, NULL FROM st1),
ends AS (SELECT edge_id, 0 AS side, arg_min(x1, k) AS x, arg_min(y1, k) AS y, any_value(oneway) AS oneway FROM pieces GROUP BY edge_id
  UNION ALL SELECT edge_id, 1, arg_max(x2, k), arg_max(y2, k), any_value(oneway) FROM pieces GROUP BY edge_id),
nd AS (SELECT x, y, min(2 * edge_id + side) AS node_id, count(*) AS cnt FROM ends GROUP BY x, y),
lnk AS (SELECT edge_id, side, node_id, cnt, oneway FROM ends JOIN nd USING (x, y)),
te AS (SELECT edge_id, max(node_id) FILTER (side = 0) AS source, max(node_id) FILTER (side = 1) AS target, max(cnt) AS cnt FROM lnk GROUP BY edge_id),
tp AS (SELECT * FROM pieces JOIN te USING (edge_id))"""


_CROSS = """,
xs AS (SELECT DISTINCT a.edge_id AS edge_a, b.edge_id AS edge_b FROM tp a JOIN tp b ON a.edge_id < b.edge_id
  AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2)
  AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2)
  WHERE a.source NOT IN (b.source, b.target) AND a.target NOT IN (b.source, b.target)
  AND sign((a.x2-a.x1)*(b.y1-a.y1) - (a.y2-a.y1)*(b.x1-a.x1)) * sign((a.x2-a.x1)*(b.y2-a.y1) - (a.y2-a.y1)*(b.x2-a.x1)) <= 0
  AND sign((b.x2-b.x1)*(a.y1-b.y1) - (b.y2-b.y1)*(a.x1-b.x1)) * sign((b.x2-b.x1)*(a.y2-b.y1) - (b.y2-b.y1)*(a.x2-b.x1)) <= 0)"""


def _foot(px: str, py: str) -> dict[str, str]:
    raw = f"((({px}) - x1) * (x2 - x1) + (({py}) - y1) * (y2 - y1)) / nullif((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1), 0)"
    t = f"coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {raw})), 0.0::DOUBLE)"
    return {"t": t}


_AT = lambda t, a: f"(CASE WHEN {t} <= 0 THEN {a}1 WHEN {t} >= 1 THEN {a}2 ELSE {a}1 + {t} * ({a}2 - {a}1) END)"

_GAPS = f""",
gp AS (SELECT DISTINCT node_id, edge_id FROM (
  SELECT node_id, edge_id, px, py, {_AT('t', 'x')} AS qx, {_AT('t', 'y')} AS qy FROM (
    SELECT nd.node_id, nd.x AS px, nd.y AS py, tp.*, {_foot('nd.x', 'nd.y')['t']} AS t FROM nd JOIN tp ON nd.cnt = 1 AND nd.node_id NOT IN (tp.source, tp.target)
      AND nd.x BETWEEN least(tp.x1, tp.x2) - 1 AND greatest(tp.x1, tp.x2) + 1 AND nd.y BETWEEN least(tp.y1, tp.y2) - 1 AND greatest(tp.y1, tp.y2) + 1))
  WHERE sqrt((qx-px)*(qx-px) + (qy-py)*(qy-py)) <= 0.5)"""

_RING = "(SELECT edge_id FROM ends GROUP BY edge_id HAVING min(x) = max(x) AND min(y) = max(y))"


def _oneway(s_in, s_out, t_in, t_out) -> str:
    ok = lambda r: "(oneway IS NULL OR oneway IN (" + ",".join(f"'{v}'" for v in r) + "))::INT"
    return _q(
        CHECK,
        f"SELECT node_id, ein::BIGINT AS ein, eout::BIGINT AS eout, (ein = 0 OR eout = 0) AS problem FROM (SELECT node_id,"
        f" sum(CASE side WHEN 0 THEN {ok(s_in)} ELSE {ok(t_in)} END) AS ein, sum(CASE side WHEN 0 THEN {ok(s_out)} ELSE {ok(t_out)} END) AS eout"
        " FROM lnk GROUP BY node_id)",
    )


# ---------------------------------------------------------------- nearest, split

def _near(edges: str, seg: str = "1") -> str:
    """Best (dist, edge, segment) of every address over all edges."""
    return f""",
{_ADDR},
cand AS (SELECT id, edge_id, seg_no, t, {_AT('t', 'x')} AS qx, {_AT('t', 'y')} AS qy, x AS px, y AS py FROM (
  SELECT addr.id, addr.x, addr.y, e.*, {_foot('addr.x', 'addr.y')['t']} AS t FROM addr, (SELECT edge_id, {seg} AS seg_no, x1, y1, x2, y2 FROM {edges}) e)),
best AS (SELECT id, min(struct_pack(d := sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)), e := edge_id, s := seg_no, t := t, qx := qx, qy := qy)) AS b FROM cand GROUP BY id),
near AS MATERIALIZED (SELECT id AS point_id, b.d AS dist, b.e AS edge_id, b.s AS seg_no, b.t AS t, b.qx AS qx, b.qy AS qy FROM best)"""


def _split() -> str:
    ctes = EDGES + _near("cw") + f""",
top AS (SELECT max(edge_id) + 1 AS top FROM cw),
vert AS (SELECT edge_id, 0.0::DOUBLE AS pos, -1::BIGINT AS point_id, x1 AS x, y1 AS y FROM cw
  UNION ALL SELECT edge_id, t, point_id, qx, qy FROM near WHERE t > 0 AND t < 1),
part AS (SELECT v.edge_id, v.point_id, v.x, v.y, row_number() OVER o AS part_no, lead(v.point_id) OVER o AS next_point,
  coalesce(lead(v.x) OVER o, x2) AS nx, coalesce(lead(v.y) OVER o, y2) AS ny, count(*) OVER (PARTITION BY v.edge_id) AS parts, w, wr, v, highway, len4
  FROM vert v JOIN cw USING (edge_id) WINDOW o AS (PARTITION BY v.edge_id ORDER BY pos, v.point_id)),
m AS (SELECT *, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS len FROM part)"""
    weight = lambda c: f"CASE WHEN {c} = -100 THEN -1.00 WHEN parts = 1 THEN {_SEC(c)} ELSE round(len * 3.6 / v, 2) END::DECIMAL(8,2)"
    return _q(
        ctes,
        f"SELECT CASE WHEN point_id < 0 THEN edge_id ELSE top + point_id END AS edge_id, edge_id AS orig_edge_id, part_no::INTEGER AS part_no,"
        f" CASE WHEN point_id < 0 THEN 2 * edge_id ELSE {_X} + point_id END AS source,"
        f" CASE WHEN next_point IS NULL THEN 2 * edge_id + 1 ELSE {_X} + next_point END AS target,"
        f" CASE WHEN parts = 1 THEN {_LEN} ELSE len::DECIMAL(9,4) END AS distance, {weight('w')} AS weights_car, {weight('wr')} AS weights_car_reverse, highway FROM m, top",
    )


# ---------------------------------------------------------------- snapping

def _net(kind: str) -> str:
    """Edges for routing (net) and their straight pieces; an authority row listed twice by its model is one edge."""
    if kind == "community":
        return EDGES + """,
net AS (SELECT edge_id, x1 AS xs, y1 AS ys, x2 AS xe, y2 AS ye, len4, w, wr, v, osm_id AS own FROM cw),
piece AS (SELECT edge_id, 1 AS seg_no, x1, y1, x2, y2 FROM cw)"""
    return AUTH + """,
one AS MATERIALIZED (SELECT edge_id, ax1, ay1, ax2, ay2, ax3, ay3, len4, w, v, gml_id FROM aw QUALIFY row_number() OVER (PARTITION BY gml_id ORDER BY edge_id) = 1),
net AS (SELECT edge_id, ax1 AS xs, ay1 AS ys, ax3 AS xe, ay3 AS ye, len4, w, w AS wr, v, gml_id AS own FROM one),
piece AS (SELECT edge_id, 1 AS seg_no, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2 FROM one UNION ALL SELECT edge_id, 2, ax2, ay2, ax3, ay3 FROM one)"""


def _snapped(kind: str = "community") -> str:
    """Points take a node within 0.25 m of their foot point, or make one, one after the other in id order."""
    gap = lambda a, b: f"sqrt(pow({a}.qx - {b}.x, 2) + pow({a}.qy - {b}.y, 2))"
    return _net(kind) + _near("piece", "seg_no") + f""",
nd AS (SELECT x, y, min(k) AS node FROM (SELECT xs AS x, ys AS y, 2 * edge_id AS k FROM net UNION ALL SELECT xe, ye, 2 * edge_id + 1 FROM net) GROUP BY x, y),
above AS (SELECT max(node) + 1 AS n FROM nd),
old AS (SELECT point_id, min({{'d': d, 'node': node}}) AS o FROM (SELECT near.point_id, nd.node, {gap("near", "nd")} AS d FROM near JOIN nd
  ON nd.x BETWEEN near.qx - 0.25 AND near.qx + 0.25 AND nd.y BETWEEN near.qy - 0.25 AND near.qy + 0.25) WHERE d <= 0.25 GROUP BY point_id),
free AS MATERIALIZED (SELECT row_number() OVER (ORDER BY point_id) AS rn, point_id, qx, qy FROM near WHERE point_id NOT IN (SELECT point_id FROM old)),
made(rn, point_id, maker, x, y) USING KEY (rn) AS (
  SELECT rn, point_id, point_id, qx, qy FROM free WHERE rn = 1
  UNION (SELECT rn, point_id, coalesce(min(m).maker, point_id), qx, qy FROM (
    SELECT f.*, CASE WHEN r.maker IS NOT NULL THEN {{'d': {gap("f", "r")}, 'maker': r.maker}} END AS m
    FROM made l JOIN free f ON f.rn = l.rn + 1 LEFT JOIN recurring.made r ON r.maker = r.point_id AND {gap("f", "r")} <= 0.25) GROUP BY rn, point_id, qx, qy)),
mk AS (SELECT point_id, x, y FROM made WHERE maker = point_id),
rival AS (SELECT point_id, min({{'d': d, 'maker': maker}}) AS r FROM (SELECT near.point_id, mk.point_id AS maker, {gap("near", "mk")} AS d
  FROM near JOIN old USING (point_id) JOIN mk ON mk.point_id < near.point_id AND mk.x BETWEEN near.qx - 0.25 AND near.qx + 0.25) WHERE d <= 0.25 GROUP BY point_id),
taken AS (SELECT point_id, maker, NULL::BIGINT AS node FROM made
  UNION ALL SELECT point_id, CASE WHEN r.d < o.d THEN r.maker END, CASE WHEN r.d < o.d THEN NULL ELSE o.node END FROM old LEFT JOIN rival USING (point_id)),
place AS (SELECT point_id, coalesce(n + maker, node) AS node_id FROM taken, above),
spot AS (SELECT node AS node_id, x, y FROM nd UNION ALL SELECT n + point_id, x, y FROM mk, above)"""


def _snapped_points() -> str:
    return _q(
        _snapped(),
        "SELECT point_id, node_id, edge_id, sqrt(pow(addr.x - spot.x, 2) + pow(addr.y - spot.y, 2))::DECIMAL(9,4) AS hook_length"
        " FROM near JOIN place USING (point_id) JOIN spot USING (node_id) JOIN addr ON addr.id = point_id", True,
    )


_TURNS = """,
top AS (SELECT max(edge_id) + 1 AS top FROM cw),
cut AS (SELECT edge_id, arg_max(near.point_id, {'t': t, 'p': near.point_id}) AS lastcut FROM near JOIN mk USING (point_id) GROUP BY edge_id),
part AS (SELECT cw.edge_id, lastcut IS NULL AS entire, coalesce(top + lastcut, cw.edge_id) AS lastpart, a.node AS s, b.node AS t
  FROM cw CROSS JOIN top LEFT JOIN cut USING (edge_id) JOIN nd a ON a.x = x1 AND a.y = y1 JOIN nd b ON b.x = x2 AND b.y = y2),
bans AS (SELECT DISTINCT i AS f, i + d AS e FROM (SELECT o_orderkey AS i FROM orders), (VALUES (0), (2)) AS v(d) WHERE (d = 2 AND i % 10 = 0) OR (d = 0 AND i % 37 = 0) OR i % 370 = 0),
pairs AS (SELECT bans.f, bans.e, coalesce(pf.lastpart, bans.f) AS fl, coalesce(pe.lastpart, bans.e) AS el, coalesce(pf.entire, true) AND coalesce(pe.entire, true) AS entire,
  pf.s AS fs, pf.t AS ft, pe.s AS es, pe.t AS et FROM bans LEFT JOIN part pf ON pf.edge_id = bans.f LEFT JOIN part pe ON pe.edge_id = bans.e),
turn AS (SELECT f, e FROM pairs WHERE entire OR f = e UNION SELECT fl, el FROM pairs WHERE NOT entire AND f = e
  UNION SELECT fl, e FROM pairs WHERE NOT entire AND f <> e AND ft = es UNION SELECT fl, el FROM pairs WHERE NOT entire AND f <> e AND ft = et
  UNION SELECT f, e FROM pairs WHERE NOT entire AND f <> e AND fs = es UNION SELECT f, el FROM pairs WHERE NOT entire AND f <> e AND fs = et)"""


def _remapped() -> str:
    return _q(_snapped() + _TURNS, "SELECT 10000.0::DOUBLE AS restriction_cost, e::BIGINT AS to_edge_id, f::BIGINT AS from_edge_id, NULL::VARCHAR AS via_path FROM turn", True)


# ---------------------------------------------------------------- network after snapping, routes

_PARTS = f""",
above_edges AS (SELECT max(edge_id) + 1 AS m FROM net),
hit AS (SELECT DISTINCT edge_id FROM near JOIN mk USING (point_id)),
vert AS (SELECT edge_id, (seg_no - 1)::DOUBLE AS pos, NULL::BIGINT AS point_id, x1 AS x, y1 AS y FROM piece JOIN hit USING (edge_id)
  UNION ALL SELECT edge_id, max(seg_no)::DOUBLE, NULL, arg_max(x2, seg_no), arg_max(y2, seg_no) FROM piece JOIN hit USING (edge_id) GROUP BY edge_id
  UNION ALL SELECT edge_id, seg_no - 1 + t, near.point_id, qx, qy FROM near JOIN mk USING (point_id)),
trail AS (SELECT *, count(point_id) OVER o AS k, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM vert
  WINDOW o AS (PARTITION BY edge_id ORDER BY pos, point_id NULLS FIRST)),
bit AS (SELECT edge_id, k, sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) ORDER BY pos) AS len, max(point_id) AS p FROM trail WHERE nx IS NOT NULL GROUP BY edge_id, k),
cutp AS (SELECT *, lead(p) OVER (PARTITION BY edge_id ORDER BY k) AS q FROM bit),
linked AS (SELECT net.*, a.node AS s, b.node AS e FROM net JOIN nd a ON a.x = xs AND a.y = ys JOIN nd b ON b.x = xe AND b.y = ye),
road AS MATERIALIZED (
  SELECT edge_id, edge_id AS orig, 1 AS part_no, s AS source, e AS target, {_LEN} AS distance, w::BIGINT AS w, wr::BIGINT AS wr, v, own
  FROM linked WHERE edge_id NOT IN (SELECT edge_id FROM hit)
  UNION ALL SELECT coalesce(m + p, l.edge_id), l.edge_id, k + 1, coalesce(n + p, s), coalesce(n + q, e), len::DECIMAL(9,4),
    CASE WHEN w = -100 THEN w ELSE round(round(len * 3.6 / v, 2) * 100) END::BIGINT, CASE WHEN wr = -100 THEN wr ELSE round(round(len * 3.6 / v, 2) * 100) END::BIGINT, v, own
  FROM cutp JOIN linked l USING (edge_id), above, above_edges)"""


def _snapped_network() -> str:
    return _q(
        _snapped("authority") + _PARTS,
        "SELECT edge_id, orig AS orig_edge_id, part_no::INTEGER AS part_no, source, target, distance,"
        f" {_SEC('w')} AS weights_car, {_SEC('wr')} AS weights_car_reverse FROM road", True,
    )


def _labels(p: str, limit: str, which: str) -> str:
    """Best keys (told) of the pairs asked for, as far as they keep within the limit; k is the pair and the vertex in one number."""
    return f""",
{p}lab(k, key) USING KEY (k) AS (
  SELECT pair_id * 16777216 + s.v, 0::BIGINT FROM asked JOIN vx s ON s.node = asked.s AND s.e = -1
    JOIN island i ON i.node = asked.s JOIN island j ON j.node = g WHERE asked.s <> g AND i.root = j.root AND {which}
  UNION (SELECT n.k, n.key FROM (
    SELECT l.k - h.f + h.t AS k, min(l.key + h.w) AS key FROM {p}lab l JOIN hop h ON h.f = l.k % 16777216 GROUP BY 1) n
    LEFT JOIN recurring.{p}lab r ON r.k = n.k
    LEFT JOIN (SELECT pair_id, min(key) AS top FROM recurring.{p}lab JOIN goals USING (k) GROUP BY pair_id) z ON z.pair_id = n.k // 16777216
    WHERE (r.key IS NULL OR n.key < r.key) AND (z.top IS NULL OR n.key <= z.top) AND {limit})),
{p}told AS MATERIALIZED (SELECT k, k // 16777216 AS pair_id, k % 16777216 AS v, key FROM {p}lab)"""


def _routes(kind: str) -> str:
    """Best way of every address pair (walk, from the goal back). A place is a node and, where a banned turn may follow, the edge just driven.

    Only pairs in one weakly connected part are searched, first within 300 s, then the others without a limit. Labels better than the best way found so far set out again until none is left.
    """
    bans = _TURNS if kind == "community" else ", turn AS (SELECT NULL::BIGINT AS f, NULL::BIGINT AS e WHERE false)"
    return _snapped(kind) + _PARTS + bans + """,
way AS (SELECT source AS f, target AS t, edge_id, 2 * edge_id AS arc, w AS c FROM road WHERE w >= 0
  UNION ALL SELECT target, source, edge_id, 2 * edge_id + 1, wr FROM road WHERE wr >= 0),
arcs AS MATERIALIZED (SELECT *, c * 68719476736 + ((arc % 1000003) * (arc % 1000003) % 1021 * (arc % 1000003) + 12345) % 1021 + 1 AS w,
  CASE WHEN edge_id IN (SELECT f FROM turn) THEN edge_id ELSE -1 END AS e FROM way),
turns AS (SELECT f, -1 AS e0, t, e AS e1, arc, c, w, 0 AS fine FROM arcs
  UNION ALL SELECT a.f, d.e, a.t, a.e, a.arc, a.c, a.w + CASE WHEN turn.f IS NULL THEN 0 ELSE 1000000 * 68719476736 END, CASE WHEN turn.f IS NULL THEN 0 ELSE 1000000 END
  FROM (SELECT DISTINCT e, t FROM arcs WHERE e >= 0) d JOIN arcs a ON a.f = d.t LEFT JOIN turn ON turn.f = d.e AND turn.e = a.edge_id),
vx AS MATERIALIZED (SELECT node, e, row_number() OVER (ORDER BY node, e) AS v FROM (SELECT f AS node, -1 AS e FROM arcs UNION SELECT t, -1 FROM arcs UNION SELECT t, e FROM arcs)),
hop AS MATERIALIZED (SELECT a.v AS f, b.v AS t, arc, c, w, fine, turns.f AS tail FROM turns JOIN vx a ON a.node = turns.f AND a.e = e0 JOIN vx b ON b.node = turns.t AND b.e = e1),
pr AS (SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // 2 + 1 AS pair_id FROM customer),
pp AS (SELECT pair_id, min(id) AS start_id, max(id) AS dest_id FROM pr GROUP BY pair_id HAVING count(*) = 2),
asked AS MATERIALIZED (SELECT pp.*, a.node_id AS s, b.node_id AS g FROM pp LEFT JOIN place a ON a.point_id = start_id LEFT JOIN place b ON b.point_id = dest_id),
part_of(node, root) USING KEY (node) AS (
  SELECT DISTINCT f, f FROM (SELECT f FROM arcs UNION ALL SELECT t FROM arcs)
  UNION (SELECT k.node, k.root FROM (SELECT b.y AS node, min(l.root) AS root FROM part_of l JOIN (SELECT f AS x, t AS y FROM arcs UNION SELECT t, f FROM arcs) b ON b.x = l.node GROUP BY b.y) k
    JOIN recurring.part_of r ON r.node = k.node AND k.root < r.root)),
island AS MATERIALIZED (SELECT * FROM part_of),
goals AS MATERIALIZED (SELECT pair_id, pair_id * 16777216 + v AS k FROM asked JOIN vx ON node = g)""" + _labels("near_", "n.key < 300 * 6871947673600", "true") + _labels(
        "far_", "true", "pair_id NOT IN (SELECT goals.pair_id FROM near_told JOIN goals USING (k))") + """,
told AS MATERIALIZED (SELECT near_told.* FROM near_told SEMI JOIN (SELECT goals.pair_id FROM near_told JOIN goals USING (k)) USING (pair_id) UNION ALL SELECT * FROM far_told),
way_best AS MATERIALIZED (SELECT goals.pair_id, min({'key': key, 'v': v}) AS m FROM told JOIN goals USING (k) GROUP BY ALL)"""


def _route_status() -> str:
    one = lambda k: _q(
        _routes(k),
        "SELECT pair_id, CASE WHEN s IS NULL OR g IS NULL THEN 'no_node' WHEN s = g THEN 'same_node' WHEN m IS NULL THEN 'not_found' ELSE 'found' END AS status,"
        f" ((m.key >> 36) / 100.0)::DECIMAL(12,2) AS total_cost, '{k}' AS data_basis FROM asked LEFT JOIN way_best USING (pair_id)", True,
    )
    return f"SELECT * FROM ({one('authority')}) UNION ALL SELECT * FROM ({one('community')})"


def _route_steps(kind: str) -> str:
    own, speed, penalty = ("osm_id", "VARCHAR", ", (fine / 100.0)::DECIMAL(8,2) AS penalty") if kind == "community" else ("gml_id", "INTEGER", "")
    ctes = _routes(kind) + """,
into_arc AS MATERIALIZED (SELECT b.pair_id, b.v, min({'arc': h.arc, 'f': h.f}) AS m FROM told b JOIN hop h ON h.t = b.v
  JOIN told a ON a.k = b.k - h.t + h.f AND a.key + h.w = b.key GROUP BY ALL),
walk(pair_id, depth, v) AS (SELECT pair_id, 0, m.v FROM way_best
  UNION ALL SELECT w.pair_id, depth + 1, x.m.f FROM walk w JOIN into_arc x ON x.pair_id = w.pair_id AND x.v = w.v),
steps AS (SELECT w.pair_id, -depth AS pos, h.tail AS node_id, h.arc // 2 AS edge_id, h.arc % 2 = 1 AS backward, h.c + h.fine AS cs, h.fine
  FROM walk w JOIN into_arc x ON x.pair_id = w.pair_id AND x.v = w.v JOIN hop h ON h.arc = x.m.arc AND h.f = x.m.f
  UNION ALL SELECT pair_id, 1, g, -1, NULL, 0, 0 FROM asked JOIN way_best USING (pair_id)),
full_steps AS (SELECT *, row_number() OVER o AS seq, count(*) OVER (PARTITION BY pair_id) AS n, sum(cs) OVER o - cs AS before FROM steps WINDOW o AS (PARTITION BY pair_id ORDER BY pos)),
spots AS (SELECT point_id, sqrt(pow(addr.x - spot.x, 2) + pow(addr.y - spot.y, 2))::DECIMAL(9,4) AS hook FROM place JOIN spot USING (node_id) JOIN addr ON addr.id = point_id),
hooked AS (SELECT f.*, CASE WHEN seq = f.n THEN dest_id WHEN seq = 1 THEN start_id END AS od_point_id FROM full_steps f JOIN asked USING (pair_id))"""
    return _q(
        ctes,
        f"SELECT pair_id, h.edge_id::BIGINT AS edge_id, seq::INTEGER AS seq, h.node_id, backward, (cs / 100.0)::DECIMAL(12,2) AS cost, (before / 100.0)::DECIMAL(12,2) AS agg_cost{penalty},"
        f" source, target, distance, v::{speed} AS maxspeed, {_SEC('w')} AS weights_car, {_SEC('wr')} AS weights_car_reverse, own AS {own}, hook AS hook_length, od_point_id"
        " FROM hooked h LEFT JOIN road USING (edge_id) LEFT JOIN spots ON point_id = od_point_id", True,
    )


# ---------------------------------------------------------------- catchment

def _catchment_ctes(kind: str, tag: str) -> str:
    if kind == "community":
        edges = "SELECT edge_id, cust AS owner, x1 AS xa, y1 AS ya, x2 AS xb, y2 AS yb, w, wr FROM cw"
    else:
        edges = (
            "SELECT edge_id, istTeilVon::BIGINT AS owner, ax1 AS xa, ay1 AS ya, ax3 AS xb, ay3 AS yb, w, w AS wr FROM aw"
            " QUALIFY row_number() OVER (PARTITION BY gml_id ORDER BY edge_id) = 1"
        )
    p = tag
    # key: hundredths of a second above 36 bits of tie numbers
    return f""",
{p}e AS ({edges}),
{p}d AS (SELECT x, y, min(k) AS node FROM (SELECT xa AS x, ya AS y, 2 * edge_id AS k FROM {p}e UNION ALL SELECT xb, yb, 2 * edge_id + 1 FROM {p}e) GROUP BY x, y),
{p}n AS (SELECT e.*, a.node AS source, b.node AS target FROM {p}e e JOIN {p}d a ON a.x = xa AND a.y = ya JOIN {p}d b ON b.x = xb AND b.y = yb),
{p}way AS (SELECT source AS f, target AS t, w::BIGINT AS c, 2 * edge_id AS arc FROM {p}n WHERE w >= 0 UNION ALL SELECT target, source, wr::BIGINT, 2 * edge_id + 1 FROM {p}n WHERE wr >= 0),
{p}arc AS MATERIALIZED (SELECT f, t, c, arc, c * 68719476736 + ((arc % 1000003) * (arc % 1000003) % 1021 * (arc % 1000003) + 12345) % 1021 + 1 AS w FROM {p}way
  QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY w, arc) = 1),
{p}start AS (SELECT owner AS start_id, arg_min(source, edge_id) AS node FROM {p}n GROUP BY owner),
{p}lab(start_id, node, b) USING KEY (start_id, node) AS (
  SELECT start_id, node, {{'key': 0::BIGINT, 'arc': -2::BIGINT}} FROM {p}start
  UNION (SELECT k.start_id, k.node, k.b FROM (
    SELECT l.start_id, a.t AS node, min({{'key': l.b.key + a.w, 'arc': a.arc}}) AS b FROM {p}lab l JOIN {p}arc a ON a.f = l.node
    WHERE l.b.key + a.w < 5001 * 68719476736 GROUP BY l.start_id, a.t) k
    LEFT JOIN recurring.{p}lab r ON r.start_id = k.start_id AND r.node = k.node WHERE r.b IS NULL OR k.b < r.b)),
{p}got AS (SELECT l.start_id, l.node, b.key AS key, b.key >> 36 AS cost, b.arc // 2 AS edge, coalesce(a.c, 0) AS step,
  row_number() OVER (PARTITION BY l.start_id ORDER BY b.key, l.node) AS seq FROM {p}lab l LEFT JOIN {p}arc a ON a.arc = l.b.arc)"""


def _catchment(kind: str) -> str:
    base = EDGES if kind == "community" else AUTH
    return _q(
        base + _catchment_ctes(kind, "z"),
        "SELECT start_id, seq::INTEGER AS seq, node AS node_id, edge::BIGINT AS edge_id_to_node, (step / 100.0)::DECIMAL(12,2) AS cost,"
        " (cost / 100.0)::DECIMAL(12,2) AS total_cost_to_node FROM zgot", True,
    )


def _catchment_both() -> str:
    one = lambda p, k: (
        f"SELECT start_id, count(*) AS nodes, count(*) AS last_seq, (max(cost) / 100.0)::DECIMAL(12,2) AS farthest, '{k}' AS data_basis FROM {p}got GROUP BY start_id"
    )
    ctes = EDGES + AUTH[len(GRID):] + _catchment_ctes("authority", "a_") + _catchment_ctes("community", "c_")
    return _q(ctes, one("a_", "authority") + " UNION ALL " + one("c_", "community"), True)


# ---------------------------------------------------------------- line measures

def _overlap(r: float) -> str:
    halves = "SELECT i, 1 AS k, ax1 AS px, ay1 AS py, ax2 AS qx, ay2 AS qy, x1, y1, x2, y2 FROM ax UNION ALL SELECT i, 2, ax2, ay2, ax3, ay3, x1, y1, x2, y2 FROM ax"
    return _q(
        AXES
        + f""",
h AS (SELECT *, qx - px AS dx, qy - py AS dy, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS la, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS lb FROM ({halves})),
u AS (SELECT *, (x2-x1)/lb AS ux, (y2-y1)/lb AS uy FROM h),
lin AS (SELECT *, (px-x1)*ux + (py-y1)*uy AS s0, dx*ux + dy*uy AS s1, (py-y1)*ux - (px-x1)*uy AS a0, dy*ux - dx*uy AS a1 FROM u),
strip AS (SELECT *, greatest(0.0,
    CASE WHEN s1 = 0 THEN CASE WHEN s0 BETWEEN 0 AND lb THEN 0.0 ELSE 2.0 END ELSE least(-s0/s1, (lb-s0)/s1) END,
    CASE WHEN a1 = 0 THEN CASE WHEN abs(a0) <= {r} THEN 0.0 ELSE 2.0 END ELSE least((-{r}-a0)/a1, ({r}-a0)/a1) END) AS b0,
  least(1.0, CASE WHEN s1 = 0 THEN 1.0 ELSE greatest(-s0/s1, (lb-s0)/s1) END, CASE WHEN a1 = 0 THEN 1.0 ELSE greatest((-{r}-a0)/a1, ({r}-a0)/a1) END) AS b1 FROM lin),
disc AS (SELECT *, (px-x1)*dx+(py-y1)*dy AS h1, la*la*((px-x1)*(px-x1)+(py-y1)*(py-y1)-{r * r}) AS c1_, (px-x2)*dx+(py-y2)*dy AS h2, la*la*((px-x2)*(px-x2)+(py-y2)*(py-y2)-{r * r}) AS c2_ FROM strip),
rng AS (SELECT i, k, la,
  CASE WHEN b0 <= b1 THEN b0 END AS l0, CASE WHEN b0 <= b1 THEN b1 END AS l1,
  CASE WHEN h1*h1 >= c1_ THEN greatest(0.0, (-h1 - sqrt(h1*h1-c1_))/(la*la)) END AS m0, CASE WHEN h1*h1 >= c1_ THEN least(1.0, (-h1 + sqrt(h1*h1-c1_))/(la*la)) END AS m1,
  CASE WHEN h2*h2 >= c2_ THEN greatest(0.0, (-h2 - sqrt(h2*h2-c2_))/(la*la)) END AS n0, CASE WHEN h2*h2 >= c2_ THEN least(1.0, (-h2 + sqrt(h2*h2-c2_))/(la*la)) END AS n1 FROM disc),
uni AS (SELECT i, la, least(l0, CASE WHEN m0 <= m1 THEN m0 END, CASE WHEN n0 <= n1 THEN n0 END) AS t0, greatest(l1, CASE WHEN m0 <= m1 THEN m1 END, CASE WHEN n0 <= n1 THEN n1 END) AS t1 FROM rng),
tot AS (SELECT i, round(coalesce(sum((t1 - t0) * la), 0) * 10000)::BIGINT AS got, round(sum(la) * 10000)::BIGINT AS full_len FROM uni GROUP BY i)""",
        "SELECT i AS route_id, (((2 * got * 10000 + full_len) // (2 * full_len)) / 100.0)::DECIMAL(5,2) AS buffer FROM tot",
    )


def _pt_seg(p: str, a: str, b: str) -> str:
    """Distance of point p to segment a–b, given column name pairs."""
    t = f"greatest(0.0, least(1.0, (({p[0]}-{a[0]})*({b[0]}-{a[0]})+({p[1]}-{a[1]})*({b[1]}-{a[1]}))/(({b[0]}-{a[0]})*({b[0]}-{a[0]})+({b[1]}-{a[1]})*({b[1]}-{a[1]}))))"
    return f"sqrt(pow({a[0]}+{t}*({b[0]}-{a[0]})-{p[0]},2)+pow({a[1]}+{t}*({b[1]}-{a[1]})-{p[1]},2))"


def _hausdorff() -> str:
    a = [("ax1", "ay1"), ("ax2", "ay2"), ("ax3", "ay3")]
    b = [("x1", "y1"), ("x2", "y2")]
    terms = [_pt_seg(p, b[0], b[1]) for p in a] + [f"least({_pt_seg(p, a[0], a[1])}, {_pt_seg(p, a[1], a[2])})" for p in b]
    return _q(AXES, f"SELECT i AS route_id, greatest({', '.join(terms)})::DECIMAL(18,4) AS hausdorff_distance FROM ax")


def _chain_hausdorff() -> str:
    """Vertices of either chain against every segment of the other one; side 1 has all orders, side 2 those that are not urgent."""
    chains = GRID + """,
s AS (SELECT * FROM seg, (VALUES (1), (2)) AS sides(side) WHERE side = 1 OR pr <> '1-URGENT'),
v AS (SELECT side, cust, i, k, CASE WHEN (st = 'F') = (k = 1) THEN x2 ELSE x1 END AS x, CASE WHEN (st = 'F') = (k = 1) THEN y2 ELSE y1 END AS y
  FROM s, (VALUES (1), (2)) AS n(k)),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY side, cust ORDER BY i, k))"""
    far = _pt_seg(("a.x", "a.y"), ("b.px", "b.py"), ("b.x", "b.y"))
    chains += f""",
near AS (SELECT a.cust, a.side, a.i, a.k, min({far}) AS d FROM p a JOIN p b ON a.cust = b.cust AND a.side <> b.side
  WHERE b.px <> b.x OR b.py <> b.y GROUP BY ALL)"""
    return _q(chains, "SELECT cust AS route_id, max(d)::DECIMAL(18,4) AS hausdorff_distance FROM near GROUP BY cust")


def _frechet() -> str:
    d = ", ".join(
        f"sqrt((ax{m}-x{n})*(ax{m}-x{n})+(ay{m}-y{n})*(ay{m}-y{n})) AS d{m}{n}" for m in (1, 2, 3) for n in (1, 2)
    )
    steps = f""", f0 AS (SELECT i, {d} FROM ax), f1 AS (SELECT *, greatest(d11, d12) AS g12, greatest(d11, d21) AS g21 FROM f0),
f2 AS (SELECT *, greatest(d22, least(d11, g12, g21)) AS g22, greatest(g21, d31) AS g31 FROM f1)"""
    return _q(AXES + steps, "SELECT i AS route_id, greatest(d32, least(g21, g22, g31))::DECIMAL(18,4) AS frechet_distance FROM f2")


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["network_completeness"] = _completeness()
    out["car_filter"] = _q(WAYS, "SELECT edge_id, osm_id, highway, access, service, oneway, maxspeed_type, zone_traffic, name, ref FROM car")
    out["access_filter"] = _q(WAYS, "SELECT edge_id, ok AS allowed FROM allowed")
    out["explode_model"] = _q(AXES, "SELECT 'A' || num AS gml_id, model_pos, funktion FROM base")
    right = "SELECT bezeichnung FROM street WHERE widmung = 1301"
    out["notin_null_aware"] = _q(
        AXES,
        f"SELECT 'no_nulls' AS case_name, count(*) AS n FROM street WHERE bezeichnung NOT IN ({right} AND bezeichnung IS NOT NULL)"
        f" UNION ALL SELECT 'with_nulls', count(*) FROM street WHERE bezeichnung NOT IN ({right})"
        f" UNION ALL SELECT 'empty', count(*) FROM street WHERE bezeichnung NOT IN ({right} AND bezeichnung = '')",
    )
    out["union_axes"] = _q(AXES, "SELECT axis_kind, gml_id, model_pos, istTeilVon, inner_sig AS verkehrsbedeutungInneroertlich FROM roads")
    out["street_enrich"] = _q(AXES, "SELECT 'A' || num AS gml_id, istTeilVon, widmung, bezeichnung, name FROM ax LEFT JOIN street ON istTeilVon = gml")
    out["authority_assemble"] = _q(AUTH, "SELECT edge_id, gml_id, istTeilVon, widmung, bezeichnung, name, funktion, zustand FROM ae")
    out["tags_segments_join"] = _q(EDGES, "SELECT edge_id, osm_id, osm_id AS pgsql_osm_id, highway, oneway, name, ref, maxspeed FROM ce")
    patch = "SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS way FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
    out["oneway_patch"] = f"SELECT s.o_orderkey AS edge_id, way AS fahrtrichtung FROM orders s LEFT JOIN ({patch}) p ON p.o_custkey = s.o_orderkey"
    out["tag_rules"] = (
        "SELECT o_orderkey AS way_id, 'highway' AS tag, 'service' AS value FROM orders UNION ALL SELECT o_orderkey, 'name', o_orderpriority FROM orders"
        " UNION ALL SELECT o_orderkey, 'source:maxspeed', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'notes', 'kept' FROM orders"
        " UNION ALL SELECT o_orderkey, 'important', 'kept' FROM orders"
    )
    out["segment_cut"] = _q(
        GRID
        + """,
w AS (SELECT *, CASE WHEN i % 2 = 0 THEN c1 % 4 ELSE r1 % 4 END AS k, CASE WHEN i % 2 = 0 THEN 2 * (r1 * 1000 + c1 // 4) ELSE 2 * ((r1 // 4) * 1000 + c1) + 1 END AS way FROM seg),
v AS (SELECT way, 2*k AS pos, r1*1000+c1 AS node, x1 AS x, y1 AS y FROM w UNION SELECT way, 2*k+1, -1-i, (x1+x2)/2, (y1+y2)/2 FROM w UNION SELECT way, 2*k+2, r2*1000+c2, x2, y2 FROM w),
n AS (SELECT *, count(*) OVER (PARTITION BY node) AS uses, lead(x) OVER a AS nx, lead(y) OVER a AS ny, row_number() OVER a AS rn FROM v WINDOW a AS (PARTITION BY way ORDER BY pos)),
s AS (SELECT *, 1 + sum((uses > 1 AND rn > 1)::INT) OVER (PARTITION BY way ORDER BY pos) AS seg_no FROM n)""",
        "SELECT way AS osm_id, seg_no::INTEGER AS seg_no, (count(*) + 1)::INTEGER AS vertices, sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)))::DECIMAL(9,4) AS distance FROM s WHERE nx IS NOT NULL GROUP BY way, seg_no",
    )
    out["address_points"] = (
        f"WITH {_ADDR} SELECT id, '32' || x::DECIMAL(9,1)::VARCHAR AS coor_easting, y::DECIMAL(18,2)::VARCHAR AS coor_northing, x, y FROM addr"
    )
    out["edge_length"] = _q(
        AXES,
        "SELECT 'community' AS data_basis, i::VARCHAR AS id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))::DECIMAL(9,4) AS distance FROM ax UNION ALL"
        " SELECT 'authority', 'A' || num, (sqrt((ax2-ax1)*(ax2-ax1)+(ay2-ay1)*(ay2-ay1)) + sqrt((ax3-ax2)*(ax3-ax2)+(ay3-ay2)*(ay3-ay2)))::DECIMAL(9,4) FROM ax",
    )
    out["speed_community"] = _q(WAYS, f"SELECT edge_id, {_SPEED} AS maxspeed FROM ways")
    out["speed_authority"] = _q(
        AXES,
        f"SELECT gml AS gml_id, widmung, {_DEDICATION} AS maxspeed FROM street",
    )
    out["weights_community"] = _q(EDGES, f"SELECT edge_id, {_LEN} AS distance, {_SEC('w')} AS weights_car, {_SEC('wr')} AS weights_car_reverse FROM cw")
    out["weights_authority"] = _q(AUTH, f"SELECT edge_id, {_LEN} AS distance, v AS maxspeed, {_SEC('w')} AS weights_car, {_SEC('w')} AS weights_car_reverse FROM aw")
    shut = lambda way: f"(CASE WHEN way IS {way} THEN -1 ELSE w / 100.0 END)::DECIMAL(8,2)"
    out["weights_oneway"] = _q(
        AUTH + f", patch AS ({patch})",
        f"SELECT edge_id, way AS fahrtrichtung, {shut('NOT DISTINCT FROM false')} AS weights_car, {shut('NOT DISTINCT FROM true')} AS weights_car_reverse"
        " FROM aw LEFT JOIN patch ON patch.o_custkey = aw.edge_id",
    )
    out["extents"] = _q(AXES + _EXTENT, "SELECT 'authority' AS data_basis, xmin, ymin, xmax, ymax FROM ea UNION ALL SELECT 'community', xmin, ymin, xmax, ymax FROM ec")

    def inset(d, t):
        left = f"(xmin + {d} < xmax - {d} AND ymin + {d} < ymax - {d})"
        return "SELECT {}, " + ", ".join(f"CASE WHEN {left} THEN {c} END" for c in (f"xmin + {d}", f"ymin + {d}", f"xmax - {d}", f"ymax - {d}")) + f" FROM {t}"

    out["boxes_common"] = _q(
        AXES + _EXTENT,
        "SELECT 'outer_bbox' AS purpose, xmin, ymin, xmax, ymax FROM common UNION ALL " + inset(1500, "common").format("'inner_bbox'")
        + " UNION ALL " + inset(2500, "common").format("'address_bbox'"),
    )
    out["boxes_given"] = _q(
        AXES + _GIVEN,
        f"SELECT 'outer_bbox' AS purpose, {_BOX[0]}::DOUBLE AS xmin, {_BOX[1]}::DOUBLE AS ymin, {_BOX[2]}::DOUBLE AS xmax, {_BOX[3]}::DOUBLE AS ymax"
        " UNION ALL SELECT 'inner_bbox', xmin, ymin, xmax, ymax FROM bx UNION ALL " + inset(1000, "bx").format("'address_bbox'"),
    )
    out["bbox_filter"] = _q(
        AXES + _GIVEN + ", " + _ADDR,
        "SELECT 'road' AS kind, edge_id AS id FROM seg, bx WHERE least(x1,x2) <= xmax AND greatest(x1,x2) >= xmin AND least(y1,y2) <= ymax AND greatest(y1,y2) >= ymin"
        " UNION ALL SELECT 'address', id FROM addr, bx WHERE xmin + 1000 < xmax - 1000 AND ymin + 1000 < ymax - 1000 AND x BETWEEN xmin + 1000 AND xmax - 1000 AND y BETWEEN ymin + 1000 AND ymax - 1000",
    )
    out["clip_length"] = _clip()
    out["reproject_4326"] = _utm("SELECT c_custkey AS id, 7.0::DOUBLE + (c_custkey * 37 % 4000) / 1000.0::DOUBLE AS lon, 51.5::DOUBLE + (c_custkey * 91 % 3000) / 1000.0::DOUBLE AS lat FROM customer")
    out["reproject_3857"] = _utm(
        "SELECT c_custkey AS id, degrees((780000 + c_custkey * 37 % 440000)::DOUBLE / 6378137.0::DOUBLE) AS lon,"
        " degrees(2 * atan(exp((6700000 + c_custkey * 91 % 500000)::DOUBLE / 6378137.0::DOUBLE)) - pi() / 2) AS lat FROM customer"
    )
    out["topology_nodes"] = _q(CHECK, "SELECT node_id, x::DECIMAL(14,3) AS x, y::DECIMAL(14,3) AS y, cnt FROM nd")
    out["topology_edges"] = _q(CHECK, "SELECT edge_id, source, target FROM te")
    out["node_degree"] = _q(CHECK, "SELECT cnt AS degree, count(*) AS nodes FROM nd GROUP BY cnt")
    out["dead_ends"] = _q(CHECK, "SELECT node_id FROM nd WHERE cnt = 1")
    out["isolated_edges"] = _q(CHECK, "SELECT edge_id FROM te WHERE cnt = 1")
    out["rings"] = _q(CHECK, f"SELECT edge_id FROM {_RING}")
    out["crossings"] = _q(CHECK + _CROSS, "SELECT edge_a, edge_b FROM xs")
    out["gaps"] = _q(CHECK + _GAPS, "SELECT node_id, edge_id FROM gp")
    out["topology_report"] = _q(
        CHECK + _CROSS + _GAPS,
        "SELECT 'isolated' AS \"check\", count(*) AS n FROM te WHERE cnt = 1 UNION ALL SELECT 'dead_ends', count(*) FROM nd WHERE cnt = 1"
        " UNION ALL SELECT 'gaps', count(DISTINCT node_id) FROM gp UNION ALL SELECT 'intersections', count(*) FROM xs"
        f" UNION ALL SELECT 'rings', count(*) FROM {_RING} UNION ALL SELECT 'null_rows', 0",
    )
    both = ["", "no", "yes"]
    out["oneway_check"] = _oneway(both, both, both, both)
    back, forth = ["", "no", "-1"], ["", "no", "yes", "true", "1"]
    out["oneway_check_strict"] = _oneway(back, forth, forth, back)
    out["serial_ids"] = "SELECT row_number() OVER (ORDER BY c_name DESC) AS serial, c_custkey FROM customer"
    out["sample_points"] = (
        f"WITH {_ADDR} SELECT row_number() OVER (ORDER BY md5('7:' || id), id) AS id, id AS address_id, x, y FROM addr ORDER BY md5('7:' || addr.id), addr.id LIMIT 100"
    )
    pairs = "pr AS (SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // 2 + 1 AS pair_id FROM customer), pp AS (SELECT pair_id, min(id) AS start_id, max(id) AS dest_id FROM pr GROUP BY pair_id HAVING count(*) = 2)"
    out["od_pairs"] = f"WITH {pairs} SELECT pair_id, start_id, dest_id FROM pp"
    out["missing_points"] = f"WITH {pairs} SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT start_id FROM pp)"
    out["next_route_id"] = "SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(c_custkey) FROM customer)) + 1 AS next_id"
    out["nearest_edge"] = _q(
        GRID + _near("seg"),
        "SELECT point_id, edge_id, 1::INTEGER AS seg_no, dist::DECIMAL(9,4) AS dist, qx::DECIMAL(14,3) AS qx, qy::DECIMAL(14,3) AS qy FROM near",
    )
    out["nearest_node"] = _q(
        GRID + _near("seg") + """,
nodes AS (SELECT x, y, min(k) AS node_id FROM (SELECT x1 AS x, y1 AS y, 2 * i AS k FROM seg UNION ALL SELECT x2, y2, 2 * i + 1 FROM seg) GROUP BY x, y),
nn AS (SELECT point_id, min(struct_pack(d := sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)), n := node_id)) AS b FROM near, nodes
  WHERE x BETWEEN qx - 25 AND qx + 25 AND sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)) <= 25 GROUP BY point_id)""",
        "SELECT point_id, b.n AS node_id, b.d::DECIMAL(9,4) AS node_dist FROM nn",
    )
    out["split_edges"] = _split()
    out["snapped_points"] = _snapped_points()
    out["restriction_remap"] = _remapped()
    out["snapped_network"] = _snapped_network()
    out["route_steps"] = _route_steps("authority")
    out["turn_route_steps"] = _route_steps("community")
    out["route_status"] = _route_status()
    out["catchment_community"] = _catchment("community")
    out["catchment_authority"] = _catchment("authority")
    out["catchment_both"] = _catchment_both()
    out["line_overlap"] = _overlap(2.0)
    out["line_hausdorff"] = _hausdorff()
    out["line_frechet"] = _frechet()
    out["chain_hausdorff"] = _chain_hausdorff()
    out["merged_lines"] = _q(
        GRID
        + """,
v AS (SELECT cust, i, k, CASE WHEN (st = 'F') = (k = 1) THEN x2 ELSE x1 END AS x, CASE WHEN (st = 'F') = (k = 1) THEN y2 ELSE y1 END AS y FROM seg, (VALUES (1), (2)) AS n(k)),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY cust ORDER BY i, k))""",
        "SELECT cust AS route_id, (count(*) FILTER (px IS NULL OR px <> x OR py <> y))::INTEGER AS vertices, coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))), 0)::DECIMAL(14,3) AS length FROM l GROUP BY cust",
    )
    mean = lambda e, t, n: f"round(avg({e}), {t.split(',')[1].rstrip(')')})::DECIMAL{t} AS {n}"
    out["route_means"] = "SELECT " + ", ".join(
        [
            mean("o_orderkey % 97 - 40", "(18,4)", "distance_diff"),
            mean("CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 31 END", "(12,2)", "driving_time_diff"),
            mean("o_custkey % 7", "(9,4)", "hook_length_diff"), mean("o_orderkey % 101", "(5,2)", "buffer"),
            mean("o_orderkey % 13", "(9,4)", "hausdorff_distance"), mean("o_orderkey % 17", "(9,4)", "frechet_distance"),
        ]
    ) + " FROM orders"
    out["key_audit"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    out["orphan_audit"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)"
    out["upsert_rows"] = (
        "WITH n AS (SELECT o_custkey * 2 AS k, max(o_orderpriority) AS v FROM orders GROUP BY 1)"
        " SELECT k, v FROM n UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT k FROM n)"
    )
    return out
