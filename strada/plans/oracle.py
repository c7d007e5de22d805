"""The same queries as plain SQL for an independent engine. Nothing here is shared with the DataFrame code but fixed values."""

from __future__ import annotations

from strada.functions.tags import CLASSES, COUNTRY_SPEEDS
from strada.operators.cost import PROFILES
from strada.plans.derived import CHEAP


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(12742000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))))"


def _bearing(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(atan2(sin(radians({d}-{b}))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-{b}))))"


def _whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


_BASE = f"""
g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS W, CAST(ceil(count(*) / ceil(sqrt(count(*)))) AS BIGINT) AS R FROM customer),
nodes AS (
  SELECT id, r, c, (48.0::DOUBLE + r*0.002::DOUBLE) + ((id*7919)%97)*0.000005::DOUBLE AS lat, (11.0::DOUBLE + c*0.003::DOUBLE) + ((id*104729)%89)*0.000005::DOUBLE AS lon,
    (CASE WHEN id%11=0 THEN 16 ELSE 0 END) + (CASE WHEN id%97=5 THEN 32 ELSE 0 END) + (CASE WHEN id%53=7 THEN 3 ELSE 0 END) AS tagflags
  FROM (SELECT c_custkey AS id, c_custkey // W AS r, c_custkey % W AS c FROM customer, g)),
refs AS (
  SELECT 1000+r AS way_id, c AS pos, id AS node, r*2 AS pk FROM nodes
  UNION ALL SELECT 5000+c, r, id, c*2+1 FROM nodes WHERE c%3=0),
nref AS (SELECT node, count(*) AS n, bool_or(pos = 0 OR pos = mx) AS is_end FROM (SELECT *, max(pos) OVER (PARTITION BY way_id) AS mx FROM refs) GROUP BY node),
w0 AS (
  SELECT k.way_id, p.p_partkey,
    CASE p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'SMALL' THEN 'service' WHEN 'MEDIUM' THEN 'tertiary' WHEN 'PROMO' THEN 'motorway' WHEN 'STANDARD' THEN 'primary' ELSE 'track' END AS class,
    CASE p_size%5 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 32 WHEN 4 THEN 100 ELSE 0 END AS max_speed,
    CASE p_partkey%7 WHEN 3 THEN 'yes' WHEN 5 THEN '-1' END AS oneway,
    CASE p_size%4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END AS surface,
    CASE WHEN p_size%10=7 THEN 38 ELSE 0 END AS height_dm,
    (CASE WHEN p_partkey%7 IN (3,5) THEN 1 ELSE 0 END) + (CASE WHEN p_partkey%13=6 THEN 2 ELSE 0 END) AS flags,
    CASE WHEN p_type='PROMO' THEN 24 ELSE 0 END AS access
  FROM (SELECT DISTINCT way_id, pk FROM refs) k JOIN part p ON p.p_partkey=k.pk),
ways AS (
  SELECT *, 1 AS dir FROM w0 WHERE coalesce(oneway,'no')<>'-1'
  UNION ALL SELECT *, -1 FROM w0 WHERE coalesce(oneway,'no')<>'yes'),
rr AS (
  SELECT f.way_id, f.pos, f.node, n.lat, n.lon, n.tagflags, k.n AS nr, lag(n.lat) OVER w AS plat, lag(n.lon) OVER w AS plon, lead(f.pos) OVER w AS nxt
  FROM refs f JOIN nodes n ON n.id=f.node JOIN nref k ON k.node=f.node WINDOW w AS (PARTITION BY f.way_id ORDER BY f.pos)),
r2 AS (SELECT *, coalesce({_whole(_hav("plat", "plon", "lat", "lon"))}, 0) AS d FROM rr),
r3 AS (SELECT *, CAST(sum(d) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM r2),
brk AS (SELECT * FROM r3 WHERE tagflags<>0 OR nr>=2 OR plat IS NULL OR nxt IS NULL),
seg0 AS (SELECT way_id, pos AS p0, node AS a, lead(pos) OVER w AS p1, lead(node) OVER w AS b, (lead(cum) OVER w) - cum AS dist_m FROM brk WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
seg AS (SELECT * FROM seg0 WHERE b IS NOT NULL),
en AS (
  SELECT s.way_id*8388608 + s.p0*2 + (CASE w.dir WHEN 1 THEN 0 ELSE 1 END) AS en_id, s.way_id, w.dir, CASE w.dir WHEN 1 THEN a ELSE b END AS from_node, CASE w.dir WHEN 1 THEN b ELSE a END AS to_node,
    s.p0, s.p1, s.dist_m, w.class, w.max_speed, w.surface, w.height_dm, w.flags, w.access
  FROM seg s JOIN ways w ON w.way_id=s.way_id),
pt AS (SELECT e.en_id, row_number() OVER (PARTITION BY e.en_id ORDER BY f.pos*e.dir) AS k, f.lat, f.lon FROM en e JOIN rr f ON f.way_id=e.way_id AND f.pos BETWEEN e.p0 AND e.p1),
pc AS (SELECT en_id, k, lat AS a, lon AS b, lead(lat) OVER w AS c, lead(lon) OVER w AS d, lead(k) OVER w AS nk FROM pt WINDOW w AS (PARTITION BY en_id ORDER BY k)),
piece AS (SELECT *, {_hav("a", "b", "c", "d")} AS len, {_bearing("a", "b", "c", "d")} AS brg, lead(nk) OVER (PARTITION BY en_id ORDER BY k) IS NULL AS is_last FROM pc WHERE nk IS NOT NULL),
piece2 AS (SELECT *, max(k) OVER (PARTITION BY en_id) AS mk FROM piece),
locs AS (SELECT s_suppkey AS loc, 48.0::DOUBLE + ((s_suppkey*37)%R)*0.002::DOUBLE + 0.0007::DOUBLE AS lat, 11.0::DOUBLE + ((s_suppkey*53)%W)*0.003::DOUBLE + 0.0011::DOUBLE AS lon FROM supplier, g),
restr AS (
  SELECT DISTINCT 1000+n.r AS from_way, n.id AS via, 5000+n.c AS to_way, o_orderpriority='1-URGENT' AS "only"
  FROM orders o JOIN nodes n ON n.id=o.o_custkey WHERE n.c%3=0 AND o_orderstatus='P' AND o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice < RESTRICTED),
tn0 AS (
  SELECT x.en_id AS from_en, y.en_id AS to_en, x.to_node AS via, x.way_id AS xw, y.way_id AS yw, n.tagflags, yb.brg - xb.brg + 540.0::DOUBLE AS v
  FROM en x JOIN en y ON y.from_node=x.to_node AND y.en_id<>x.en_id JOIN nodes n ON n.id=x.to_node
  JOIN piece2 xb ON xb.en_id=x.en_id AND xb.k=xb.mk JOIN piece2 yb ON yb.en_id=y.en_id AND yb.k=1),
turns AS (
  SELECT from_en, to_en, via, CAST(trunc(v - floor(v/360.0)*360.0 - 180.0) AS INTEGER) AS angle,
    CASE WHEN EXISTS (SELECT 1 FROM restr q WHERE q.via=t.via AND q.from_way=t.xw AND ((q."only" AND q.to_way<>t.yw) OR (NOT q."only" AND q.to_way=t.yw))) THEN 31 ELSE 0 END AS mask,
    (CASE WHEN tagflags & 16 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN tagflags & 32 <> 0 THEN 2 ELSE 0 END) AS flags
  FROM tn0 t)"""
_BASE = _BASE.replace("RESTRICTED", str(CHEAP))


def _with(select: str, more: str = "", recursive: str = "") -> str:
    return f"WITH {recursive} {_BASE}{',' + more if more else ''}\n{select}"


def _speed(p: str, override: str = "NULL") -> str:
    q = PROFILES[p]
    own = " ".join(f"WHEN '{k}' THEN {v}" for k, v in zip(CLASSES, q.speeds, strict=True))
    pct = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(q.surface_pct))
    default = f"coalesce({override}, CASE class {own} END)"
    open_ = f"(access & {q.mask}) = 0" + (f" AND NOT (height_dm > 0 AND {q.dims['h']} > height_dm)" if q.dims["h"] else "")
    return f"CASE WHEN {open_} AND {default} > 0 AND (CASE surface {pct} END) > 0 THEN greatest(1, CAST(floor(least(CASE WHEN max_speed > 0 THEN max_speed ELSE {default} END, {q.max_speed}) * (CASE surface {pct} END) / 100.0) AS INTEGER)) END"


def _ms(p: str, metres: str) -> str:
    return f"(CAST(floor({metres} * 3600.0::DOUBLE / speed) AS BIGINT) + CASE WHEN toll THEN CAST(floor({metres} * {PROFILES[p].toll_ms_per_km} / 1000.0) AS BIGINT) ELSE 0 END)"


def _usable(p: str, model: str, avoid_toll: bool = False) -> str:
    if model == "distance":
        return f"us AS (SELECT *, flags & 2 <> 0 AS toll, NULL::INTEGER AS speed, dist_m AS cost FROM en WHERE (access & {PROFILES[p].mask}) = 0)"
    return f"us0 AS (SELECT *, flags & 2 <> 0 AS toll, {_speed(p)} AS speed FROM en), us AS (SELECT *, {_ms(p, 'dist_m')} AS cost FROM us0 WHERE speed IS NOT NULL{' AND NOT toll' if avoid_toll else ''})"


def _turn(p: str, avoid_toll: bool = False) -> str:
    q = PROFILES[p]
    t = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (abs(CAST(angle AS DOUBLE)) - 30.0) / 150.0))"
    cost = f"(CASE WHEN flags & 1 <> 0 THEN {q.signal_ms} ELSE 0 END) + (CASE WHEN flags & 2 <> 0 THEN {q.booth_ms} ELSE 0 END) + CAST(floor({t} * {t} * {q.turn_ms}) AS BIGINT)"
    return f"CASE WHEN (mask & {q.mask}) = 0{' AND flags & 2 = 0' if avoid_toll else ''} THEN CAST({cost} AS BIGINT) END"


_SNAP = f"""
tt AS (
  SELECT l.loc, p.en_id, p.k, l.lat, l.lon, p.a, p.b, p.c, p.d, p.len, cos(radians((p.a+p.c)/2)) AS q
  FROM locs l JOIN us u ON true JOIN piece2 p ON p.en_id=u.en_id AND abs(p.a-l.lat) < 0.03 AND abs(p.b-l.lon) < 0.05),
t1 AS (SELECT *, (d-b)*q AS dx, c-a AS dy FROM tt),
t2 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((lon-b)*q*dx+(lat-a)*dy)/(dx*dx+dy*dy))) AS t FROM t1),
t3 AS (SELECT *, a+(c-a)*t AS y, b+(d-b)*t AS x FROM t2),
t4 AS (SELECT *, round({_hav("lat", "lon", "y", "x")}, 3) AS dd FROM t3),
t5 AS (SELECT * FROM t4 WHERE dd <= 1000 QUALIFY row_number() OVER (PARTITION BY loc, en_id ORDER BY dd, k) = 1),
t6 AS (SELECT * FROM t5 QUALIFY rank() OVER (PARTITION BY loc ORDER BY dd) = 1),
snaps AS (
  SELECT loc, en_id, dd AS distance_m, y AS lat, x AS lon, least(1.0::DOUBLE, (coalesce((SELECT sum(len ORDER BY k) FROM piece2 p WHERE p.en_id=t6.en_id AND p.k<t6.k), 0) + len*t) / (SELECT sum(len ORDER BY k) FROM piece2 p WHERE p.en_id=t6.en_id)) AS fraction
  FROM t6)"""


def _snapped(p: str, model: str) -> str:
    part = (lambda m: m) if model == "distance" else (lambda m: _ms(p, m))
    return f"""{_SNAP},
s0 AS (SELECT s.*, u.dist_m, u.speed, u.toll, {_whole("u.dist_m * fraction")} AS behind_m FROM snaps s JOIN us u ON u.en_id=s.en_id),
s1 AS (SELECT *, dist_m - behind_m AS ahead_m FROM s0),
sn AS (SELECT *, {part("ahead_m")} AS ahead, {part("behind_m")} AS behind FROM s1)"""


def _graph(p: str, model: str, avoid_toll: bool = False) -> str:
    turn = f"CASE WHEN (mask & {PROFILES[p].mask}) = 0 THEN 0::BIGINT END" if model == "distance" else _turn(p, avoid_toll)
    return f"""{_usable(p, model, avoid_toll)},
tc AS (SELECT from_en, to_en, {turn} AS turn FROM turns),
adj AS MATERIALIZED (SELECT t.from_en, t.to_en, t.turn, t.turn + u.cost AS cost, u.dist_m AS metres FROM tc t JOIN us u ON u.en_id=t.to_en JOIN us f ON f.en_id=t.from_en WHERE t.turn IS NOT NULL),
{_snapped(p, model)},
sn2 AS MATERIALIZED (SELECT * FROM sn),
sp(origin, en, w) USING KEY (origin, en) AS (
  SELECT loc, en_id, ahead*10000000 + ahead_m FROM sn2
  UNION
  (SELECT s.origin, a.to_en, min(s.w + a.cost*10000000 + a.metres) FROM sp s JOIN adj a ON a.from_en=s.en LEFT JOIN recurring.sp o ON o.origin=s.origin AND o.en=a.to_en
   WHERE o.w IS NULL OR s.w + a.cost*10000000 + a.metres < o.w GROUP BY s.origin, a.to_en))"""


def _matrix(p: str, model: str, avoid_toll: bool = False) -> str:
    part = (lambda m: m) if model == "distance" else (lambda m: _ms(p, m))
    return f"""{_graph(p, model, avoid_toll)},
mm AS (
  SELECT r.origin, q.loc AS goal, (r.w // 10000000) + a.turn + q.behind AS cost, (r.w % 10000000) + q.behind_m AS metres FROM sp r JOIN adj a ON a.from_en=r.en JOIN sn2 q ON q.en_id=a.to_en
  UNION ALL
  SELECT origin, goal, {part("mt")}, mt FROM (SELECT s.loc AS origin, q.loc AS goal, greatest(0, q.behind_m - s.behind_m) AS mt, s.speed, s.toll FROM sn2 s JOIN sn2 q ON q.en_id=s.en_id AND q.fraction >= s.fraction)),
mx AS (SELECT origin, goal, min(cost*10000000 + metres) AS w FROM mm GROUP BY origin, goal),
matrix AS (SELECT origin AS "from", goal AS "to", CAST(w // 10000000 AS BIGINT) AS duration_ms, CAST(w % 10000000 AS BIGINT) AS length_m FROM mx)"""


_LEGS = """legs AS (SELECT s.trip, s.leg, s."from", s."to", m.duration_ms, m.length_m FROM (SELECT loc // 5 AS trip, loc % 5 AS leg, loc AS "from", lead(loc) OVER (PARTITION BY loc // 5 ORDER BY loc % 5) AS "to" FROM locs) s JOIN matrix m ON m."from"=s."from" AND m."to"=s."to")"""


def _case(columns: dict[str, list], n: int) -> str:
    """Expected values by p_partkey % n, worked out by hand."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    cols = ", ".join(f"CASE p_partkey % {n} " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(vs)) + f" END AS {c}" for c, vs in columns.items())
    return f"SELECT p_partkey, {cols} FROM part"


def _morton(x: str, top: str) -> str:
    return f"{_whole(f'{x} * 2147483647.0::DOUBLE')}"


_COUNTRY = """
bb AS (SELECT max(lat) AS y, max(lon) AS x, min(lat) AS a, min(lon) AS b FROM nodes),
bl AS (SELECT n.id, n.lat, n.lon, y, a, b, (b+x)/2 + (n.lat-(a-0.05)) / ((y+0.05)-(a-0.05)) * ((b*3+x)/4 - (b+x)/2) AS line FROM nodes n, bb),
cn AS (SELECT id, CASE WHEN lon > line AND lat < y-0.01 THEN 'AT' WHEN lon < line AND NOT (lat > a+0.003 AND lon < b+0.007 AND lat-a < lon-b) THEN 'DE' END AS country FROM bl)"""

ORACLES = {
    "country_lookup": _with("SELECT id, country FROM cn", _COUNTRY),
    "traversal_with_countries": _with(
        f"SELECT en_id, country, speed, {_ms('car', 'dist_m')} AS cost FROM s1 WHERE speed IS NOT NULL",
        f"{_COUNTRY}, s0 AS (SELECT e.*, c.country, flags & 2 <> 0 AS toll, CASE WHEN c.country IS NULL THEN NULL WHEN class='tertiary' THEN 45 WHEN c.country='DE' AND class='residential' THEN 25 WHEN class='track' THEN CASE c.country WHEN 'DE' THEN 15 ELSE 12 END WHEN c.country='AT' AND class='primary' THEN 77 END AS o FROM en e JOIN cn c ON c.id=e.from_node), s1 AS (SELECT *, {_speed('car', 'o')} AS speed FROM s0)",
    ),
    "haversine_edges": _with(f"SELECT way_id, pos, d AS metres, round({_bearing('plat', 'plon', 'lat', 'lon')}, 5) AS bearing FROM r2 WHERE plat IS NOT NULL"),
    "distance_to_box": _with(f"SELECT loc, {_whole(_hav('lat', 'lon', 'greatest(y0, least(y1, lat))', 'greatest(x0, least(x1, lon))'))} AS metres FROM locs, (SELECT a+(b-a)/4 AS y0, b-(b-a)/4 AS y1, c+(e-c)/4 AS x0, e-(e-c)/4 AS x1 FROM (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM nodes))"),
    "morton_order": _with("""SELECT id, CAST(list_sum(list_transform(range(0, 31), lambda i: ((x >> i) & 1::BIGINT) * pow(2::DOUBLE, 2*i)::BIGINT + ((y >> i) & 1::BIGINT) * pow(2::DOUBLE, 2*i+1)::BIGINT)) AS BIGINT) AS morton
FROM (SELECT id, CAST(floor((lat + 90.0::DOUBLE) / 180.0::DOUBLE * 2147483647.0::DOUBLE) AS BIGINT) AS x, CAST(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 2147483647.0::DOUBLE) AS BIGINT) AS y FROM nodes)"""),
    "polyline_round_trip": _with("SELECT way_id, pos, round(round(lat*100000)/100000.0::DOUBLE, 5) AS lat, round(round(lon*100000)/100000.0::DOUBLE, 5) AS lon FROM rr"),
    "fixed_decimals": "SELECT c_custkey, CAST(round(c_acctbal*1000000) AS BIGINT) AS micros, CAST(CAST(round(c_acctbal*1000000) AS DECIMAL(24,6)) / 1000000 AS DECIMAL(24,6))::VARCHAR AS shown FROM customer".replace("CAST(CAST(round(c_acctbal*1000000) AS DECIMAL(24,6)) / 1000000 AS DECIMAL(24,6))::VARCHAR", "CAST(CAST(c_acctbal AS DECIMAL(24,6)) AS VARCHAR)"),
    "way_tags": _with("SELECT way_id, dir, class, surface, flags, access, max_speed, height_dm FROM ways"),
    "way_directional_access": _case({
        "excluded": [False, False, False, False, True, False, False, False, False, False, False, False, False, True, False, True, True, False, False, True, True],
        "forward": [7, 24, 8, 7, 31, 7, 15, 24, 31, 4, 16, 7, 7, 0, 0, 0, 23, 0, 7, 0, 0],
        "backward": [7, 24, 8, 7, 31, 7, 15, 24, 0, 4, 16, 7, 0, 0, 0, 0, 23, 0, 7, 0, 0],
        "class": ["footway", "motorway", "residential", "residential", "residential", "track", "bridleway", "primary", "residential", "residential", "service", "path", "cycleway", "unknown", "ferry", "residential", "residential", "residential", "pedestrian", "unknown", "residential"],
    }, 21),
    "way_flags": _case({"flags": [1, 1, 1, 1, 2, 4, 8, 0], "reverse": [False, True, False, False, False, False, False, False], "contraflow": [False, False, False, True, False, False, False, False]}, 8),
    "surface_quality": _case({"surface": [1, 2, 4, 3, 7, 0, 0, 6, 5]}, 9),
    "speed_parse": _case({"forward": [48, 50, 96, 0, 255, 60, 70, 7, 72, 50, 0, 0, COUNTRY_SPEEDS["US"][3]], "backward": [48, 50, 96, 0, 255, 80, 70, 7, 72, 50, 0, COUNTRY_SPEEDS["FR"][2], 104]}, 13),
    "dim_parse": _case({"h": [38, 38, 35, 0, 0, 0, 0, 0], "w": [0, 0, 0, 0, 23, 0, 0, 0], "l": [0, 0, 0, 0, 120, 0, 0, 0], "wt": [0, 0, 0, 30, 0, 0, 0, 14]}, 8),
    "node_flags": _case({"flags": [3, 7, 7, 16, 32, 7, 0, 4, 0]}, 9),
    "dangling_refs": _with("SELECT way_id, pos, node FROM refs WHERE node NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"),
    "node_ref_counts": _with("SELECT node, n AS n_refs, is_end, (CASE WHEN is_end THEN 64 ELSE 0 END) + (CASE WHEN n >= 2 THEN 128 ELSE 0 END) AS flags FROM nref"),
    "segments": _with("SELECT way_id, p0, p1, a, b, dist_m FROM seg"),
    "edge_nodes": _with("SELECT en_id, way_id, dir, from_node, to_node, dist_m, p1 - p0 + 1 AS n_points FROM en"),
    "edge_bbox": _with("SELECT en_id, round(min(lat), 6) AS min_lat, round(min(lon), 6) AS min_lon, round(max(lat), 6) AS max_lat, round(max(lon), 6) AS max_lon FROM pt GROUP BY en_id"),
    "restriction_rules": _with("SELECT from_way, via, to_way, \"only\" FROM restr"),
    "turn_edges": _with("SELECT from_en, to_en, via, angle, mask, flags FROM turns"),
    **{f"traversal_cost_{p}": _with("SELECT en_id, speed, cost FROM us", _usable(p, "time")) for p in PROFILES},
    "traversal_distance": _with("SELECT en_id, cost FROM us", _usable("foot", "distance")),
    "turn_cost": _with("SELECT from_en, to_en, " + ", ".join(f"coalesce({_turn(p)}, -1) AS {p}" for p in PROFILES) + f", coalesce({_turn('car', True)}, -1) AS car_no_toll FROM turns"),
    "country_speed_override": """
WITH given(c, v, class, kmh) AS (VALUES ('*','*','track',12), ('*','car','tertiary',45), ('DE','car','residential',25), ('DE','car','track',15), ('AT','*','primary',77)),
c(country) AS (VALUES ('AT'), ('CH'), ('DE')), v(vehicle) AS (VALUES ('car'), ('motorcycle'), ('hgv'), ('bike'), ('foot'))
SELECT country, vehicle, class, kmh FROM given JOIN c ON given.c IN ('*', country) JOIN v ON given.v IN ('*', vehicle)
QUALIFY row_number() OVER (PARTITION BY country, vehicle, class ORDER BY (given.c = '*')::INT, (given.v = '*')::INT) = 1""",
    "snap_with_ties": _with("SELECT loc, en_id, round(distance_m, 2) AS distance_m, round(lat, 5) AS lat, round(lon, 5) AS lon, round(fraction, 4) AS fraction FROM snaps", f"{_usable('car', 'time')},{_SNAP}"),
    "nearest_node": _with("SELECT loc, id, round(dd, 2) AS distance_m FROM (SELECT l.loc, n.id, round(" + _hav("l.lat", "l.lon", "n.lat", "n.lon") + ", 3) AS dd FROM locs l, nodes n) WHERE dd <= 500 QUALIFY rank() OVER (PARTITION BY loc ORDER BY dd) = 1"),
    "locate_meta": _with("""SELECT l.loc, round(round(f.distance_m / 1000.0, 6), 5) AS distance_km, e.way_id, CASE e.class WHEN 'residential' THEN 'Residential' WHEN 'service' THEN 'Service' WHEN 'tertiary' THEN 'Tertiary' WHEN 'motorway' THEN 'Motorway' WHEN 'primary' THEN 'Primary' WHEN 'track' THEN 'Track' END AS highway, e.dist_m, e.p1 - e.p0 + 1 AS n_points
FROM locs l LEFT JOIN (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY loc ORDER BY en_id) = 1) f ON f.loc = l.loc LEFT JOIN en e ON e.en_id = f.en_id""", f"{_usable('car', 'time')},{_SNAP}"),
    "sssp_time": _with("SELECT origin, en AS en_id, CAST(w // 10000000 AS BIGINT) AS cost, CAST(w % 10000000 AS BIGINT) AS metres FROM sp", _graph("car", "time"), "RECURSIVE"),
    "sssp_distance": _with("SELECT origin, en AS en_id, CAST(w // 10000000 AS BIGINT) AS cost, CAST(w % 10000000 AS BIGINT) AS metres FROM sp", _graph("foot", "distance"), "RECURSIVE"),
    "matrix_pairs": _with("SELECT * FROM matrix", _matrix("car", "time"), "RECURSIVE"),
    "matrix_bike_distance": _with("SELECT * FROM matrix", _matrix("bike", "distance"), "RECURSIVE"),
    "matrix_wanted_pairs": _with('SELECT * FROM matrix WHERE "to" - "from" IN (1, 2)', _matrix("car", "time"), "RECURSIVE"),
    "route_legs": _with("SELECT * FROM legs", f"{_matrix('car', 'time')}, {_LEGS}", "RECURSIVE"),
    "route_trip": _with("SELECT trip, count(*) AS n_legs, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(length_m) AS BIGINT) AS length_m FROM legs GROUP BY trip", f"{_matrix('hgv', 'time')}, {_LEGS}", "RECURSIVE"),
    "route_avoid_toll": _with("SELECT * FROM legs", f"{_matrix('car', 'time', True)}, {_LEGS}", "RECURSIVE"),
    "isochrone_reach": _with("SELECT origin AS loc, v.value, en AS en_id, CAST(w // 10000000 AS BIGINT) AS cost FROM sp JOIN (VALUES (1.0::DOUBLE, 60000), (2.0::DOUBLE, 120000)) v(value, most) ON w // 10000000 <= most", _graph("car", "time"), "RECURSIVE"),
    "info": "SELECT 'Ok' AS status, '0.1.0' AS version, 'car,hgv,bike,foot' AS profiles",
}
_REACH = ", ".join(f"round({end}({x}), 6) AS {end}_{k}" for k, x in {"lat": "lat", "lon": "lon", "sum": "lat + lon", "diff": "lat - lon"}.items() for end in ("min", "max"))
ORACLES["network_hull_reach"] = _with(f"SELECT way_id, {_REACH} FROM rr GROUP BY way_id")
ORACLES["isochrone_hull_reach"] = _with(
    f"SELECT origin AS loc, v.value, {_REACH} FROM sp JOIN (VALUES (0.5::DOUBLE, 500), (1.5::DOUBLE, 1500)) v(value, most) ON w // 10000000 <= most JOIN (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY en_id ORDER BY k DESC) = 1) e ON e.en_id = sp.en GROUP BY origin, v.value",
    _graph("foot", "distance"), "RECURSIVE",
)
ORACLES["stored_network"] = ORACLES["edge_nodes"]
ORACLES["inspect_way"] = _with(
    """SELECT w.way_id, upper(class[1]) || class[2:] AS highway, CASE surface WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Excellent' WHEN 2 THEN 'Good' WHEN 5 THEN 'VeryBad' END AS surface, flags & 2 <> 0 AS toll, flags & 1 <> 0 AS oneway, line.path
FROM (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY dir DESC) = 1) w JOIN line ON line.way_id = w.way_id""",
    """step AS (SELECT way_id, pos, unnest([CAST(round(lat*100000) AS BIGINT) - coalesce(CAST(round(plat*100000) AS BIGINT), 0), CAST(round(lon*100000) AS BIGINT) - coalesce(CAST(round(plon*100000) AS BIGINT), 0)]) AS v, unnest([0, 1]) AS axis FROM rr WHERE way_id = 1000),
code AS (SELECT *, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM step),
chars AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM code),
line AS (SELECT way_id, string_agg(chr(CAST(((z >> (5 * k)) & 31) + CASE WHEN z >> (5 * k + 5) > 0 THEN 95 ELSE 63 END AS INTEGER)), '' ORDER BY pos, axis, k) AS path FROM chars WHERE k = 0 OR z >> (5 * k) > 0 GROUP BY way_id)""",
)
ORACLES |= {f"legs_{a}": ORACLES["route_legs"] for a in ("dijkstra", "bidir_dijkstra", "a_star", "bidir_a_star")}
ORACLES["isochrone_reach_joins"] = ORACLES["isochrone_reach"]
