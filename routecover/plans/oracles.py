"""DuckDB SQL for the registered network queries."""

from __future__ import annotations

import re

from routecover.operators.filters import ROAD_CLASSES, TRAIL_CLASSES
from routecover.plans.fixtures import CLASSES

quoted = lambda names: ",".join(f"'{n}'" for n in names)
ROADS = quoted((*TRAIL_CLASSES, *ROAD_CLASSES))


def haversine(a: str, b: str, c: str, d: str) -> str:
    """SQL for the metres between (lat a, lng b) and (lat c, lng d)."""
    half = lambda x, y: f"sin(radians(({y}) - ({x})) / 2)"
    h = f"({half(a, c)} * {half(a, c)} + cos(radians({a})) * cos(radians({c})) * {half(b, d)} * {half(b, d)})"
    return f"(2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h})))"


POINTS = f"""
s1 AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem),
s2 AS (SELECT *, CASE WHEN seq = 1 THEN l_orderkey * 7919 % 40 * 500 ELSE ((l_partkey * 31 + seq * 17) % 41 - 20) * 100 END AS dx,
              CASE WHEN seq = 1 THEN l_orderkey * 104729 % 41 * 500 ELSE ((l_suppkey * 37 + seq * 13) % 41 - 20) * 100 END AS dy FROM s1),
pts AS (SELECT o_custkey // 15 AS area_id, l_orderkey AS feature_id, (seq - 1)::INTEGER AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n,
               (-105000000 + (o_custkey // 15) % 32 * 40000 + sum(dx) OVER w)::BIGINT AS xe, (40000000 + (o_custkey // 15) // 32 * 40000 + sum(dy) OVER w)::BIGINT AS ye
        FROM s2 JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, xe / 1e6 AS lng, ye / 1e6 AS lat FROM pts),
seg AS (SELECT * FROM (SELECT area_id, feature_id AS f, seq AS i, lng AS x1, lat AS y1, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2
        FROM p WINDOW w AS (PARTITION BY feature_id ORDER BY seq)) WHERE x2 IS NOT NULL),
way AS (SELECT o_custkey // 15 AS area_id, o_orderkey AS feature_id,
               ([{quoted(CLASSES)}])[o_orderkey % 16 + 1] AS highway,
               o_orderkey % 5 = 0 AS sidewalk, o_orderkey % 37 = 0 AS is_area, o_orderkey % 41 = 0 AS indoor FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
"""
LENGTHS = f"""len AS (SELECT f AS feature_id, sum({haversine('y1', 'x1', 'y2', 'x2')}) AS m FROM seg GROUP BY f),
size AS (SELECT feature_id, count(*) AS n FROM p GROUP BY feature_id)"""
NODE = lambda x, y: f"((floor(({y}) * 1e6 + 0.5)::BIGINT + 90000000) * 400000000 + floor(({x}) * 1e6 + 0.5)::BIGINT + 180000000)"
ROUTE = f"""wy AS (SELECT area_id, feature_id, arg_min({NODE('lng', 'lat')}, seq) AS a, arg_max({NODE('lng', 'lat')}, seq) AS b, max(n) AS n, row_number() OVER (PARTITION BY area_id ORDER BY feature_id) - 1 AS k FROM p WHERE n > 1 GROUP BY area_id, feature_id),
lastw AS (SELECT * FROM wy QUALIFY row_number() OVER (PARTITION BY area_id, least(a, b), greatest(a, b) ORDER BY feature_id DESC) = 1),
walk AS (SELECT area_id, 2 * k AS step, a AS u, b AS v FROM wy UNION ALL SELECT area_id, 2 * k + 1, b, a FROM wy),
sg AS (SELECT w.*, l.feature_id, l.n, l.a = w.u AS forth, row_number() OVER (PARTITION BY w.area_id, least(u, v), greatest(u, v) ORDER BY step) > 1 AS retraced
  FROM walk w JOIN lastw l ON l.area_id = w.area_id AND least(l.a, l.b) = least(u, v) AND greatest(l.a, l.b) = greatest(u, v)),
rp AS (SELECT sg.area_id, step, CASE WHEN forth THEN seq ELSE sg.n - 1 - seq END AS j, lng, lat FROM sg JOIN p USING (feature_id))"""
CROSS = f"""
b AS (SELECT *, least(x1, x2) AS lx, greatest(x1, x2) AS hx, least(y1, y2) AS ly, greatest(y1, y2) AS hy, x2 - x1 AS ex, y2 - y1 AS ey FROM seg),
pr AS (SELECT a.area_id, a.f AS a_ord, a.i AS a_idx, c.f AS b_ord, c.i AS b_idx, a.x1, a.y1, a.ex, a.ey, a.ex * c.ey - a.ey * c.ex AS den,
              (c.x1 - a.x1) * c.ey - (c.y1 - a.y1) * c.ex AS tn, (c.x1 - a.x1) * a.ey - (c.y1 - a.y1) * a.ex AS un
       FROM b a JOIN b c ON a.area_id = c.area_id AND (a.f < c.f OR a.f = c.f AND a.i < c.i) AND a.lx <= c.hx AND a.hx >= c.lx AND a.ly <= c.hy AND a.hy >= c.ly),
hit AS (SELECT area_id, a_ord, a_idx, b_ord, b_idx, x1 + tn / den * ex AS px, y1 + tn / den * ey AS py FROM pr WHERE abs(den) >= 1e-12 AND tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1),
allx AS (SELECT *, {NODE('px', 'py')} AS node FROM hit),
firstx AS (SELECT * FROM allx QUALIFY row_number() OVER (PARTITION BY area_id, node ORDER BY a_ord, a_idx, b_ord, b_idx) = 1)
"""
GRAPH = f"""
cutp AS (SELECT area_id, f, i, 0 AS part, 0e0 AS d, x1 AS x, y1 AS y FROM seg
         UNION ALL SELECT area_id, f, i, 2, 0e0, x2, y2 FROM seg
         UNION ALL SELECT area_id, f, i, 1, {haversine('y1', 'x1', 'py', 'px')}, px, py FROM
           (SELECT DISTINCT s.*, q.px, q.py FROM seg s JOIN (SELECT area_id, a_ord AS f, a_idx AS i, px, py FROM firstx UNION ALL SELECT area_id, b_ord, b_idx, px, py FROM firstx) q USING (area_id, f, i))),
pc AS (SELECT * FROM (SELECT area_id, f, i, (row_number() OVER w - 1)::INTEGER AS j, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb
       FROM cutp WINDOW w AS (PARTITION BY area_id, f, i ORDER BY part, d, x, y)) WHERE xb IS NOT NULL),
pe AS (SELECT *, {NODE('xa', 'ya')} AS u, {NODE('xb', 'yb')} AS v, {haversine('ya', 'xa', 'yb', 'xb')} AS weight FROM pc),
nd AS (SELECT area_id, node, arg_min(y, (f, i, j, e)) AS lat, arg_min(x, (f, i, j, e)) AS lng FROM
       (SELECT area_id, u AS node, f, i, j, 0 AS e, xa AS x, ya AS y FROM pe UNION ALL SELECT area_id, v, f, i, j, 1, xb, yb FROM pe) GROUP BY area_id, node),
ed AS (SELECT * FROM pe WHERE u <> v AND weight >= 0.1),
adj AS (SELECT area_id, u, v, min(weight) AS weight FROM (SELECT area_id, u, v, weight FROM ed UNION ALL SELECT area_id, v, u, weight FROM ed) GROUP BY area_id, u, v),
deg AS (SELECT area_id, u AS node, count(*) AS degree FROM adj GROUP BY area_id, u)
"""
def _key(n: str) -> str:
    exact = lambda e: f"regexp_replace(regexp_replace(printf('%s%d.%06d', CASE WHEN ({e}) < 0 THEN '-' ELSE '' END, abs({e}) // 1000000, abs({e}) % 1000000), '0+$', ''), '\\.$', '')"
    return f"concat({exact(f'({n}) // 400000000 - 90000000')}, ',', {exact(f'({n}) % 400000000 - 180000000')})"


EDGE_ID = f"concat(least({_key('u')}, {_key('v')}), '|', greatest({_key('u')}, {_key('v')}))"
HEIGHTS = """h AS (SELECT p.*, (ye - xe) % 31 <> 0 AS sampled, CASE WHEN (ye - xe) % 31 <> 0 THEN 1500 + (ye * 7 - xe * 3) % 997 / 10.0 ELSE 0.0 END::DOUBLE AS elev FROM p WHERE n > 1)"""
PROFILE = f"""st AS (SELECT *, coalesce({haversine('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0) AS step FROM h WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
pf AS (SELECT *, sum(step) OVER (PARTITION BY feature_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dist FROM st)"""
CLIMB = """cl AS (SELECT area_id, feature_id, list_reduce(list_transform(hs, lambda x: {'b': x, 'a': 0.0::DOUBLE, 'd': 0.0::DOUBLE}), lambda s, x:
    {'b': CASE WHEN abs(x.b - s.b) >= 2 THEN x.b ELSE s.b END, 'a': s.a + CASE WHEN x.b - s.b >= 2 THEN x.b - s.b ELSE 0 END, 'd': s.d + CASE WHEN s.b - x.b >= 2 THEN s.b - x.b ELSE 0 END}) AS g
  FROM (SELECT area_id, feature_id, list(elev ORDER BY seq) AS hs FROM h GROUP BY area_id, feature_id))"""
TIMES = """sm AS (SELECT *, avg(elev) OVER (PARTITION BY feature_id ORDER BY dist RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS smooth FROM pf),
gr AS (SELECT *, CASE WHEN step > 0.001 THEN (smooth - lag(smooth) OVER w) / step ELSE 0 END AS grade, lag(smooth) OVER w AS before FROM sm WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
tm AS (SELECT area_id, feature_id, sum(step) AS length, sum(step / greatest(6 * exp(-3.5 * abs(grade + 0.05)) / 3.6, 0.1)) AS forward,
       sum(step / greatest(6 * exp(-3.5 * abs(0.05 - grade)) / 3.6, 0.1)) AS reverse FROM gr WHERE before IS NOT NULL GROUP BY area_id, feature_id)"""
ASKED = "asked AS (SELECT area_id, feature_id AS route_id, q::INTEGER AS query_id, ((feature_id * 37 + q * 311) % 4000)::DOUBLE AS d FROM (SELECT DISTINCT area_id, feature_id FROM p WHERE n > 1), range(4) t(q))"
CORNERS = "ar AS (SELECT DISTINCT o_custkey // 15 AS area_id FROM orders), box AS (SELECT area_id, (-105000000 + area_id % 32 * 40000) / 1e6 AS west, (40000000 + area_id // 32 * 40000) / 1e6 AS south FROM ar)"
EVENT_POINTS = """ev AS (SELECT event_id AS point_id, user_id % (SELECT max(o_custkey // 15) + 1 FROM orders) AS area_id FROM events WHERE user_id IS NOT NULL),
ep AS (SELECT point_id, area_id, (-105000000 + area_id % 32 * 40000 + point_id * 7919 % 20000) / 1e6 AS lng, (40000000 + area_id // 32 * 40000 + point_id * 104729 % 20000) / 1e6 AS lat FROM ev)"""
COMPONENTS = """lab AS (
  WITH RECURSIVE r(area_id, node, c) USING KEY (area_id, node) AS (
    SELECT area_id, node, node FROM nd
    UNION SELECT a.area_id, a.v, min(r.c) FROM r JOIN adj a ON a.area_id = r.area_id AND a.u = r.node JOIN recurring.r t ON t.area_id = a.area_id AND t.node = a.v AND r.c < t.c GROUP BY a.area_id, a.v
  ) SELECT * FROM r)"""


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


STARTS = f"st AS (SELECT area_id, arg_min({NODE('lng', 'lat')}, (feature_id, seq)) AS node FROM p WHERE n > 1 GROUP BY area_id)"


def linked(name: str, nodes: str, links: str) -> str:
    """SQL for ``name(area_id, node, c)``: the least node reachable over ``links`` from each of ``nodes``."""
    return f"""{name} AS (
  WITH RECURSIVE r(area_id, node, c) USING KEY (area_id, node) AS (
    SELECT area_id, node, node FROM {nodes}
    UNION SELECT a.area_id, a.v, min(r.c) FROM r JOIN {links} a ON a.area_id = r.area_id AND a.u = r.node JOIN recurring.r t ON t.area_id = a.area_id AND t.node = a.v AND r.c < t.c GROUP BY a.area_id, a.v
  ) SELECT * FROM r)"""


def logical(kept: str = "") -> str:
    """SQL for ``lge(area_id, u, v, weight, points, c)``, the logical edges, and ``gone``, the contracted nodes; ``kept`` names a table of nodes that stay."""
    stays = f"AND NOT EXISTS (SELECT 1 FROM {kept} k WHERE k.area_id = deg.area_id AND k.node = deg.node)" if kept else ""
    within = lambda t: f"(SELECT a.area_id, a.u, a.v FROM adj a JOIN {t} x ON x.area_id = a.area_id AND x.node = a.u JOIN {t} y ON y.area_id = a.area_id AND y.node = a.v)"
    return f"""ords AS (SELECT area_id, node, min((f, i, j, e)) AS o FROM (SELECT area_id, u AS node, f, i, j, 0 AS e FROM pe UNION ALL SELECT area_id, v, f, i, j, 1 FROM pe) GROUP BY area_id, node),
inr AS (SELECT deg.area_id, deg.node, o FROM deg JOIN ords USING (area_id, node) WHERE degree = 2 {stays}),
ia AS {within('inr')},
{linked('chl', 'inr', 'ia')},
anc AS (SELECT l.area_id, l.c, min(a.v) AS p, max(a.v) AS q FROM chl l JOIN adj a ON a.area_id = l.area_id AND a.u = l.node ANTI JOIN inr x ON x.area_id = a.area_id AND x.node = a.v GROUP BY l.area_id, l.c),
chn AS (SELECT area_id, c, max(o) AS last FROM chl JOIN inr USING (area_id, node) GROUP BY area_id, c),
kp AS (SELECT chn.area_id, chn.c, CASE WHEN p IS NULL THEN 3 WHEN p = q THEN 2 WHEN adj.u IS NULL AND row_number() OVER (PARTITION BY chn.area_id, p, q ORDER BY last) = 1 THEN 0 ELSE 1 END AS keep
       FROM chn LEFT JOIN anc ON anc.area_id = chn.area_id AND anc.c = chn.c LEFT JOIN adj ON adj.area_id = anc.area_id AND adj.u = anc.p AND adj.v = anc.q),
gone AS (SELECT area_id, node FROM (SELECT area_id, node, keep, row_number() OVER (PARTITION BY area_id, c ORDER BY o DESC) AS late FROM chl JOIN inr USING (area_id, node) JOIN kp USING (area_id, c)) WHERE late > keep),
ga AS {within('gone')},
{linked('gl', 'gone', 'ga')},
runs AS (SELECT l.area_id, l.c, l.node, a.v AS other, a.weight, x.node IS NOT NULL AS inside FROM gl l JOIN adj a ON a.area_id = l.area_id AND a.u = l.node LEFT JOIN gone x ON x.area_id = a.area_id AND x.node = a.v),
lge AS (SELECT area_id, min(other) FILTER (NOT inside) AS u, max(other) FILTER (NOT inside) AS v, sum(CASE WHEN inside THEN weight / 2 ELSE weight END) AS weight, count(DISTINCT node) + 2 AS points, c FROM runs GROUP BY area_id, c
        UNION ALL SELECT area_id, u, v, weight, 2, NULL FROM adj a ANTI JOIN gone x ON x.area_id = a.area_id AND x.node = a.u ANTI JOIN gone y ON y.area_id = a.area_id AND y.node = a.v WHERE a.u < a.v)"""


def removals_in_order(positions: int) -> str:
    """SQL for the edges left when the first logical ids of each area go one after the other, raw edges after the first; each step contracts the edges that are left anew."""
    own = r"\b(adj|deg|ords|inr|ia|chl|anc|chn|kp|gone|ga|gl|runs|lge)\b(?=[ ,.);\n]|$)"
    parts = [*NET, logical(), f"want AS (SELECT area_id, edge_id, row_number() OVER (PARTITION BY area_id ORDER BY edge_id) AS n FROM (SELECT *, {EDGE_ID} AS edge_id FROM lge))"]
    for k in range(1, positions + 1):
        n, before = (str(k), str(k - 1)) if k > 1 else ("", "")
        if k > 1:
            raw = "AND NOT EXISTS (SELECT 1 FROM ed r WHERE r.f % 97 = 0 AND r.area_id = o.area_id AND least(r.u, r.v) = least(o.u, o.v) AND greatest(r.u, r.v) = greatest(o.u, o.v))" if k == 2 else ""
            before = before if k > 2 else ""
            parts.append(f"""ed{n} AS (SELECT o.* FROM ed{before} o WHERE NOT EXISTS (SELECT 1 FROM hit{before}x h WHERE h.area_id = o.area_id AND h.f = o.f AND h.i = o.i AND h.j = o.j) {raw}),
            adj{n} AS (SELECT area_id, u, v, min(weight) AS weight FROM (SELECT area_id, u, v, weight FROM ed{n} UNION ALL SELECT area_id, v, u, weight FROM ed{n}) GROUP BY area_id, u, v),
            deg{n} AS (SELECT area_id, u AS node, count(*) AS degree FROM adj{n} GROUP BY area_id, u)""")
            parts.append(re.sub(own, rf"\g<1>{n}", logical()))
        parts.append(f"""pick{n} AS (SELECT l.* FROM (SELECT *, {EDGE_ID} AS edge_id FROM lge{n}) l JOIN want w ON w.area_id = l.area_id AND w.edge_id = l.edge_id AND w.n = {k}),
        onp{n} AS (SELECT area_id, u AS node FROM pick{n} UNION SELECT area_id, v FROM pick{n} UNION SELECT g.area_id, node FROM pick{n} x JOIN gl{n} g ON g.area_id = x.area_id AND g.c = x.c),
        hit{n}x AS (SELECT e.area_id, f, i, j FROM ed{n} e JOIN onp{n} a ON a.area_id = e.area_id AND a.node = e.u JOIN onp{n} b ON b.area_id = e.area_id AND b.node = e.v)""")
    return query(*parts, select=f"SELECT area_id, count(*) AS edges, round(sum(weight), 2) AS metres FROM ed{n} ANTI JOIN hit{n}x USING (area_id, f, i, j) GROUP BY area_id")


#: ``lgp(area_id, u, v, pts)``: the points of every logical edge from its lesser end, each raw edge the shortest of its pair.
LOGICAL_POINTS = """ae AS (SELECT area_id, u, v, arg_min({'ax': xa, 'ay': ya, 'bx': xb, 'by': yb}, (weight, f, i, j)) AS e
  FROM (SELECT area_id, u, v, weight, f, i, j, xa, ya, xb, yb FROM ed UNION ALL SELECT area_id, v, u, weight, f, i, j, xb, yb, xa, ya FROM ed) GROUP BY area_id, u, v),
wk AS (
  WITH RECURSIVE w(area_id, u, c, prev, node, pts) AS (
    SELECT l.area_id, l.u, l.c, l.u, r.node, [[e.ax, e.ay], [e.bx, e.by]] FROM lge l JOIN runs r ON r.area_id = l.area_id AND r.c = l.c AND r.other = l.u AND NOT r.inside JOIN ae ON ae.area_id = l.area_id AND ae.u = l.u AND ae.v = r.node
    UNION ALL SELECT w.area_id, w.u, w.c, w.node, ae.v, list_append(w.pts, [e.bx, e.by]) FROM w JOIN gone g ON g.area_id = w.area_id AND g.node = w.node JOIN ae ON ae.area_id = w.area_id AND ae.u = w.node AND ae.v <> w.prev
  ) SELECT * FROM w ANTI JOIN gone USING (area_id, node)),
lgp AS (SELECT area_id, u, node AS v, pts FROM wk UNION ALL SELECT l.area_id, l.u, l.v, [[e.ax, e.ay], [e.bx, e.by]] FROM lge l JOIN ae ON ae.area_id = l.area_id AND ae.u = l.u AND ae.v = l.v WHERE l.c IS NULL)"""


DISTANCES = """dd AS (
  WITH RECURSIVE r(area_id, node, d) USING KEY (area_id, node) AS (
    SELECT area_id, node, 0e0 FROM st
    UNION SELECT a.area_id, a.v, min(r.d + a.weight) FROM r JOIN adj a ON a.area_id = r.area_id AND a.u = r.node LEFT JOIN recurring.r t ON t.area_id = a.area_id AND t.node = a.v
      WHERE t.d IS NULL OR r.d + a.weight < t.d GROUP BY a.area_id, a.v
  ) SELECT * FROM r)"""


def covering(more: str = "") -> str:
    """SQL for what holds of any covering route over the logical graph around the starts."""
    return query(*NET, COMPONENTS, STARTS, logical("st"), """whole AS (SELECT area_id, sum(weight) AS m FROM lge GROUP BY area_id),
        comps AS (SELECT area_id, count(DISTINCT c) AS k FROM lab GROUP BY area_id),
        own AS (SELECT st.area_id, any_value(st.node) AS start, count(*) AS edges FROM st JOIN lab s USING (area_id, node) JOIN lab l ON l.area_id = s.area_id AND l.c = s.c JOIN lge ON lge.area_id = l.area_id AND lge.u = l.node GROUP BY st.area_id)""",
        select=f"""SELECT area_id, start, edges, true AS at_most_twice, true AS contiguous, true AS closed, true AS bounded, {more} round(m, 2) AS unique_m,
        CASE WHEN k > 1 THEN (k - 1)::VARCHAR || ' disconnected component' || CASE WHEN k > 2 THEN 's' ELSE '' END || ' not reachable from start point.' END AS warning FROM own JOIN whole USING (area_id) JOIN comps USING (area_id)""")


#: The text of a GPX document around its points.
GPX_TOP = """<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="routecover" xmlns="http://www.topografix.com/GPX/1/1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">\n  <metadata>\n    """
NET = (POINTS, CROSS, GRAPH)
ORACLES: dict[str, str] = {
    "trail_summary": query(POINTS, LENGTHS, select=f"""SELECT area_id, count(*) FILTER (n > 1) AS trail_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS vertex_count, round(sum(coalesce(m, 0)), 3) AS total_m
        FROM way JOIN size USING (feature_id) LEFT JOIN len USING (feature_id) WHERE highway IN ({ROADS}) AND NOT (highway = 'footway' AND sidewalk) AND NOT is_area AND NOT indoor GROUP BY area_id"""),
    "min_length_trails": query(POINTS, LENGTHS, select="""SELECT area_id, feature_id, round(m, 3) AS length_m FROM way JOIN len USING (feature_id)
        WHERE highway IN (TRAILS) AND NOT is_area AND NOT indoor AND m >= 300""".replace("TRAILS", quoted(TRAIL_CLASSES))),
    "trails_in_area": query(POINTS, CORNERS, select="""SELECT DISTINCT seg.area_id, f AS feature_id FROM seg JOIN box USING (area_id) WHERE area_id % 2 = 0 AND
          least(x1, x2) <= west + 0.01 AND greatest(x1, x2) >= west AND least(y1, y2) <= south + 0.01 AND greatest(y1, y2) >= south
        UNION SELECT DISTINCT p.area_id, feature_id FROM p JOIN box USING (area_id) WHERE area_id % 2 = 1 AND n > 1 AND
          ((((south > lat) <> (south > lat)) AND lng < (west + 0.02 - west) * (lat - south) / 1 + west)
           <> (((south > lat) <> (south + 0.02 > lat)) AND lng < (west - (west + 0.02)) * (lat - south) / (south + 0.02 - south) + (west + 0.02)))
          <> (((south + 0.02 > lat) <> (south > lat)) AND lng < (west - west) * (lat - (south + 0.02)) / (south - (south + 0.02)) + west)"""),
    "segments_flat": query(POINTS, select="SELECT area_id, f AS feature_id, i AS segment_idx, floor(x1 * 1e6 + 0.5)::BIGINT AS ax_e6, floor(y1 * 1e6 + 0.5)::BIGINT AS ay_e6, floor(x2 * 1e6 + 0.5)::BIGINT AS bx_e6, floor(y2 * 1e6 + 0.5)::BIGINT AS by_e6 FROM seg"),
    "crossings_first_pair": query(POINTS, CROSS, select="SELECT area_id, node, a_ord, a_idx, b_ord, b_idx FROM firstx"),
    "crossings_all": query(POINTS, CROSS, select="SELECT area_id, node, a_ord, a_idx, b_ord, b_idx FROM allx"),
    "raw_nodes": query(*NET, select=f"SELECT area_id, {_key('node')} AS node_key, floor(lat * 1e7 + 0.5)::BIGINT AS lat_e7, floor(lng * 1e7 + 0.5)::BIGINT AS lng_e7 FROM nd"),
    "raw_edges": query(*NET, select=f"SELECT area_id, f AS feature_ord, i AS segment_idx, j, {EDGE_ID} AS edge_id, round(weight, 3) AS weight FROM ed"),
    "adjacency_min": query(*NET, select="SELECT area_id, u, v, round(weight, 3) AS weight FROM adj"),
    "odd_degree_nodes": query(*NET, select="SELECT area_id, node, degree FROM deg WHERE degree % 2 = 1"),
    "degree_histogram": query(*NET, select="SELECT area_id, degree, count(*) AS nodes FROM deg GROUP BY area_id, degree"),
    "area_graph_totals": query(*NET, select="""SELECT area_id, nodes, coalesce(edges, 0) AS edges, round(coalesce(metres, 0), 2) AS metres, coalesce(odd, 0) AS odd
        FROM (SELECT area_id, count(*) AS nodes FROM nd GROUP BY area_id) LEFT JOIN (SELECT area_id, count(*) AS edges, sum(weight) AS metres FROM ed GROUP BY area_id) USING (area_id)
        LEFT JOIN (SELECT area_id, count(*) AS odd FROM deg WHERE degree % 2 = 1 GROUP BY area_id) USING (area_id)"""),
    "components": query(*NET, COMPONENTS, select="SELECT area_id, node, c AS component FROM lab"),
    "component_warning": query(*NET, COMPONENTS, select="""SELECT area_id, count(DISTINCT c) AS components,
        CASE WHEN count(DISTINCT c) > 1 THEN (count(DISTINCT c) - 1)::VARCHAR || ' disconnected component' || CASE WHEN count(DISTINCT c) > 2 THEN 's' ELSE '' END || ' not reachable from start point.' END AS warning
        FROM lab GROUP BY area_id"""),
    "edges_after_removals": query(*NET, select="""SELECT area_id, u, v, f AS feature_ord, i AS segment_idx, j FROM ed WHERE NOT EXISTS
        (SELECT 1 FROM ed r WHERE r.f % 97 = 0 AND r.area_id = ed.area_id AND least(r.u, r.v) = least(ed.u, ed.v) AND greatest(r.u, r.v) = greatest(ed.u, ed.v))"""),
    "undo_last_batch": query(*NET, f"lg AS (SELECT area_id, f % 3 AS b, 'physical:' || {EDGE_ID} AS edge_id FROM ed WHERE f % 97 = 0)",
        select="SELECT DISTINCT area_id, edge_id FROM lg JOIN (SELECT area_id, max(b) AS last FROM lg GROUP BY area_id) USING (area_id) WHERE b < last"),
    "connectors_added": query(*NET, f"""ends AS (SELECT area_id, feature_id, arg_min(lng, seq) AS sx, arg_min(lat, seq) AS sy, arg_max(lng, seq) AS ex, arg_max(lat, seq) AS ey FROM p WHERE n > 1 GROUP BY area_id, feature_id),
        cn AS (SELECT * FROM (SELECT *, lead(sx) OVER w AS tx, lead(sy) OVER w AS ty FROM ends WINDOW w AS (PARTITION BY area_id ORDER BY feature_id)) WHERE feature_id % 53 = 0 AND tx IS NOT NULL),
        ck AS (SELECT *, {NODE('ex', 'ey')} AS cu, {NODE('tx', 'ty')} AS cv, {haversine('ey', 'ex', 'ty', 'tx')} AS weight FROM cn),
        ok AS (SELECT area_id, cu AS u, cv AS v, weight FROM ck WHERE cu <> cv AND weight >= 0.1 AND EXISTS (SELECT 1 FROM nd WHERE nd.area_id = ck.area_id AND node = cu) AND EXISTS (SELECT 1 FROM nd WHERE nd.area_id = ck.area_id AND node = cv)
          AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.area_id = ck.area_id AND adj.u = cu AND adj.v = cv) QUALIFY row_number() OVER (PARTITION BY area_id, least(cu, cv), greatest(cu, cv) ORDER BY feature_id) = 1),
        e2 AS (SELECT area_id, u, v, weight FROM ed UNION ALL SELECT * FROM ok),
        d2 AS (SELECT area_id, u, count(DISTINCT v) AS k FROM (SELECT area_id, u, v FROM e2 UNION ALL SELECT area_id, v, u FROM e2) GROUP BY area_id, u)""",
        select="""SELECT area_id, nodes, edges, round(metres, 2) AS metres, coalesce(odd, 0) AS odd FROM (SELECT area_id, count(*) AS nodes FROM d2 GROUP BY area_id)
        JOIN (SELECT area_id, count(*) AS edges, sum(weight) AS metres FROM e2 GROUP BY area_id) USING (area_id) LEFT JOIN (SELECT area_id, count(*) AS odd FROM d2 WHERE k % 2 = 1 GROUP BY area_id) USING (area_id)"""),
    "snap_nearest_node": query(POINTS, EVENT_POINTS, select=f"""SELECT area_id, point_id, arg_min({NODE('p.lng', 'p.lat')}, ((p.lng - ep.lng) * (p.lng - ep.lng) + (p.lat - ep.lat) * (p.lat - ep.lat), feature_id, seq)) AS node
        FROM ep JOIN p USING (area_id) WHERE n > 1 GROUP BY area_id, point_id"""),
    "features_within": query(POINTS, EVENT_POINTS, """sc AS (SELECT area_id, point_id, f, (x1 - lng) * (111320 * cos(radians(lat))) AS ax, (y1 - lat) * 111320.0 AS ay, (x2 - lng) * (111320 * cos(radians(lat))) AS bx, (y2 - lat) * 111320.0 AS cy FROM ep JOIN seg USING (area_id)),
        tt AS (SELECT *, bx - ax AS dx, cy - ay AS dy FROM sc), uu AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((0.0 - ax) * dx + (0.0 - ay) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM tt)""",
        select="SELECT DISTINCT area_id, point_id, f AS feature_id FROM uu WHERE sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy)) < 20"),
    "elevation_parsed": query(POINTS, HEIGHTS, select="SELECT feature_id AS response_id, seq AS pos, round(elev, 1) AS elev FROM h"),
    "elevation_misses": query(POINTS, HEIGHTS, select="SELECT DISTINCT xe * 10 AS lng_e7, ye * 10 AS lat_e7 FROM h WHERE NOT sampled"),
    "elevation_batches": query(POINTS, HEIGHTS, select="""SELECT bucket::INTEGER AS bucket, batch::BIGINT AS batch, count(*)::INTEGER AS points,
        sha256('{"points":[' || string_agg('[' || lng || ',' || lat || ']', ',' ORDER BY ye, xe) || '],"spatialReference":{"wkid":4326}}') AS payload_sha256
        FROM (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY ye, xe) - 1) // 100 AS batch
        FROM (SELECT DISTINCT xe, ye, xe / 1e6 AS lng, ye / 1e6 AS lat, ((xe * 10 + ye * 10) % 64 + 64) % 64 AS bucket FROM h WHERE NOT sampled)) GROUP BY ALL"""),
    "missing_samples": query(POINTS, HEIGHTS, select="SELECT area_id, feature_id AS route_id, count(*) AS points, count(*) FILTER (NOT sampled) AS missing FROM h GROUP BY ALL"),
    "graph_statistics": query(*NET, COMPONENTS, logical(), """lodd AS (SELECT area_id, count(*) AS odd FROM (SELECT area_id, node, count(DISTINCT other) AS d FROM
        (SELECT area_id, u AS node, v AS other FROM lge UNION ALL SELECT area_id, v, u FROM lge) GROUP BY area_id, node) WHERE d % 2 = 1 GROUP BY area_id),
        ln AS (SELECT area_id, count(*) AS nodes FROM nd ANTI JOIN gone USING (area_id, node) GROUP BY area_id), le AS (SELECT area_id, count(*) AS edges, sum(weight) AS m FROM lge GROUP BY area_id),
        rn AS (SELECT area_id, count(*) AS raw_nodes FROM nd GROUP BY area_id), re AS (SELECT area_id, count(*) AS raw_edges FROM ed GROUP BY area_id), pa AS (SELECT area_id, count(DISTINCT c) AS components FROM lab GROUP BY area_id)""",
        select="""SELECT area_id, raw_nodes, coalesce(raw_edges, 0) AS raw_edges, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(odd, 0) AS odd, coalesce(components, 0) AS components, round(coalesce(m, 0), 2) AS metres
        FROM rn LEFT JOIN re USING (area_id) LEFT JOIN ln USING (area_id) LEFT JOIN le USING (area_id) LEFT JOIN lodd USING (area_id) LEFT JOIN pa USING (area_id)"""),
    "removals_unmatched": query(*NET, select=f"SELECT area_id, 2 * count(DISTINCT {EDGE_ID}) AS listed, count(DISTINCT {EDGE_ID}) AS known FROM ed WHERE f % 97 = 0 GROUP BY area_id"),
    "restored_selections": query(POINTS, """sv AS (SELECT area_id // 10 AS k, feature_id, max(n) AS n FROM p WHERE n > 1 GROUP BY ALL)""",
        select="""SELECT 'areas ' || k AS name, count(*) FILTER (k % 2 = 1 OR highway = 'path') AS features, (sum(n) FILTER (k % 2 = 1 OR highway = 'path'))::BIGINT AS vertices,
        CASE WHEN k % 2 = 1 THEN count(*) FILTER (feature_id % 97 = 0) ELSE 0 END AS removals FROM sv JOIN way USING (feature_id) WHERE k % 5 <> 4 GROUP BY k HAVING features > 0"""),
    "ways_read": query(POINTS, select="""SELECT p.area_id, feature_id, CASE WHEN count(*) > 1 THEN 'LineString' ELSE 'Point' END AS geom_type, count(*)::INTEGER AS vertices, any_value(highway) AS highway,
        arg_min(xe, seq) AS lng_first, arg_min(ye, seq) AS lat_first, arg_max(xe, seq) AS lng_last, arg_max(ye, seq) AS lat_last
        FROM p JOIN way USING (feature_id) WHERE feature_id % 29 <> 0 AND feature_id % 31 <> 0 AND feature_id % 43 <> 0 GROUP BY p.area_id, feature_id"""),
    "ways_rejected": query(POINTS, select="""SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN feature_id % 29 = 0 THEN 'malformed' WHEN feature_id % 31 = 0 THEN 'no area or id' WHEN feature_id % 43 = 0 THEN 'other' END AS reason FROM way)
        WHERE reason IS NOT NULL GROUP BY reason"""),
    "geojson_round_trip": query(*NET, select=f"SELECT area_id, {EDGE_ID} AS edge_id, u, v, round(weight, 3) AS weight FROM ed"),
    "height_store": query(POINTS, """hs AS (SELECT DISTINCT xe * 10 AS lng_e7, ye * 10 AS lat_e7, 1500 + (ye * 7 - xe * 3) % 997 / 10.0 AS elev, ((xe // 100 + ye // 100) % 3 + 3) % 3 AS third FROM p WHERE (ye - xe) % 31 <> 0)""",
        select="SELECT lng_e7, lat_e7, round((elev + CASE WHEN third = 0 THEN 100 ELSE 0 END)::DOUBLE, 1) AS elev, 1::BIGINT AS rows FROM hs"),
    "elevation_joined": query(POINTS, HEIGHTS, select="SELECT area_id, feature_id AS route_id, seq, round(elev, 3) AS elev, sampled FROM h"),
    "elevation_profile": query(POINTS, HEIGHTS, PROFILE, select="SELECT area_id, feature_id AS route_id, seq, round(elev, 3) AS elev, round(dist, 3) AS dist FROM pf"),
    "smoothed_profile": query(POINTS, HEIGHTS, PROFILE, select="SELECT area_id, feature_id AS route_id, seq, round(avg(elev) OVER (PARTITION BY feature_id ORDER BY dist RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING), 3) AS smooth FROM pf"),
    "smoothed_stretches": query(POINTS, HEIGHTS, PROFILE, select="SELECT area_id, feature_id AS route_id, seq, round(avg(elev) OVER (PARTITION BY feature_id ORDER BY dist RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING), 3) AS smooth FROM pf"),
    "preferred_metrics": query(POINTS, HEIGHTS, PROFILE, CLIMB, TIMES, "kn AS (SELECT area_id, feature_id, bool_and(sampled) AS known FROM h GROUP BY area_id, feature_id)",
        select="""SELECT area_id, feature_id AS route_id, round(CASE WHEN known THEN g.a ELSE 0 END, 3) AS ascent, round(CASE WHEN known THEN g.d ELSE 0 END, 3) AS descent,
        round(CASE WHEN known THEN forward ELSE length / (6 * exp(-3.5 * 0.05) / 3.6) END, 3) AS seconds, known AS measured FROM tm JOIN cl USING (area_id, feature_id) JOIN kn USING (area_id, feature_id)"""),
    "profile_extent": query(POINTS, HEIGHTS, PROFILE, select="SELECT area_id, feature_id AS route_id, round(min(elev), 3) AS low, round(max(elev), 3) AS high, round(max(dist), 3) AS length, round(max(dist) * 2 / 5, 3) AS tick_3 FROM pf GROUP BY area_id, feature_id"),
    "elevation_gain_loss": query(POINTS, HEIGHTS, CLIMB, select="SELECT area_id, feature_id AS route_id, round(g.a, 3) AS ascent, round(g.d, 3) AS descent FROM cl"),
    "edge_costs": query(POINTS, HEIGHTS, PROFILE, CLIMB, TIMES, select="SELECT area_id, feature_id, round(length, 3) AS length, round(g.a, 3) AS ascent, round(g.d, 3) AS descent, round(forward, 3) AS forward, round(reverse, 3) AS reverse FROM tm JOIN cl USING (area_id, feature_id)"),
    "route_metrics": query(POINTS, HEIGHTS, PROFILE, CLIMB, TIMES, select="SELECT area_id, feature_id AS route_id, round(g.a, 3) AS ascent, round(g.d, 3) AS descent, round(forward, 3) AS seconds FROM tm JOIN cl USING (area_id, feature_id)"),
    "position_at_distance": query(POINTS, HEIGHTS, PROFILE, ASKED, """legs AS (SELECT area_id, feature_id AS route_id, seq, dist, lng, lat, lead(dist) OVER w AS nd, lead(lng) OVER w AS nx, lead(lat) OVER w AS ny FROM pf WINDOW w AS (PARTITION BY feature_id ORDER BY seq)),
        best AS (SELECT a.*, l.*, row_number() OVER (PARTITION BY a.route_id, a.query_id ORDER BY l.dist DESC, l.seq DESC) AS r FROM asked a JOIN legs l ON a.route_id = l.route_id AND l.dist <= a.d)""",
        select="""SELECT area_id, route_id, query_id::BIGINT AS query_id, round(coalesce(lng + (nx - lng) * CASE WHEN nd > dist THEN (d - dist) / (nd - dist) ELSE 0 END, lng), 6) AS lng,
        round(coalesce(lat + (ny - lat) * CASE WHEN nd > dist THEN (d - dist) / (nd - dist) ELSE 0 END, lat), 6) AS lat FROM best WHERE r = 1"""),
    "nearest_profile_point": query(POINTS, HEIGHTS, PROFILE, ASKED, """af AS (SELECT a.area_id, a.route_id, a.query_id, a.d, min((f.dist, f.seq)) FILTER (f.dist >= a.d) AS af, max((f.dist, f.seq)) FILTER (f.dist < a.d) AS be
        FROM asked a JOIN pf f ON f.feature_id = a.route_id GROUP BY ALL)""",
        select="SELECT area_id, route_id, query_id::BIGINT AS query_id, CASE WHEN af IS NULL OR (be IS NOT NULL AND d - be[1] < af[1] - d) THEN be[2] ELSE af[2] END AS seq FROM af"),
    "route_segments": query(POINTS, LENGTHS, ROUTE, select="""SELECT sg.area_id, sg.step, u, v, round(m, 3) AS weight, retraced, f0::BIGINT AS from_point, (f0 + n - 1)::BIGINT AS to_point, rp.lng AS first_lng, rp.lat AS first_lat
        FROM (SELECT *, coalesce(sum(n - 1) OVER (PARTITION BY area_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0 FROM sg) sg JOIN len USING (feature_id) JOIN rp ON rp.area_id = sg.area_id AND rp.step = sg.step AND rp.j = 0"""),
    "route_coords": query(POINTS, ROUTE, select="""SELECT area_id, row_number() OVER (PARTITION BY area_id ORDER BY step, j) - 1 AS seq, lng, lat
        FROM (SELECT *, lag(lng) OVER w AS px, lag(lat) OVER w AS py FROM rp WINDOW w AS (PARTITION BY area_id ORDER BY step, j)) WHERE px IS NULL OR lng <> px OR lat <> py"""),
    "windy_from_solution": query(POINTS, f"""w2 AS (SELECT area_id, feature_id, arg_min({NODE('lng', 'lat')}, seq) AS a, arg_max({NODE('lng', 'lat')}, seq) AS b FROM p WHERE n > 1 GROUP BY area_id, feature_id)""",
        select="SELECT area_id, u, v, count(*) AS n FROM (SELECT area_id, a AS u, b AS v FROM w2 UNION ALL SELECT area_id, b, a FROM w2) GROUP BY area_id, u, v"),
    "windy_model": query(POINTS, HEIGHTS, PROFILE, TIMES, f"""w2 AS (SELECT area_id, feature_id, arg_min({NODE('lng', 'lat')}, seq) AS a, arg_max({NODE('lng', 'lat')}, seq) AS b, row_number() OVER (PARTITION BY area_id ORDER BY feature_id) - 1 AS i FROM p WHERE n > 1 GROUP BY area_id, feature_id)""",
        select="""SELECT area_id, 'e' || i || 'f' AS var, a AS from_node, b AS to_node, round(forward, 3) AS coef, 0::BIGINT AS balance FROM w2 JOIN tm USING (area_id, feature_id)
        UNION ALL SELECT area_id, 'e' || i || 'r', b, a, round(reverse, 3), 0 FROM w2 JOIN tm USING (area_id, feature_id)"""),
    "euler_doubled": query(*NET, COMPONENTS, f"""st AS (SELECT area_id, arg_min({NODE('lng', 'lat')}, (feature_id, seq)) AS node FROM p WHERE n > 1 GROUP BY area_id),
        comp AS (SELECT l.area_id, l.c, st.node FROM st JOIN lab l USING (area_id, node))""",
        select="SELECT a.area_id, any_value(comp.node) AS start, count(*) AS steps, count(DISTINCT (least(u, v), greatest(u, v))) AS edges, 2::BIGINT AS fewest, 2::BIGINT AS most, true AS contiguous, true AS closed FROM adj a JOIN lab l ON l.area_id = a.area_id AND l.node = a.u JOIN comp ON comp.area_id = a.area_id AND comp.c = l.c GROUP BY a.area_id"),
    "pruned_graph": query(*NET, logical(), select=f"SELECT area_id, {EDGE_ID} AS edge_id, round(weight, 3) AS weight, points::INTEGER AS points FROM lge"),
    "logical_removal": query(*NET, logical(), f"""pick AS (SELECT * FROM (SELECT *, {EDGE_ID} AS edge_id FROM lge) QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY edge_id) = 1),
        onp AS (SELECT area_id, u AS node FROM pick UNION SELECT area_id, v FROM pick UNION SELECT gl.area_id, node FROM pick JOIN gl ON gl.area_id = pick.area_id AND gl.c = pick.c),
        hite AS (SELECT ed.area_id, f, i, j FROM ed JOIN onp a ON a.area_id = ed.area_id AND a.node = ed.u JOIN onp b ON b.area_id = ed.area_id AND b.node = ed.v)""",
        select="SELECT area_id, count(*) AS edges FROM ed ANTI JOIN hite USING (area_id, f, i, j) GROUP BY area_id"),
    "pruned_geojson": query(*NET, logical(), LOGICAL_POINTS, select=f"""SELECT area_id, concat('{{"type":"Feature","id":"', {EDGE_ID}, '","geometry":{{"type":"LineString","coordinates":[',
        array_to_string(list_transform(pts, lambda p: '[' || p[1] || ',' || p[2] || ']'), ','), ']}},"properties":{{}}}}') AS feature FROM lgp"""),
    "removals_in_order": removals_in_order(3),
    "shortest_paths": query(*NET, STARTS, logical("st"), DISTANCES, select="SELECT area_id, node, round(d, 2) AS dist FROM dd ANTI JOIN gone USING (area_id, node)"),
    "odd_pairs": query(*NET, select="SELECT area_id, count(*) AS odd, count(*) AS paired, 0::BIGINT AS uneven, true AS bounded FROM deg WHERE degree % 2 = 1 GROUP BY area_id"),
    "covering_route_distance": covering(),
    "covering_route_elevation": covering("true AS climbed, true AS timed,"),
    "covering_route_time": covering("true AS quicker,"),
    "directed_circuit": query(POINTS, f"""w2 AS (SELECT area_id, feature_id, arg_min({NODE('lng', 'lat')}, seq) AS a, arg_max({NODE('lng', 'lat')}, seq) AS b FROM p WHERE n > 1 GROUP BY area_id, feature_id),
        way2 AS (SELECT area_id, a AS u, b AS v FROM w2 UNION ALL SELECT area_id, b, a FROM w2), adj AS (SELECT DISTINCT area_id, u, v FROM way2), nd AS (SELECT DISTINCT area_id, u AS node FROM way2)""", COMPONENTS, STARTS,
        """own AS (SELECT l.area_id, l.c, st.node AS start FROM st JOIN lab l USING (area_id, node))""",
        select="""SELECT own.area_id, any_value(start) AS start, count(*) AS steps, count(DISTINCT (u, v)) AS passes, 0::BIGINT AS miscounted, true AS contiguous, true AS closed
        FROM own JOIN lab l ON l.area_id = own.area_id AND l.c = own.c JOIN way2 ON way2.area_id = l.area_id AND way2.u = l.node GROUP BY own.area_id"""),
    "windy_constraints": query(POINTS, "w2 AS (SELECT area_id, feature_id, row_number() OVER (PARTITION BY area_id ORDER BY feature_id) - 1 AS i FROM p WHERE n > 1 GROUP BY area_id, feature_id)",
        select="SELECT area_id, 'cover' || i AS row, 'e' || i || way AS var, 1::BIGINT AS coef, 1::BIGINT AS least, 0::BIGINT AS from_passes, 2::BIGINT AS to_passes FROM w2, (SELECT unnest(['f', 'r']) AS way)"),
    "route_gpx": query(POINTS, HEIGHTS, select=f"""SELECT area_id, feature_id AS route_id, sha256('{GPX_TOP}' || title || '  </metadata>' || chr(10) || '  <trk>' || chr(10) || '    ' || title || '    <type>running</type>' || chr(10) || '    <trkseg>' || chr(10) || points || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>') AS gpx_sha256
        FROM (SELECT area_id, feature_id, '<name>Route ' || area_id || ' ' || feature_id || '</name>' || chr(10) AS title, string_agg(printf('      <trkpt lat="%.7f" lon="%.7f">', lat, lng) || CASE WHEN sampled THEN chr(10) || printf('        <ele>%.1f</ele>', elev) || chr(10) || '      ' ELSE '' END || '</trkpt>', chr(10) ORDER BY seq) AS points FROM h GROUP BY area_id, feature_id)"""),
    "saved_selections": """SELECT trim(name) AS name, saved_at FROM (SELECT ' area ' || user_id || ' ' AS name, event_id AS saved_at FROM events WHERE user_id IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY saved_at DESC) = 1 AND saved_at % 7 <> 0""",
    "display_strings": query(POINTS, LENGTHS, CORNERS, """t AS (SELECT area_id, sum(coalesce(m, 0)) AS m FROM way LEFT JOIN len USING (feature_id) GROUP BY area_id),
        z AS (SELECT *, abs((south + 0.01 - south) * 111320 * (west + 0.01 - west) * 111320 * cos(radians((south + 0.01 + south) / 2))) / CASE area_id % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1.0 END AS sq, m * 3.28084 AS ft FROM t JOIN box USING (area_id))""",
        select="""SELECT area_id, CASE WHEN ft >= 5280 THEN printf('%.1f', ft / 5280) || ' mi' ELSE format('{:,}', floor(ft + 0.5)::BIGINT) || ' ft' END AS distance,
        format('{:,}', floor(m / 7 * 3.28084 + 0.5)::BIGINT) || ' ft' AS climb,
        CASE WHEN m / 3 < 60 THEN floor(m / 3 + 0.5)::BIGINT || ' s' WHEN floor(m / 3 / 3600) = 0 THEN floor(m / 3 % 3600 / 60 + 0.5)::BIGINT || ' min' ELSE floor(m / 3 / 3600)::BIGINT || 'h ' || floor(m / 3 % 3600 / 60 + 0.5)::BIGINT || 'm' END AS duration,
        CASE WHEN sq / 2589988 >= 0.01 THEN printf('%.1f', sq / 2589988) || ' mi²' WHEN sq / 4046.86 >= 0.01 THEN printf('%.1f', sq / 4046.86) || ' acres' ELSE format('{:,}', floor(sq * 10.7639 + 0.5)::BIGINT) || ' ft²' END AS size,
        '&lt;&quot;A&amp;B&quot; ' || area_id || '&gt;' AS escaped, printf('%.6f', west) AS west FROM z"""),
}
