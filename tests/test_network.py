"""Small networks with known results, several areas at once."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from routecover.functions import geo, terrain
from routecover.operators import edits, elevation, euler, filters, matching, network, paths, proximity
from routecover.operators.crossings import crossings
from routecover.operators.network import build_graph
from routecover.operators.prune import prune
from routecover.operators.route import covering_route
from routecover.sources import stores, ways

FEATURES = "area_id long, feature_id long, feature_ord long, geom_type string, coords array<struct<lng:double,lat:double>>, properties map<string,string>"


def lines(spark, *groups):
    """Features of areas 0, 1, ...: each group is a list of coordinate lists."""
    rows = [(a, i, i, "LineString" if len(c) > 1 else "Point", c, {}) for a, g in enumerate(groups) for i, c in enumerate(g)]
    return spark.createDataFrame(rows, FEATURES)


CHAIN = [[(0.0, 0.0), (0.001, 0.0), (0.002, 0.0)]]
CROSS = [[(0.0, 0.0), (0.002, 0.002)], [(0.0, 0.002), (0.002, 0.0)]]
NEAR = [[(0.0, 0.0), (0.00100008, 0.00000009)], [(0.0010001, 0.0000001), (0.002, 0.0)]]
SQUARE = [[(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001), (0.0, 0.0)]]
SPOKE = [*SQUARE, [(0.0, 0.0), (-0.001, 0.0)]]


def counts(df):
    return dict(df.groupBy("area_id").count().collect())


def test_graphs_of_small_features(spark):
    g = build_graph(lines(spark, CHAIN, CROSS, NEAR, [[(5.0, 5.0)], *CHAIN]))
    assert counts(g.nodes) == {0: 3, 1: 5, 2: 3, 3: 3} and counts(g.edges) == {0: 2, 1: 4, 2: 2, 3: 2}
    c = network.graph_components(g).groupBy("area_id").agg(F.countDistinct("component")).collect()
    assert dict(c) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert counts(network.odd_nodes(g.edges)) == {0: 2, 1: 4, 2: 2, 3: 2}


def test_crossings_of_a_grid(spark):
    step = [0.01 * i for i in range(8)]
    grid = [[(x, -0.005), (x, 0.075)] for x in step] + [[(-0.005, y), (0.075, y)] for y in step]
    tee, parallel = [[(0.0, 0.0), (0.002, 0.0)], [(0.001, 0.0), (0.001, 0.001)]], [[(0.0, 0.0), (0.002, 0.0)], [(0.0, 0.001), (0.002, 0.001)]]
    found = crossings(filters.flatten_segments(lines(spark, grid, tee, parallel)))
    assert counts(found) == {0: 64, 1: 1}


def test_keys_and_texts(spark):
    row = spark.range(1).select(
        geo.node_key(geo.node_id(geo.micro(F.lit(-105.987654321)), geo.micro(F.lit(40.123456789)))).alias("a"), geo.node_key(geo.node_id(F.lit(0), F.lit(-500_000))).alias("b"),
        geo.distance_text(F.lit(2000.0)).alias("c"), geo.distance_text(F.lit(500.0)).alias("d"), geo.duration_text(F.lit(3700.0)).alias("e"), geo.duration_text(F.lit(59.0)).alias("f"),
        geo.area_text(F.lit(5_000_000.0)).alias("g"), geo.escaped_xml(F.lit('a&b<"c">')).alias("h"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("i"),
    ).first()
    assert row[:8] == ("40.123457,-105.987654", "-0.5,0", "1.2 mi", "1,640 ft", "1h 2m", "59 s", "1.9 mi²", "a&amp;b&lt;&quot;c&quot;&gt;")
    assert 110_000 < row.i < 112_000


@pytest.mark.parametrize(("heights", "threshold", "want"), [([0, 5, 7, 3, 6, 4, 9], 4, (9, 0)), ([0, 10, 9, 20, 19, 30], 2, (30, 0)), ([0, 10, 20, 30, 40], 2, (40, 0)), ([99.5, 100.5] * 5, 2, (0, 0)), ([], 2, (0, 0))])
def test_gain_and_loss(spark, heights, threshold, want):
    df = spark.createDataFrame([([float(x) for x in heights],)], "h array<double>")
    assert tuple(df.select(terrain.gain_and_loss(F.col("h"), threshold).alias("g")).first().g) == want


def test_filters(spark):
    tags = [{"highway": "path"}, {"highway": "footway", "footway": "sidewalk"}, {"highway": "footway"}, {"highway": "service"}, {"highway": "path", "area": "yes"}, {"highway": "path", "indoor": "yes"}, {}]
    f = spark.createDataFrame([(0, i, i, "LineString", [(0.0, 0.0), (0.001, 0.0)], t) for i, t in enumerate(tags)], FEATURES)
    ids = lambda df: {r.feature_id for r in df.collect()}
    assert ids(filters.select_ways(f)) == {0, 2} and ids(filters.select_ways(f, roads=True)) == {0, 2, 3} and ids(filters.select_ways(f, sidewalks=True)) == {0, 1, 2}
    assert filters.at_least_long(f, 0).count() == 7 and filters.at_least_long(f, 500).count() == 0


def test_pruning(spark):
    g = build_graph(lines(spark, [[(0.001 * i, 0.0) for i in range(6)]], SQUARE, SPOKE))
    p = prune(g)
    assert counts(p.nodes) == {0: 2, 1: 3, 2: 4} and counts(p.edges) == {0: 1, 1: 3, 2: 4}
    total = lambda e: {r[0]: round(r[1], 3) for r in e.groupBy("area_id").agg(F.sum("weight")).collect()}
    assert total(p.edges) == total(g.edges)
    first = p.edges.where("area_id = 0").first()
    assert len(first.coords) == 6 and geo is not None


def test_edits(spark):
    g = build_graph(lines(spark, [*CHAIN, [(0.01, 0.0), (0.011, 0.0)]]))
    ids = edits.with_ids(g.edges).where("edge_ord.feature_ord = 1").select("area_id", F.concat(F.lit("physical:"), "edge_id").alias("edge_id"))
    log = ids.select("area_id", F.lit(0).alias("batch_no"), F.lit(0).alias("ord"), "edge_id")
    left = edits.replay(g, log)
    assert left.edges.count() == 2 and left.nodes.count() == 3 and edits.undo_last_batch(log).count() == 0
    logical = edits.with_ids(prune(g).edges).where("edge_ord.feature_ord = 0").select("area_id", F.lit(0).alias("batch_no"), F.lit(0).alias("ord"), "edge_id")
    assert edits.replay(g, logical, prune).edges.count() == 1
    c = spark.createDataFrame([(0, 1, 0.002, 0.0, 0.01, 0.0), (0, 2, 0.01, 0.0, 0.002, 0.0), (0, 3, 0.0, 0.0, 0.001, 0.0), (0, 4, 0.0, 0.0, 0.0, 0.0), (0, 5, 0.0, 0.0, 0.0, 0.5)], "area_id long, conn_ord long, from_lng double, from_lat double, to_lng double, to_lat double")
    assert [r.conn_ord for r in edits.valid_connectors(g, c).collect()].count(1) == 1
    joined = edits.add_connectors(g, c)
    assert joined.edges.count() == 5 and joined.nodes.count() == 6
    assert network.graph_components(joined).select("component").distinct().count() == 1


def test_nearest_and_within(spark):
    nodes = spark.createDataFrame([(0, i, 0.001 * i, 0.0, i) for i in range(5)] + [(1, 9, 3.0, 3.0, 0)], "area_id long, node long, lng double, lat double, node_ord int")
    points = spark.createDataFrame([(0, 1, 0.0016, 0.0001), (0, 2, 0.0015, 0.0), (0, 3, 0.5, 0.5), (1, 4, 0.0, 0.0), (2, 5, 0.0, 0.0)], "area_id long, point_id long, lng double, lat double")
    assert {(r.point_id, r.node) for r in proximity.snap(points, nodes).collect()} == {(1, 2), (2, 1), (3, 4), (4, 9)}
    s = filters.flatten_segments(lines(spark, CHAIN))
    near = spark.createDataFrame([(0, 1, 0.0005, 0.0001), (0, 2, 0.0005, 0.0003)], "area_id long, point_id long, lng double, lat double")
    assert [(r.point_id, r.feature_id) for r in proximity.features_within(near, s, 20.0).collect()] == [(1, 0)]


def test_heights_and_positions(spark):
    bodies = [(1, '{"results":[{"value":"1653.93"},{"value":"NoData"},{"value":"not-a-number"},{}]}'), (2, '{"value":"7.5"}'), (3, "{}"), (4, '{"results":[{"value":"NaN"}]}')]
    got = elevation.parsed_heights(spark.createDataFrame(bodies, "response_id int, body string")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, 0, 1653.93), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (2, 0, 7.5), (3, 0, 0.0), (4, 0, 0.0)]
    p = elevation.profile(elevation.route_points(lines(spark, CHAIN)))
    length = p.agg(F.max("dist")).first()[0]
    asked = spark.createDataFrame([(0, 0, 1, length / 4), (0, 0, 2, 1e9), (0, 0, 3, 0.0)], "area_id long, route_id long, query_id long, d double")
    at = {r.query_id: r.lng for r in elevation.position_at(p, asked).collect()}
    assert math.isclose(at[1], 0.0005, abs_tol=1e-9) and at[2] == 0.002 and at[3] == 0.0
    assert {r.query_id: r.seq for r in elevation.nearest_profile_point(p, asked).collect()} == {1: 1, 2: 2, 3: 0}


def test_paths_and_pairs(spark):
    g = build_graph(lines(spark, [[(0.001 * i, 0.0) for i in range(4)], [(0.1, 0.1), (0.101, 0.1)]], SPOKE))
    steps = paths.two_way(g.edges, "weight")
    start = spark.createDataFrame([(0, 0.0, 0.0)], "area_id long, lng double, lat double").select("area_id", geo.node_id(geo.micro("lng"), geo.micro("lat")).alias("node"))
    found = paths.shortest_paths(steps, start)
    assert found.count() == 4 and 330 < found.agg(F.max("dist")).first()[0] < 336
    pairs, routes = matching.match_nodes(steps, network.odd_nodes(g.edges))
    assert counts(pairs) == {0: 2, 1: 1} and counts(routes) == {0: 4, 1: 1}


def test_covering_route(spark):
    ladder = [[(0.0, 0.001 * i), (0.002, 0.001 * i)] for i in range(3)] + [[(0.0, 0.0), (0.0, 0.002)], [(0.002, 0.0), (0.002, 0.002)]]
    g = build_graph(lines(spark, CHAIN, ladder, [*SQUARE, [(0.5, 0.5), (0.501, 0.5)]]))
    starts = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "area_id long, x int").select("area_id", geo.node_id(F.lit(0), F.lit(0)).alias("node"))
    r = covering_route(g, starts)
    totals = {t.area_id: t for t in r.totals.collect()}
    assert totals[0].steps == 4 and totals[1].steps >= 8 and totals[2].steps == 4 and totals[2].warning.startswith("1 disconnected component not")
    for area in (0, 1, 2):
        steps = r.steps.where(F.col("area_id") == area).orderBy("step").collect()
        assert [s.step for s in steps] == list(range(len(steps))) and all(a.v == b.u for a, b in zip(steps, [*steps[1:], steps[0]]))
    assert steps[0].u == starts.first().node
    walked = {tuple(sorted((s.u, s.v))) for s in r.steps.where("area_id = 1").collect()}
    assert walked == {tuple(sorted((e.u, e.v))) for e in g.edges.where("area_id = 1").collect()}
    assert totals[0].total_m == pytest.approx(2 * totals[0].unique_m) and totals[1].unique_m <= totals[1].total_m
    assert r.segments.where("area_id = 0 and retraced").count() == 2
    doubled = euler.circuits(euler.multiplicities(g.edges, g.edges), starts)
    assert counts(doubled) == {0: 4, 1: 2 * g.edges.where("area_id = 1").count(), 2: 8}


def test_files(spark, tmp_path):
    (tmp_path / "7.json").write_text('{"elements":[{"type":"way","id":5,"tags":{"highway":"path"},"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3}]},{"type":"node","id":6}]}')
    way = ways.read_ways(spark, str(tmp_path / "7.json")).collect()
    assert len(way) == 1 and way[0].area_id == "7" and way[0].coords[1].lng == 3.0 and way[0].properties == {"highway": "path"}
    body = '{"features":[{"id":"a","geometry":{"type":"LineString","coordinates":[[2,1],[3,1]]},"properties":{}},{"id":"b","geometry":{"type":"Point","coordinates":[2,1]},"properties":{}}]}'
    f = ways.features_from_text(spark.createDataFrame([(0, body)], "area_id long, body string")).orderBy("feature_ord").collect()
    assert [(x.feature_id, len(x.coords)) for x in f] == [("a", 2), ("b", 0)]
    points = spark.createDataFrame([(0, 0, 0, 2.0, 1.0, 5.04), (0, 0, 1, 3.0, 1.0, None)], "area_id long, route_id long, seq int, lng double, lat double, elev double")
    gpx = ways.tracks(points).first().gpx
    assert '<trkpt lat="1.0000000" lon="2.0000000">\n        <ele>5.0</ele>\n      </trkpt>' in gpx and '<trkpt lat="1.0000000" lon="3.0000000"></trkpt>' in gpx
    g = build_graph(lines(spark, CHAIN))
    assert '"id":"0,0|0,0.001"' in ways.edge_features(g.edges).orderBy("edge_ord").first().feature
    store = str(tmp_path / "heights")
    new = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (5, 6, 7.0)], "lng_e7 long, lat_e7 long, elev double")
    stores.append_heights(spark, store, new)
    stores.append_heights(spark, store, new)
    assert spark.read.parquet(store).count() == 2
    saved = spark.createDataFrame([(" a ", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, True), (" ", 1, False)], "name string, saved_at long, deleted boolean")
    stores.save_selections(saved, str(tmp_path / "saved"))
    assert [(r.name, r.saved_at) for r in stores.latest_selections(spark.read.parquet(str(tmp_path / "saved"))).collect()] == [("a", 2)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_areas_without_a_match_keep_their_nodes(spark):
    graph = build_graph(lines(spark, [[(0.0, 0.0), (0.001, 0.0)]], [[(0.5, 0.5), (0.501, 0.5)]]))
    bare = graph.nodes.limit(1).withColumn("node", F.col("node") + 7)
    graph = network.Graph(graph.nodes.unionByName(bare), graph.edges)
    unknown = graph.edges.select("area_id", F.lit("no such edge").alias("edge_id"))
    assert edits.remove_raw(graph, unknown).nodes.count() == graph.nodes.count() == 5
    known = edits.with_ids(graph.edges).limit(1).select("area_id", "edge_id")
    assert edits.remove_raw(graph, known).nodes.count() < 4
