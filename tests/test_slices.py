"""Running sums over slices, cells along segments, saved selections, reports."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from routecover import runtime
from routecover.functions import geo
from routecover.operators import costs, crossings, edits, elevation, filters, network, proximity, scans, windy
from routecover.plans import registry
from routecover.sources import stores

SF = "/root/testdata/sf0.001"
SEGMENTS = "area_id long, feature_ord long, segment_idx int, ax double, ay double, bx double, by double"


@pytest.mark.parametrize("slices", ["1", "7"])
def test_running_sums_span_slices(spark, slices):
    r = random.Random(1)
    rows = [(a, i, r.randrange(100)) for a, n in ((1, 300), (2, 1), (3, 60)) for i in range(n)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        df = spark.createDataFrame(rows, "a int, i int, v long")
        got = scans.scanned(df, ["a"], ["i"], sums={"total": F.col("v"), "n": F.lit(1).cast("long")}, previous={"last": "v"}).collect()
        down = {(x.a, x.i): x.place for x in scans.numbered(df, [], [F.desc("a"), F.desc("i")], "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, total, n, last = {}, {}, {}, {}
    for a, i, v in sorted(rows):
        total[a], n[a] = total.get(a, 0) + v, n.get(a, 0) + 1
        want[a, i] = (total[a], n[a], last.get(a))
        last[a] = v
    assert {(x.a, x.i): (x.total, x.n, x.last) for x in got} == want
    assert down == {(a, i): k + 1 for k, (a, i, _) in enumerate(sorted(rows, reverse=True))}


def test_a_long_diagonal_lies_in_few_cells(spark):
    s = spark.createDataFrame([(0, 0, 0, -0.3, 40.0, 0.7, 41.0), (0, 1, 0, 0.1003, 40.5, 0.1003, 40.7), (0, 2, 0, -0.5, 40.4, 0.9, 40.4)], SEGMENTS)
    laid = {r.feature_ord: r["count"] for r in crossings.grid(s, 0.002, 1024).groupBy("feature_ord").count().collect()}
    assert 500 <= laid[0] <= 1600 and 100 <= laid[1] <= 103 and 700 <= laid[2] <= 1410
    assert {(r.a_ord, r.b_ord) for r in crossings.crossings(s).collect()} == {(0, 2)}


@pytest.mark.parametrize("most", [1, 4, 1024])
def test_dense_cells_lose_no_crossing(spark, most):
    r = random.Random(6)
    rows = []
    for k in range(240):
        x, y = r.choice([0.002 * r.randrange(3), r.uniform(0, 0.006)]), r.choice([0.002 * r.randrange(3), r.uniform(0, 0.006)])
        w = r.choice([0.0001, 0.003])
        rows.append((k % 2, k, 0, x, y, x + r.choice([0.0, r.uniform(-w, w)]), y + r.uniform(-w, w)))
    found = {tuple(x) for x in crossings.crossings(spark.createDataFrame(rows, SEGMENTS), most=most, split_all=True).select("area_id", "a_ord", "b_ord").collect()}
    want = set()
    for i, (area, a, _, ax, ay, bx, by) in enumerate(rows):
        for other, b, _, cx, cy, dx, dy in rows[i + 1 :]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if area == other and abs(den) >= 1e-12:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want.add((area, a, b))
    assert found == want and len(want) > 50


def test_selections_are_replaced_and_deleted_by_name(spark, tmp_path):
    path = str(tmp_path / "selections")
    of = lambda rows: spark.createDataFrame(rows, "name string, feature_id long, coords array<double>")
    gone = lambda rows: spark.createDataFrame(rows, "name string, batch_no int, edge_id string")
    saved = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, saved_at int")
    stores.replace_selections(of([(" a ", 1, [0.5]), ("a", 2, [1.0]), ("b", 3, [2.0]), ("", 4, []), ("unsaved", 5, [])]), gone([("a", 0, "x|y"), ("b", 1, "z")]), saved(["a", "b", "empty", " "]), path)
    stores.replace_selections(of([("a", 9, [9.0])]), gone([]), saved([" a"]), path)
    features, removals = stores.load_selections(spark, path)
    assert {(r.name, r.feature_id) for r in features.collect()} == {("a", 9), ("b", 3)} and [tuple(r) for r in removals.collect()] == [("b", 1, "z")]
    stores.delete_selections(spark.createDataFrame([("b",)], "name string"), path)
    assert [tuple(r) for r in stores.load_selections(spark, path)[0].collect()] == [("a", 9, [9.0])]
    assert stores.load_selections(spark, path, ["b"])[0].count() == 0 and stores.load_selections(spark, path, ["a "])[0].count() == 1


def test_durations_that_are_no_numbers(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.0, 59.4, 60.0, 3600.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "s double").select(geo.duration_text("s")).collect()]
    assert got == ["NaN s", "Infinity s", "-Infinity s", "0 s", "59 s", "1 min", "1h 0m", None]


def test_reports_name_what_matched_nothing(spark):
    f = spark.createDataFrame([(0, 1, 1, "LineString", [(0.0, 0.0), (0.001, 0.0)], {})], "area_id long, feature_id long, feature_ord long, geom_type string, coords array<struct<lng:double,lat:double>>, properties map<string,string>")
    g = network.build_graph(f)
    own = edits.with_ids(g.edges).first().edge_id
    log = spark.createDataFrame([(0, 0, 0, f"physical:{own}"), (0, 1, 0, "physical:no|edge"), (0, 1, 1, "physical:no|edge"), (0, 2, 0, own)], "area_id long, batch_no int, ord int, edge_id string")
    assert {(r.edge_id, r.known) for r in edits.removal_report(g, log).collect()} == {(own, True), ("no|edge", False)}
    points = elevation.with_heights(elevation.route_points(f), spark.createDataFrame([(0, 0, 5.0)], "lng_e7 long, lat_e7 long, elev double"))
    assert tuple(elevation.missing_samples(points).first()) == (0, 1, 2, 1)
    assert filters.flatten_segments(f).count() == 1


def test_a_save_writes_a_file_for_each_name(spark, tmp_path):
    path = tmp_path / "many"
    rows = spark.range(400).repartition(8).select(F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"), F.col("id").alias("feature_id"))
    gone = rows.select("name", F.lit(0).cast("long").alias("batch_no"), F.col("feature_id").cast("string").alias("edge_id"))
    stores.replace_selections(rows, gone, rows.select("name").distinct().withColumn("saved_at", F.lit(1)), str(path))
    stores.delete_selections(rows.select("name").where("name = 'n3'").repartition(4), str(path))
    assert {p.name: len(list(p.glob("*.parquet"))) for p in path.glob("name=*")} == {f"name=n{i}": 1 for i in range(5)}
    features, removals = stores.load_selections(spark, str(path))
    assert features.count() == removals.count() == 320


def test_raw_ids_are_looked_up_by_their_places(spark):
    g = network.build_graph(spark.createDataFrame([(0, 1, 1, "LineString", [(-0.5, 0.25), (-0.499, 0.25), (0.0, -1.0)], {})], "area_id long, feature_id long, feature_ord long, geom_type string, coords array<struct<lng:double,lat:double>>, properties map<string,string>"))
    own = [r.edge_id for r in edits.with_ids(g.edges).select("edge_id").collect()]
    turned = ["|".join(reversed(i.split("|"))) for i in own]
    odd = [*turned, "0.250,-0.5|0.25,-0.499", "0.25,-0.5", "", "|", "a,b|c,d", "0.25,-0.5,1|0.25,-0.499", "0.25,-0.5|9,9", own[0] + "|"]
    ids = spark.createDataFrame([(0, i) for i in [*own, *odd]], "area_id long, edge_id string")
    assert {r.edge_id for r in edits.named_pairs(ids).collect()} == {*own, "0.25,-0.5|9,9"} and len(own) == 2
    log = ids.withColumn("edge_id", F.concat(F.lit(edits.PHYSICAL), "edge_id"))
    report = edits.removal_report(g, log)
    assert {r.edge_id for r in report.where("known").collect()} == set(own) and report.count() == len({*own, *odd})
    assert edits.remove_raw(g, ids.where(F.col("edge_id").isin(odd))).edges.count() == 2 and edits.remove_raw(g, ids).edges.count() == 0
    known = g.edges.where("u = 0")
    # An id's text is no part of the filters on it.
    plan = edits.with_ids(known).where(F.col("edge_id").startswith("0"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("lpad" not in line for line in plan.splitlines() if "Filter" in line)


def generated_methods(df):
    """Bytes of the largest generated method of each compiled stage of a plan, with adaptive planning off."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]


def test_distances_are_small_enough_to_be_compiled(spark):
    points = spark.createDataFrame([(0, 1, 0.0005, 0.0001)], "area_id long, point_id long, lng double, lat double")
    segments = spark.createDataFrame([(0, 7, 0, 0, 0.0, 0.0, 0.001, 0.0)], SEGMENTS.replace("feature_ord", "feature_id long, feature_ord"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = proximity.features_within(points, segments, 20.0)
        sizes = generated_methods(found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # The JVM interprets methods of over 8000 bytes.
    assert sizes and max(sizes) < 8000 and [tuple(r) for r in found.collect()] == [(0, 1, 7)]


def test_first_pairs_and_first_places_need_no_sorted_aggregate(spark):
    f = spark.createDataFrame([(0, i, i, "LineString", c, {}) for i, c in enumerate([[(0.0, 0.0), (0.002, 0.002)], [(0.0, 0.002), (0.002, 0.0)], [(0.001, 0.0), (0.001, 0.002)], [(0.0010000004, 0.0), (0.0009999996, 0.002)]])], "area_id long, feature_id long, feature_ord long, geom_type string, coords array<struct<lng:double,lat:double>>, properties map<string,string>")
    s = filters.flatten_segments(f)
    found = crossings.crossings(s)
    at = {r.node: (r.a_ord, r.b_ord) for r in found.collect()}
    assert at[(90_001_000) * 400_000_000 + 180_001_000] == (0, 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g = network.build_graph(f)
        plans = [crossings.crossings(s)._jdf.queryExecution().executedPlan().toString(), g.nodes._jdf.queryExecution().executedPlan().toString()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all("SortAggregate" not in p for p in plans)
    # Of each place, the end that comes first over all pieces, as both ends of every piece give it.
    ends = {}
    for e in network.build_graph(f, split_all=True).edges.union(g.edges).collect():
        for node, c in ((e.u, e.coords[0]), (e.v, e.coords[1])):
            ends.setdefault(node, set()).add((c.lat, c.lng))
    assert {n.node for n in g.nodes.collect()} >= set(at) and all((n.lat, n.lng) in ends[n.node] for n in g.nodes.collect() if n.node in ends)


def test_a_model_without_seconds_needs_no_heights(spark):
    ways = [(1, 10, [(0.0, 0.0), (0.0003, 0.0), (0.0009, 0.0)]), (1, 11, [(0.5, 0.5)]), (1, 12, [(0.0009, 0.0), (0.0, 0.0)]), (2, 3, [(1.0, 1.0), (1.0, 1.001)])]
    e = spark.createDataFrame([(a, (o, 0, 0), o, o + 1, 1.0, c) for a, o, c in ways], "area_id long, edge_ord struct<feature_ord:long,segment_idx:int,j:int>, u long, v long, weight double, coords array<struct<lng:double,lat:double>>")
    stored = spark.createDataFrame([(0, 0, 100.0), (3000, 0, 103.0), (9000, 0, 101.5)], "lng_e7 long, lat_e7 long, elev double")
    m = windy.windy_model(e, stored)
    # The edge of one point keeps its number, but has no variable.
    names = {(1, "e0f"), (1, "e0r"), (1, "e2f"), (1, "e2r"), (2, "e0f"), (2, "e0r")}
    for t in (m.objective, m.cover, m.bounds, m.ways):
        assert {(r.area_id, r.var) for r in t.collect()} == names and t.count() == 6
    walked = windy.traversals(m, m.bounds.select("area_id", "var", F.lit(1.0).alias("value")))
    assert {tuple(r) for r in walked.collect()} == {(a, *p, 1) for a, o, c in ways if len(c) > 1 for p in ((o, o + 1), (o + 1, o))}
    assert all("elev" not in t._jdf.queryExecution().optimizedPlan().toString() for t in (m.cover, m.bounds, m.balance, walked))
    points = elevation.with_heights(elevation.route_points(e.withColumn("route_id", F.col("edge_ord.feature_ord")), "route_id"), stored)
    times = {(r.area_id, r.route_id): r for r in elevation.travel_times(points).collect()}
    climbs = {(r.area_id, r.route_id): r for r in elevation.climb(points).collect()}
    found = costs.edge_metrics(e, stored).collect()
    assert len(found) == 3
    for r in found:
        k = r.area_id, r.edge_ord.feature_ord
        assert (r.ascent, r.descent) == (climbs[k].ascent, climbs[k].descent) and (r.length, r.forward, r.reverse) == tuple(times[k])[2:]
    assert {tuple(r.edge_ord): (r.ascent, r.descent) for r in found}[10, 0, 0] == (3.0, 0.0)
    # One join with the heights, and points are derived and dealt to their edges once.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = costs.edge_metrics(e, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall("Join", plan)) == 1 and len(re.findall("Generate ", plan)) == 1


def test_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    assert runtime.dealt(df, 1000, "k").rdd.getNumPartitions() == 10 and runtime.dealt(df, 100, "k") is df
    monkeypatch.setattr(runtime, "TASK_ROWS", 60)
    tasks = {n: len([r for r in registry.QUERIES[n](spark, SF).select(F.spark_partition_id().alias("p")).distinct().collect()]) for n in ("position_at_distance", "nearest_profile_point")}
    assert min(tasks.values()) > 40
