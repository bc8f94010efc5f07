"""Lines of text in, features and rejects out; the tiled height store under several writers."""

from __future__ import annotations

import json

from routecover.operators.network import build_graph
from routecover.sources import stores, ways
from tests.test_network import lines

PLACES = "lng_e7 long, lat_e7 long, elev double"


def text(spark, *rows):
    return spark.createDataFrame([(r if r is None or isinstance(r, str) else json.dumps(r),) for r in rows], "line string")


def way(**over):
    return {"area_id": 7, "type": "way", "id": 3, "tags": {"highway": "path"}, "geometry": [{"lat": 1.5, "lon": 2.5}, {"lat": 1.25, "lon": 2.75}]} | over


def test_way_lines_and_rejects(spark):
    bad = (None, "", "  ", '{"area_id": 7, "id"', way(area_id=None), way(id=None), way(type="node"), way(id="three"))
    good = (way(), way(id=4, geometry=None), way(id=5, geometry=[], tags=None), way(id=6, ord=1, geometry=[{"lat": 9.0, "lon": 8.0}], extra={"bad": "x"}))
    features, rejected = ways.way_lines(text(spark, *good, *bad))
    rows = {r.feature_id: r for r in features.collect()}
    assert set(rows) == {3, 4, 5, 6} and {r.area_id for r in rows.values()} == {7}
    assert [(p.lng, p.lat) for p in rows[3].coords] == [(2.5, 1.5), (2.75, 1.25)] and rows[3].geom_type == "LineString"
    assert rows[4].coords == [] and rows[5].geom_type == "Point" and rows[5].properties is None
    assert (rows[6].feature_ord, rows[3].feature_ord) == (1, 3) and rows[6].geom_type == "Point"
    assert dict(rejected.groupBy("reason").count().collect()) == {"empty": 3, "malformed": 2, "no area or id": 2, "other": 1}


def test_lines_of_no_file(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    features, rejected = ways.way_lines(ways.read_lines(spark, str(tmp_path)))
    assert features.count() == 0 and rejected.count() == 0


def test_edges_come_back_from_their_lines(spark):
    edges = build_graph(lines(spark, [[(0.0, 0.0), (0.002, 0.002)], [(0.0, 0.002), (0.002, 0.0)]], [[(5.123456789, 5.0), (5.2, -5.1)]])).edges
    features, rejected = ways.feature_lines(ways.edge_lines(edges))
    assert rejected.count() == 0
    pair = lambda df: sorted((r.area_id, *((p.lng, p.lat) for p in r.coords)) for r in df.collect())
    assert pair(features) == pair(edges)
    point = {"area_id": 1, "type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}
    features, rejected = ways.feature_lines(text(spark, point, {"area_id": 1, "type": "FeatureCollection", "id": "c"}, "[1"))
    assert [(r.geom_type, r.coords) for r in features.collect()] == [("Point", [])]
    assert {r.reason for r in rejected.collect()} == {"other", "malformed"}


def test_one_height_a_place_under_two_writers(spark, tmp_path):
    path = str(tmp_path / "heights")
    df = lambda *rows: spark.createDataFrame(list(rows), PLACES)
    assert stores.read_heights(spark, path).count() == 0
    stores.compact_heights(spark, path)
    stores.add_heights(spark, path, df((5, 5, 30.0), (5, 5, 20.0), (None, 5, 1.0), (6, 6, None), (-5, -5, 1.0)), 10)
    # The second writer began before the first was done.
    other = str(tmp_path / "other")
    stores.add_heights(spark, other, df((5, 5, 7.0), (3_000_000, 5, 8.0)), 9)
    spark.read.schema(stores.STORED).parquet(other).write.partitionBy("tile").mode("append").parquet(path)
    expected = {(5, 5): 7.0, (-5, -5): 1.0, (3_000_000, 5): 8.0}
    held = lambda **k: {(r.lng_e7, r.lat_e7): r.elev for r in stores.read_heights(spark, path, **k).collect()}
    assert held() == expected and spark.read.parquet(path).count() == 4
    stores.compact_heights(spark, path)
    assert held() == expected and spark.read.parquet(path).count() == 3
    stores.add_heights(spark, path, df((5, 5, 99.0), (-5, -5, 99.0)), 11)
    assert held() == expected and spark.read.parquet(path).count() == 3
    assert held(near=df((3_000_001, 9, None))) == {(3_000_000, 5): 8.0} and held(near=df((2_999_999, 9, None))) == {}


def test_tiles_split_at_their_borders(spark):
    rows = spark.createDataFrame([(-1, 0, 0.0), (0, 0, 0.0), (999_999, 999_999, 0.0), (1_000_000, 0, 0.0), (0, -1, 0.0)], PLACES).select(stores.tile().alias("t")).collect()
    assert rows[1] == rows[2] and len({r.t for r in rows}) == 4
