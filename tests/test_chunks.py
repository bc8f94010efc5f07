"""Components and lists worked off in chunks, and what the graph build leaves on disk."""

from __future__ import annotations

import random
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from routecover.operators import components, filters, matching, network, ranking
from routecover.operators.crossings import crossings
from routecover.operators.ranking import list_ends
from routecover.plans import registry
from routecover.runtime import chunks, codes
from tests.test_network import CHAIN, CROSS, NEAR, lines


def test_the_graph_build_leaves_its_pieces_only(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    g = network.build_graph(lines(spark, CROSS, NEAR))
    assert g.edges.count() == 6 and len(set(folder.iterdir()) - before) == 1


def test_crossing_fractions_are_taken_once(spark):
    plan = crossings(filters.flatten_segments(lines(spark, CROSS)))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("1.0E-12" not in line for line in joins)


def test_chains_within_a_chunk_need_no_steps_over_all_links(spark, monkeypatch):
    def steps(*_):
        raise AssertionError("steps over all links")

    pairs = [(a, i, i + 1) for a in (0, 1) for i in range(0, 400) if i != 200] + [(2, 7, 7), (2, 9, None), (2, 5, 3)]
    random.Random(1).shuffle(pairs)
    links = spark.createDataFrame(pairs, "area_id long, u long, v long")
    by_steps = {tuple(r) for r in components.connected_components(links, ("area_id",), contractions=0).collect()}
    monkeypatch.setattr(components, "_stars", steps)
    found = [tuple(r) for r in components.connected_components(links, ("area_id",)).collect()]
    assert len(found) == len(set(found)) and set(found) == by_steps
    assert {r for r in found if r[0] == 2} == {(2, 7, 7), (2, 3, 3), (2, 5, 3)} and (1, 150, 0) in by_steps and (1, 399, 201) in by_steps


def test_chunks_of_a_partition_hold_whole_areas(spark, monkeypatch):
    pairs = [(a, i, i + 1) for a in range(20) for i in range(40)]
    random.Random(2).shuffle(pairs)
    links = spark.createDataFrame(pairs, "area_id long, u long, v long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    monkeypatch.setattr(components, "chunks", partial(chunks, most=50))
    try:
        found = components._contracted(links, ["area_id"]).count()
        ends = {r["component"] for r in components.connected_components(links, ("area_id",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # 820 nodes, and at most one twice for each border between chunks.
    assert found <= 820 + 2 * 20 and ends == {0}


def test_lists_come_to_chunks_in_order(spark, monkeypatch):
    follow = ranking._followed

    def checked(batches):
        held = list(batches)
        at = [(r["area_id"], r["item"]) for b in held for r in b.to_pylist()]
        assert at == sorted(at)
        return follow(iter(held))

    monkeypatch.setattr(ranking, "_followed", checked)
    items = spark.range(300).select((F.col("id") % 3).alias("area_id"), F.col("id").alias("item")).orderBy(F.rand(1))
    following = items.where("item < 297").select("area_id", "item", (F.col("item") + 3).alias("next"))
    assert {r["end"] for r in list_ends(items, following).collect()} == {297, 298, 299}


def test_least_linked_and_codes():
    n = 2000
    order = np.random.default_rng(3).permutation(n)
    assert (components.least_linked(order[:-1], order[1:], n) == 0).all()
    code, first = codes([np.array([2, 1, 2, 1]), np.array([5, 9, 5, 3])])
    assert code.tolist() == [2, 1, 2, 0] and first.tolist() == [3, 1, 0]
    batches = [r for k in range(3) for r in __import__("pyarrow").table({"x": list(range(k, k + 2))}).to_batches()]
    assert [t.num_rows for t in chunks(batches, 4)] == [4, 2]


def test_lists_across_areas_and_circles(spark):
    items = spark.range(30).select(F.expr("id div 10").alias("area_id"), F.col("id").alias("item"))
    following = items.where("item % 10 != 9 or area_id = 2").select("area_id", "item", F.when(F.col("item") == 29, 20).otherwise(F.col("item") + 1).cast("long").alias("next"), F.lit(0.5).alias("cost"))
    ends = {r["item"]: (r["end"], r["left"], r["far"]) for r in list_ends(items, following, circles="drop").collect()}
    assert ends == {i: (i // 10 * 10 + 9, 9 - i % 10, (9 - i % 10) * 0.5) for i in range(20)}


def test_totals_with_connectors_leave_bare_nodes_out(spark, monkeypatch):
    g = network.build_graph(lines(spark, [*CHAIN, [(0.5, 0.5), (0.5000001, 0.5)]]))
    assert g.nodes.count() == 4
    none = spark.createDataFrame([], "area_id long, conn_ord long, from_lng double, from_lat double, to_lng double, to_lat double")
    monkeypatch.setattr(registry, "raw_graph", lambda *_: g)
    monkeypatch.setattr(registry, "connectors", lambda *_: none)
    assert [(r["nodes"], r["edges"]) for r in registry.connectors_added(spark, "").collect()] == [(3, 2)]


def test_areas_without_a_gain_are_looked_through_once(spark, monkeypatch):
    cost = {(1, 2): 10.0, (3, 4): 10.0, (1, 3): 1.0, (2, 4): 1.0}
    links = spark.createDataFrame([(a, u, v, c) for a in (0, 1) for (u, v), c in cost.items()], "area_id long, u long, v long, cost double")
    used = spark.createDataFrame([(0, 1, 2), (0, 3, 4), (1, 1, 3), (1, 2, 4)], "area_id long, u long, v long")
    seen, cycles = [], matching._better_cycles
    monkeypatch.setattr(matching, "_better_cycles", lambda left, now: (seen.append({r[0] for r in left.select("area_id").collect()}), cycles(left, now))[1])
    assert {tuple(r) for r in matching.improved(used, links).collect()} == {(a, *e) for a in (0, 1) for e in ((1, 3), (2, 4))}
    assert seen == [{0, 1}, {0}]
