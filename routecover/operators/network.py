"""The graph of an area: nodes, edges, adjacency, degrees, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routecover.functions.geo import haversine, micro, node_id
from routecover.operators.components import connected_components
from routecover.operators.crossings import crossings, split_segments
from routecover.operators.filters import flatten_segments
from routecover.runtime import Rounds, settled

SHORTEST_EDGE_M = 0.1


@dataclass
class Graph:
    """``nodes(area_id, node, lat, lng, node_ord)`` and ``edges(area_id, edge_ord, u, v, weight, coords)``."""

    nodes: DataFrame
    edges: DataFrame


def build_graph(features: DataFrame, *, split_all: bool = False) -> Graph:
    """Split all lines where they cross; a node is a place rounded to micro-degrees, with the coordinates first seen there.

    Pieces within one place or shorter than 0.1 m make no edge, but their nodes stay. Segments and pieces are written once; nodes and edges read the pieces, and what was written before those is deleted.
    """
    scratch = Rounds()
    segments = scratch.settle("segments", flatten_segments(features).drop("feature_id"))
    met = scratch.settle("met", crossings(segments, split_all=split_all, scratch=scratch, measured=True))
    scratch.drop_all(features.sparkSession, but=("segments", "met"))
    pieces = settled(split_segments(segments, met, repeated=split_all))
    scratch.drop_all(features.sparkSession)
    pieces = pieces.withColumns({"u": node_id(micro("x1"), micro("y1")), "v": node_id(micro("x2"), micro("y2")), "weight": haversine("y1", "x1", "y2", "x2")})
    at = lambda e: F.struct("feature_ord", "segment_idx", "j", F.lit(e).alias("e"))
    # The first end at a place is a line's start or a piece's end, and neither that of a piece within the place nor one at a crossing with an earlier segment.
    starts = F.when((F.col("segment_idx") == 0) & (F.col("j") == 0), F.struct(F.col("u").alias("node"), at(0).alias("node_ord"), F.col("y1").alias("lat"), F.col("x1").alias("lng")))
    stops = F.when(~F.col("u").eqNullSafe(F.col("v")) & F.col("own"), F.struct(F.col("v").alias("node"), at(1).alias("node_ord"), F.col("y2").alias("lat"), F.col("x2").alias("lng")))
    ends = pieces.select("area_id", F.explode(F.array(starts, stops)).alias("n")).where("n is not null").select("area_id", "n.*")
    # Few ends share a place: a window sorts them once, where a minimum of structs would be sorted before and after the shuffle. The first key compares fast.
    first = Window.partitionBy("node", "area_id").orderBy("node_ord.feature_ord", "node_ord.segment_idx", "node_ord.j", "node_ord.e")
    nodes = ends.withColumn("before", F.lag(F.lit(True)).over(first)).where("before is null").select("area_id", "node", "lat", "lng", "node_ord")
    place = lambda x, y: F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))
    edges = pieces.where((F.col("u") != F.col("v")) & (F.col("weight") >= SHORTEST_EDGE_M)).select(
        "area_id", F.struct("feature_ord", "segment_idx", "j").alias("edge_ord"), "u", "v", "weight", F.array(place("x1", "y1"), place("x2", "y2")).alias("coords")
    )
    return Graph(nodes, edges)


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair of nodes: the shortest, then the first."""
    pair = (F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    best = edges.groupBy("area_id", *pair).agg(F.min(F.struct("weight", "edge_ord", "u", "v", "coords")).alias("e"))
    return best.select("area_id", "e.edge_ord", "e.u", "e.v", "e.weight", "e.coords")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(area_id, u, v, weight)`` both ways, the least weight of parallel edges."""
    both = edges.select("area_id", "u", "v", "weight").unionByName(edges.select("area_id", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    return both.groupBy("area_id", "u", "v").agg(F.min("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(area_id, node, degree)``: distinct neighbours, of nodes that have any."""
    both = edges.select("area_id", F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select("area_id", F.col("v").alias("node"), F.col("u").alias("to")))
    # Dealt by node at once: neighbours are told apart and counted without another shuffle.
    return both.repartition("node", "area_id").distinct().groupBy("node", "area_id").agg(F.count("*").alias("degree")).select("area_id", "node", "degree")


def odd_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where(F.col("degree") % 2 == 1)


def rebuilt(graph: Graph, edges: DataFrame, changed: DataFrame) -> Graph:
    """The graph with other edges, without the nodes that no edge touches in the areas of ``changed``; other areas keep all nodes."""
    touched = edges.select("area_id", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("__touched", F.lit(True))
    areas = changed.select("area_id").distinct().withColumn("__changed", F.lit(True))
    nodes = graph.nodes.join(touched, ["area_id", "node"], "left").join(areas, "area_id", "left")
    return Graph(nodes.where("__touched is not null or __changed is null").select(*graph.nodes.columns), edges)


def graph_components(graph: Graph) -> DataFrame:
    """``(area_id, node, component)``: every node, isolated ones as their own component."""
    linked = connected_components(graph.edges.select("area_id", "u", "v"), ("area_id",))
    return graph.nodes.select("area_id", "node").join(linked, ["area_id", "node"], "left").select("area_id", "node", F.coalesce("component", "node").alias("component"))


def component_warning(components: DataFrame) -> DataFrame:
    """Per area the number of components, and a text if some can't be reached."""
    # The texts of the warning.
    n = components.groupBy("area_id").agg(F.countDistinct("component").alias("components"))
    text = F.concat((F.col("components") - 1).cast("string"), F.lit(" disconnected component"), F.when(F.col("components") > 2, "s").otherwise(""), F.lit(" not reachable from start point."))
    return n.withColumn("warning", F.when(F.col("components") > 1, text))


def graph_totals(graph: Graph) -> DataFrame:
    """Nodes, edges, metres and odd nodes per area; parallel edges count each."""
    n = graph.nodes.groupBy("area_id").agg(F.count("*").alias("nodes"))
    e = graph.edges.groupBy("area_id").agg(F.count("*").alias("edges"), F.sum("weight").alias("metres"))
    o = odd_nodes(graph.edges).groupBy("area_id").agg(F.count("*").alias("odd"))
    out = n.join(e, "area_id", "left").join(o, "area_id", "left")
    return out.select("area_id", "nodes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "metres", "odd")))
