"""Nearest vertex and features within a distance, by grid joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.functions.geo import distance_to_segment, planar_metres
from routecover.runtime import cut, once


def snap(points: DataFrame, nodes: DataFrame, *, cell: float = 0.002, max_rounds: int = 40) -> DataFrame:
    """``(area_id, point_id, node, lng, lat)``: each point's nearest node in squared degrees, the first of equals.

    A point looks at the cells around its own, and is settled once the best is within what those cells surely cover; the rest look
    again with doubled cells, so empty regions cost a few rounds over few points. Points of areas without nodes have no row.
    """
    left = points.join(nodes.select("area_id").distinct(), "area_id", "left_semi")
    done = None
    for _ in range(max_rounds):
        at = lambda x: F.floor(F.col(x) / cell).cast("long")  # noqa: B023, E731
        around = left.withColumn("cx", F.explode(F.sequence(at("lng") - 1, at("lng") + 1))).withColumn("cy", F.explode(F.sequence(at("lat") - 1, at("lat") + 1)))
        cells = nodes.select("area_id", at("lng").alias("cx"), at("lat").alias("cy"), F.struct("node_ord", "node", F.col("lng").alias("x"), F.col("lat").alias("y")).alias("n"))
        met = around.join(cells, ["area_id", "cx", "cy"])
        dx, dy = F.col("n.x") - F.col("lng"), F.col("n.y") - F.col("lat")
        best = met.groupBy("area_id", "point_id", "lng", "lat").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "n")).alias("b")).where(F.col("b.d") <= cell * cell)
        settled = cut(best.select("area_id", "point_id", F.col("b.n.node").alias("node"), F.col("b.n.x").alias("lng"), F.col("b.n.y").alias("lat")))
        done = settled if done is None else done.unionByName(settled)
        left = cut(left.join(settled.select("area_id", "point_id"), ["area_id", "point_id"], "left_anti"))
        if left.isEmpty():
            return done
        cell *= 2
    raise RuntimeError("some points are further from every node than the grid can grow")


def features_within(points: DataFrame, segments: DataFrame, metres: float, *, cell: float = 0.002) -> DataFrame:
    """``(area_id, point_id, feature_id)`` once for every feature strictly within ``metres`` of a point.

    Distances are planar around the point. Segments lie in all cells that their box meets; points look as many cells around as the distance needs.
    """
    at = lambda x: F.floor(x / cell).cast("long")
    laid = segments.withColumn("cx", F.explode(F.sequence(at(F.least("ax", "bx")), at(F.greatest("ax", "bx"))))).withColumn("cy", F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by")))))
    per_lng, per_lat = planar_metres("lat")
    reach_x, reach_y = metres / per_lng, metres / per_lat
    asked = points.withColumn("cx", F.explode(F.sequence(at(F.col("lng") - reach_x), at(F.col("lng") + reach_x)))).withColumn("cy", F.explode(F.sequence(at(F.col("lat") - reach_y), at(F.col("lat") + reach_y))))
    x, y = (lambda c: ((F.col(c) - F.col("lng")) * per_lng).alias(c)), (lambda c: ((F.col(c) - F.col("lat")) * per_lat).alias(c))
    celled = lambda df: df.withColumn("cell", F.shiftleft("cx", 32) + F.col("cy")).drop("cx", "cy")
    met = celled(asked).join(celled(laid), ["cell", "area_id"])
    met = met.select("area_id", "point_id", "feature_id", x("ax"), y("ay"), x("bx"), y("by"))
    # In the join's condition the distance would repeat its parts, too large a method to be compiled.
    near = once(met, "d", m=distance_to_segment(F.lit(0.0), F.lit(0.0), "ax", "ay", "bx", "by")).where(F.col("d.m") < metres)
    return near.select("area_id", "point_id", "feature_id").distinct()
