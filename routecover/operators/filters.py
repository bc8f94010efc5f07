"""Filters, selections and summaries of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecover.functions.geo import polyline_length

# The way classes that count as trails and as roads.
TRAIL_CLASSES = ("path", "footway", "track", "bridleway", "steps", "cycleway")
ROAD_CLASSES = ("residential", "unclassified", "tertiary", "secondary", "primary", "service", "living_street", "pedestrian")


def is_selected_way(roads: bool = False, sidewalks: bool = False, tags: str = "properties") -> Column:
    """Trails, roads if asked for, and sidewalks among footways only if asked for."""
    tag = lambda k: F.coalesce(F.col(tags)[k], F.lit(""))
    wanted = tag("highway").isin(*TRAIL_CLASSES, *(ROAD_CLASSES if roads else ()))
    return wanted if sidewalks else wanted & ~((tag("highway") == "footway") & (tag("footway") == "sidewalk"))


def is_open_line(tags: str = "properties") -> Column:
    """Neither an area nor indoors."""
    return (F.coalesce(F.col(tags)["area"], F.lit("")) != "yes") & (F.coalesce(F.col(tags)["indoor"], F.lit("")) != "yes")


def is_line() -> Column:
    return F.col("geom_type") == "LineString"


def select_ways(features: DataFrame, *, roads: bool = False, sidewalks: bool = False) -> DataFrame:
    return features.where(is_selected_way(roads, sidewalks) & is_open_line())


def feature_length() -> Column:
    """Metres of a line, 0 for other geometries."""
    return F.when(is_line(), polyline_length("coords")).otherwise(F.lit(0.0))


def at_least_long(features: DataFrame, metres: float) -> DataFrame:
    """Lines of ``metres`` or more; everything if ``metres`` is not positive."""
    return features if metres <= 0 else features.where(feature_length() >= metres)


def flatten_segments(features: DataFrame) -> DataFrame:
    """``(area_id, feature_id, feature_ord, segment_idx, ax, ay, bx, by)`` of consecutive vertices of lines."""
    lines = features.where(is_line()).select("area_id", "feature_id", "feature_ord", "coords", F.posexplode("coords").alias("segment_idx", "a"))
    flat = lines.where(F.col("segment_idx") < F.size("coords") - 1).withColumn("b", F.get("coords", F.col("segment_idx") + 1))
    return flat.select("area_id", "feature_id", "feature_ord", "segment_idx", F.col("a.lng").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lng").alias("bx"), F.col("b.lat").alias("by"))


def in_boxes(features: DataFrame, areas: DataFrame) -> DataFrame:
    """Whole features of which a segment's box meets the area's box."""
    f = flatten_segments(features).join(areas.select("area_id", "south", "west", "north", "east"), "area_id")
    meets = (F.least("ax", "bx") <= F.col("east")) & (F.greatest("ax", "bx") >= F.col("west")) & (F.least("ay", "by") <= F.col("north")) & (F.greatest("ay", "by") >= F.col("south"))
    return features.join(f.where(meets).select("area_id", "feature_id").distinct(), ["area_id", "feature_id"], "left_semi")


def inside_polygon(lng: Column, lat: Column, polygon: Column) -> Column:
    """Even-odd rule over the polygon's edges."""
    closed = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    edges = F.zip_with(polygon, closed, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def flips(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.when(spans, b["lat"] - a["lat"])
        return F.coalesce(spans & (lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / rise + a["lng"]), F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != flips(e))


def polygon_box(polygon: Column) -> Column:
    """Struct (south, west, north, east) of a polygon's vertices."""
    values = lambda k: F.transform(polygon, lambda p: p[k])
    return F.struct(F.array_min(values("lat")).alias("south"), F.array_min(values("lng")).alias("west"), F.array_max(values("lat")).alias("north"), F.array_max(values("lng")).alias("east"))


def in_areas(features: DataFrame, areas: DataFrame) -> DataFrame:
    """Features in each area's polygon (any vertex inside), or in its box where it has none of three vertices or more."""
    has_polygon = F.coalesce(F.size("polygon") >= 3, F.lit(False))
    boxed = in_boxes(features, areas.where(~has_polygon))
    shaped = features.join(areas.where(has_polygon).select("area_id", "polygon"), "area_id")
    box = polygon_box(F.col("polygon"))
    near = F.exists("coords", lambda p: p["lng"].between(box["west"], box["east"]) & p["lat"].between(box["south"], box["north"]))
    held = F.exists("coords", lambda p: inside_polygon(p["lng"], p["lat"], F.col("polygon")))
    return boxed.unionByName(shaped.where(near & held).drop("polygon").select(*features.columns))


def summary(features: DataFrame) -> DataFrame:
    """Lines, vertices and metres per area."""
    return features.groupBy("area_id").agg(
        F.count(F.when(is_line(), 1)).alias("trail_count"),
        F.coalesce(F.sum(F.when(is_line(), F.size("coords"))), F.lit(0)).cast("long").alias("vertex_count"),
        F.sum(feature_length()).alias("total_m"),
    )
