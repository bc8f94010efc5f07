"""Heights of points, profiles and positions along routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routecover.functions.geo import between, haversine, micro
from routecover.functions.terrain import SMOOTHING_M, gain_and_loss, step_seconds
from routecover.operators.scans import scanned
from routecover.runtime import dealt

RESPONSE = "results array<struct<value:string>>, value string"


def route_points(lines: DataFrame, route: str = "feature_id") -> DataFrame:
    """``(area_id, route_id, seq, lng, lat)`` of the vertices of lines."""
    return lines.select("area_id", F.col(route).alias("route_id"), F.posexplode("coords").alias("seq", "c")).select("area_id", "route_id", "seq", "c.lng", "c.lat")


def parsed_heights(responses: DataFrame) -> DataFrame:
    """``(response_id, pos, elev)`` from response texts: each result in order, 0 where it is missing or no finite number."""
    parsed = responses.select("response_id", F.from_json("body", RESPONSE).alias("r"))
    results = F.coalesce(F.col("r.results"), F.array(F.struct(F.col("r.value").alias("value"))))
    value = F.expr("try_cast(entry.value as double)")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return parsed.select("response_id", F.posexplode(results).alias("pos", "entry")).select("response_id", "pos", F.when(fine, value).otherwise(0.0).alias("elev"))


def misses(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct places ``(lng_e7, lat_e7, lng, lat)`` without a stored height."""
    keyed = points.select(micro("lng", 7).alias("lng_e7"), micro("lat", 7).alias("lat_e7"), "lng", "lat")
    keyed = keyed.groupBy("lng_e7", "lat_e7").agg(F.min(F.struct("lng", "lat")).alias("p")).select("lng_e7", "lat_e7", "p.lng", "p.lat")
    return keyed.join(stored, ["lng_e7", "lat_e7"], "left_anti")


def missing_samples(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id")) -> DataFrame:
    """``(*keys, points, missing)``: points of each route, and those without a stored height, which count as 0 m in climb and time."""
    return points.groupBy(*keys).agg(F.count("*").alias("points"), F.count(F.when(~F.col("sampled"), 1)).alias("missing"))


def bucket_count(missing: DataFrame, per_bucket: int = 50_000) -> int:
    """Buckets of about ``per_bucket`` places, 64 at least, so that a bucket's numbering is one task's work at any size."""
    return max(64, -(-missing.count() // per_bucket))


def request_batches(missing: DataFrame, size: int = 100, buckets: int | None = None) -> DataFrame:
    """``(bucket, batch, points, payload)``: places in multipoint requests of at most ``size`` (S8), numbered within hash buckets, as many as the places need."""
    buckets = buckets or bucket_count(missing)
    bucketed = missing.withColumn("bucket", F.pmod(F.col("lat_e7") + F.col("lng_e7"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("bucket").orderBy("lat_e7", "lng_e7")
    numbered = bucketed.withColumn("n", F.row_number().over(order) - 1)
    point = F.array("lng", "lat")
    grouped = numbered.groupBy("bucket", F.expr("n div " + str(size)).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", point.alias("p")))).alias("ps"))
    payload = F.to_json(F.struct(F.col("ps.p").alias("points"), F.struct(F.lit(4326).alias("wkid")).alias("spatialReference")))
    return grouped.select("bucket", "batch", F.size("ps").alias("points"), payload.alias("payload"))


def with_heights(points: DataFrame, stored: DataFrame, rows: int = 0) -> DataFrame:
    """Points with ``elev``, 0 where nothing is stored, and ``sampled`` (J7). ``rows``, about how many points there are, keeps tasks small."""
    keyed = dealt(points.withColumns({"lng_e7": micro("lng", 7), "lat_e7": micro("lat", 7)}), rows, "lng_e7", "lat_e7")
    joined = keyed.join(stored, ["lng_e7", "lat_e7"], "left")
    return joined.withColumn("sampled", F.col("elev").isNotNull()).withColumn("elev", F.coalesce("elev", F.lit(0.0))).drop("lng_e7", "lat_e7")


def profile(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id")) -> DataFrame:
    """Points with ``step`` and running ``dist`` in metres (W1, W4). Rows are sorted by the last key first, which tells most of them apart."""
    order = Window.partitionBy(*reversed(keys)).orderBy("seq")
    step = F.coalesce(haversine(F.lag("lat").over(order), F.lag("lng").over(order), "lat", "lng"), F.lit(0.0))
    return points.withColumn("step", step).withColumn("dist", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def smoothed(profiled: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id"), window_m: int = SMOOTHING_M) -> DataFrame:
    """A profile with ``smooth``: the mean height within half the window before and after."""
    near = Window.partitionBy(*reversed(keys)).orderBy("dist").rangeBetween(-(window_m // 2), window_m // 2)
    return profiled.withColumn("smooth", F.avg("elev").over(near))


def profile_in_slices(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id")) -> DataFrame:
    """:func:`profile` for routes of any length: steps and distances over range partitions, so no task holds a whole route."""
    before = scanned(points, keys, ["seq"], previous={"__lat": "lat", "__lng": "lng"})
    stepped = before.withColumn("step", F.coalesce(haversine("__lat", "__lng", "lat", "lng"), F.lit(0.0))).drop("__lat", "__lng")
    return scanned(stepped, keys, ["seq"], sums={"dist": F.col("step")})


def smoothed_in_stretches(profiled: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id"), window_m: int = SMOOTHING_M, stretch_m: int | None = None) -> DataFrame:
    """:func:`smoothed` for routes of any length: each stretch of ``stretch_m`` metres (64 windows) is a group, with the rows up to half a window beyond its ends.

    A row is sent to the stretches its window can reach, about one in 64 twice; only a stretch's own rows are returned. A task's work is set by
    the points in a stretch, not by the route.
    """
    half, width = window_m // 2, stretch_m or 64 * max(window_m, 1)
    cell = lambda d: F.floor(d / width)
    reach = half + 1  # a metre more than the window, against rounding at the ends of stretches
    laid = profiled.withColumn("__stretch", F.explode(F.sequence(cell(F.col("dist") - reach), cell(F.col("dist") + reach))))
    near = Window.partitionBy(*keys, "__stretch").orderBy("dist").rangeBetween(-half, half)
    return laid.withColumn("smooth", F.avg("elev").over(near)).where(F.col("__stretch") == cell(F.col("dist"))).drop("__stretch")


def climb(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id")) -> DataFrame:
    """Ascent and descent per route, from raw heights in order; a route's heights are one array."""
    raw = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "elev"))).alias("h"))
    return raw.withColumn("g", gain_and_loss(F.col("h.elev"))).select(*keys, "g.ascent", "g.descent")


def travel_times(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id"), long_routes: bool = False) -> DataFrame:
    """Seconds along each route and back, by smoothed grade (G7, G8), and its metres.

    ``long_routes`` takes routes apart into slices and stretches: the same times in more shuffles, for routes that one task can't hold.
    """
    if not long_routes:
        return climb_and_times(points, keys).where("forward is not null").select(*keys, "length", "forward", "reverse")
    level = smoothed_in_stretches(profile_in_slices(points, keys), keys)
    steps = scanned(level, keys, ["seq"], previous={"__before": "smooth"}).withColumn("rise", F.col("smooth") - F.col("__before"))
    return steps.where("rise is not null").groupBy(*keys).agg(
        F.sum("step").alias("length"), F.sum(step_seconds(F.col("step"), F.col("rise"))).alias("forward"), F.sum(step_seconds(F.col("step"), F.col("rise"), -1)).alias("reverse")
    )


def climb_and_times(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id")) -> DataFrame:
    """``(*keys, ascent, descent, length, forward, reverse)``: :func:`climb` and :func:`travel_times` in one pass over a route's points; of a route of one point the times are null.

    Distances rise along a route, so rows sorted once by distance and ``seq`` serve the smoothing window, the steps and the totals.
    """
    by = [*reversed(keys)]
    level = smoothed(profile(points.select(*keys, "seq", "lng", "lat", "elev"), keys).sortWithinPartitions(*by, "dist", "seq"), keys)
    along = Window.partitionBy(*by).orderBy("dist", "seq")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = level.withColumns({"rise": F.col("smooth") - F.lag("smooth").over(along), "__n": F.row_number().over(along)})
    taken = {"step": F.col("step"), "there": step_seconds(F.col("step"), F.col("rise")), "back": step_seconds(F.col("step"), F.col("rise"), -1)}
    timed = steps.withColumns({c: F.when(F.col("rise").isNotNull(), x) for c, x in taken.items()})
    totals = {"length": F.sum("step").over(whole), "forward": F.sum("there").over(whole), "reverse": F.sum("back").over(whole), "h": F.collect_list(F.struct("elev")).over(whole)}
    found = timed.withColumns(totals).where("__n = 1").withColumn("g", gain_and_loss(F.col("h.elev")))
    return found.select(*keys, "g.ascent", "g.descent", "length", "forward", "reverse")


def route_metrics(points: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id"), long_routes: bool = False) -> DataFrame:
    """Ascent and descent from raw heights, seconds from smoothed ones (G8); a route of one point takes no time."""
    if not long_routes:
        return climb_and_times(points, keys).select(*keys, "ascent", "descent", F.coalesce("forward", F.lit(0.0)).alias("seconds"))
    times = travel_times(points, keys, long_routes).select(*keys, F.col("forward").alias("seconds"))
    return climb(points, keys).join(times, list(keys), "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def preferred_metrics(points: DataFrame, modelled: DataFrame, keys: tuple[str, ...] = ("area_id", "route_id"), long_routes: bool = False) -> DataFrame:
    """``modelled(*keys, ascent, descent, seconds)`` with the measured values in their place where every height is known (G8), and ``measured``.

    A route is measured if it has over one point and each of them was ``sampled``. A measured route that isn't modelled is left out.
    """
    counts = missing_samples(points, keys)
    known = points.join(counts.where("points > 1 and missing = 0").select(*keys), list(keys), "left_semi")
    found = route_metrics(known, keys, long_routes).select(*keys, F.struct("ascent", "descent", "seconds").alias("m"))
    both = modelled.join(found, list(keys), "left")
    values = (F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("ascent", "descent", "seconds"))
    return both.select(*keys, *values, F.col("m").isNotNull().alias("measured"))


def profile_extent(profiled: DataFrame) -> DataFrame:
    """Per route the least and greatest height, the length, and five height and six distance ticks."""
    e = profiled.groupBy("area_id", "route_id").agg(F.min("elev").alias("low"), F.max("elev").alias("high"), F.max("dist").alias("length"))
    e = e.withColumn("range", F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low")))
    ticks = lambda n, start, width: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + width * i / (n - 1), 3))
    return e.withColumns({"height_ticks": ticks(5, F.col("low"), F.col("range")), "distance_ticks": ticks(6, F.lit(0.0), F.col("length"))})


def position_at(profiled: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(area_id, route_id, query_id, d)`` with ``lng, lat`` at that distance along the route; past the end, its end."""
    order = Window.partitionBy("area_id", "route_id").orderBy("seq")
    legs = profiled.withColumns({c: F.lead(x).over(order) for c, x in (("to_dist", "dist"), ("to_lng", "lng"), ("to_lat", "lat"))})
    points = legs.select("area_id", "route_id", F.col("dist").alias("at"), F.lit(0).alias("kind"), "seq", F.struct("dist", "lng", "lat", "to_dist", "to_lng", "to_lat").alias("leg"), F.lit(None).cast("long").alias("query_id"))
    probes = asked.select("area_id", "route_id", F.col("d").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast(points.schema["leg"].dataType).alias("leg"), F.col("query_id").cast("long"))
    upto = Window.partitionBy("area_id", "route_id").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(probes).withColumn("leg", F.last("leg", ignorenulls=True).over(upto)).where("kind = 1 and leg is not null")
    length = F.col("leg.to_dist") - F.col("leg.dist")
    t = F.when(length > 0, (F.col("at") - F.col("leg.dist")) / F.when(length > 0, length)).otherwise(0.0)
    place = lambda c: F.coalesce(between(f"leg.{c}", f"leg.to_{c}", t), F.col(f"leg.{c}")).alias(c)
    return found.select("area_id", "route_id", "query_id", F.col("at").alias("d"), place("lng"), place("lat"))


def nearest_profile_point(profiled: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the ``seq`` of the point at or after the distance, or the one before if that is strictly nearer."""
    points = profiled.select("area_id", "route_id", F.col("dist").alias("at"), F.lit(1).alias("kind"), "seq", F.struct("dist", "seq").alias("p"), F.lit(None).cast("long").alias("query_id"))
    probes = asked.select("area_id", "route_id", F.col("d").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.col("query_id").cast("long"))
    order = Window.partitionBy("area_id", "route_id").orderBy("at", "kind", "seq")
    both = points.unionByName(probes).withColumns({
        "before": F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).where("kind = 0 and (before is not null or after is not null)")
    back = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("at") - F.col("before.dist") < F.col("after.dist") - F.col("at")))
    return both.select("area_id", "route_id", "query_id", F.col("at").alias("d"), F.when(back, F.col("before.seq")).otherwise(F.col("after.seq")).alias("seq"))
