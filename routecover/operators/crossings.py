"""Crossings of segments by a grid join, and segments split at them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routecover.functions.geo import crossing_fraction, haversine, micro, node_id
from routecover.runtime import Rounds, once


#: Segments are laid this far (in degrees) beyond a cell's border: a crossing counts in the cell of its place rounded to micro-degrees, at most half of this away.
MARGIN = 1e-6
#: A dense cell is cut into this many columns and rows: a power of two, so that cells of all levels nest exactly.
FINER = 8
LEVELS = 4
SEGMENT = ("area_id", "feature_ord", "segment_idx", "ax", "ay", "bx", "by")


def _laid(segments: DataFrame, size: float, within: bool) -> DataFrame:
    """Segments with each cell ``cx, cy`` of ``size`` that they pass; ``within`` the coarser cell that they came with.

    A segment is followed column by column: in each it takes only the rows between its two heights there, so a long diagonal takes
    about two cells a column, not its whole box.
    """
    at = lambda x: F.floor(x / size).cast("int")
    x0, x1, y0, y1 = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    first, last = at(x0 - MARGIN), at(x1 + MARGIN)
    if within:
        segments = segments.withColumnsRenamed({"cx": "ox", "cy": "oy"})
        first, last = F.greatest(first, F.col("ox") * FINER), F.least(last, F.col("ox") * FINER + FINER - 1)
    columns = once(segments, "c", first=first, last=last).where("c.first <= c.last").withColumn("cx", F.explode(F.sequence("c.first", "c.last")))
    inside = lambda x: F.greatest(x0, F.least(x1, x))
    height = lambda x: F.greatest(y0, F.least(y1, F.col("ay") + (x - F.col("ax")) / F.when(F.col("bx") != F.col("ax"), F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay"))))
    columns = once(columns, "h", left=height(inside(F.col("cx") * size - MARGIN)), right=height(inside((F.col("cx") + 1) * size + MARGIN)))
    left, right = F.col("h.left"), F.col("h.right")
    upright = F.col("ax") == F.col("bx")
    low, high = F.when(upright, y0).otherwise(F.least(left, right)), F.when(upright, y1).otherwise(F.greatest(left, right))
    first, last = at(low - MARGIN), at(high + MARGIN)
    if within:
        first, last = F.greatest(first, F.col("oy") * FINER), F.least(last, F.col("oy") * FINER + FINER - 1)
    rows = once(columns, "r", first=first, last=last).where("r.first <= r.last").withColumn("cy", F.explode(F.sequence("r.first", "r.last")))
    return rows.select(*SEGMENT, "cx", "cy")


def grid(segments: DataFrame, cell: float, most: int, scratch: Rounds | None = None) -> DataFrame:
    """Segments in the cells they pass, with ``level``: cells of over ``most`` segments are refined, up to ``LEVELS`` times. Its tables are left in ``scratch``."""
    scratch = Rounds() if scratch is None else scratch
    laid, out = scratch.settle("laid-0", _laid(segments, cell, False)), None
    for level in range(LEVELS):
        place = ["area_id", "cx", "cy"]
        dense = scratch.settle(f"dense-{level}", laid.groupBy(*place).agg(F.count("*").alias("c")).where(F.col("c") > most).drop("c")) if level + 1 < LEVELS else None
        done = dense is None or dense.isEmpty()
        part = (laid if done else laid.join(dense, place, "left_anti")).select(*SEGMENT, "cx", "cy", F.lit(level).alias("level"))
        out = part if out is None else out.unionByName(part)
        if done:
            return out
        laid = scratch.settle(f"laid-{level + 1}", _laid(laid.join(dense, place, "left_semi"), cell / FINER ** (level + 1), True))
    return out


def crossings(segments: DataFrame, *, cell: float = 0.002, split_all: bool = False, most: int = 1024, scratch: Rounds | None = None, measured: bool = False) -> DataFrame:
    """``(area_id, node, px, py, a_ord, a_idx, b_ord, b_idx)``: where two segments of an area meet; ``measured`` adds ``a_m, b_m``, the metres from each segment's start.

    One row per rounded place, of the first pair in (feature, segment) order; ``split_all`` keeps every pair. Each
    segment is laid in the grid cells that it passes, and a pair counts only in the cell of its rounded crossing, so it
    is found once, and all pairs of one place are found in one cell: the first of them is taken without another shuffle. ``cell`` is in degrees, about the extent of a segment; cells of over ``most`` segments are refined.
    Its tables are left in ``scratch``, for a caller that can drop them.
    """
    scratch = Rounds() if scratch is None else scratch
    # Sorts compare the first key fast, and both cell numbers in one tell most rows apart. The join's sides are equal but for names, so they read one shuffle.
    place = ["cell", "level", "area_id"]
    laid = grid(segments, cell, most, scratch).withColumn("cell", F.shiftleft(F.col("cx").cast("long"), 32) + F.col("cy").cast("long"))
    side = lambda p: laid.select(*place, *(F.col(c).alias(f"{p}_{c}") for c in SEGMENT[1:]))
    low, high = (lambda p, c: F.least(f"{p}_a{c}", f"{p}_b{c}")), (lambda p, c: F.greatest(f"{p}_a{c}", f"{p}_b{c}"))
    met = side("a").join(side("b"), place).where(
        ((F.col("a_feature_ord") < F.col("b_feature_ord")) | ((F.col("a_feature_ord") == F.col("b_feature_ord")) & (F.col("a_segment_idx") < F.col("b_segment_idx"))))
        & (low("a", "x") <= high("b", "x")) & (high("a", "x") >= low("b", "x")) & (low("a", "y") <= high("b", "y")) & (high("a", "y") >= low("b", "y"))
    )
    t, u = crossing_fraction("a_ax", "a_ay", "a_bx", "a_by", "b_ax", "b_ay", "b_bx", "b_by")
    # In the join's condition the fractions would be repeated in every comparison, too large a method to be compiled.
    hit = once(met, "f", t=t, u=u).where(F.col("f.t").between(0, 1) & F.col("f.u").between(0, 1)).withColumn("t", F.col("f.t"))
    px, py = F.col("a_ax") + F.col("t") * (F.col("a_bx") - F.col("a_ax")), F.col("a_ay") + F.col("t") * (F.col("a_by") - F.col("a_ay"))
    size = F.lit(cell) / F.element_at(F.array(*(F.lit(float(FINER**k)) for k in range(LEVELS))), F.col("level") + 1)
    hit = once(hit, "p", x=px, y=py)
    px, py = F.col("p.x"), F.col("p.y")
    hit = once(hit, "r", x=micro(px), y=micro(py))
    hit = hit.where(F.shiftleft(F.floor(F.col("r.x") / 1e6 / size), 32) + F.floor(F.col("r.y") / 1e6 / size) == F.col("cell"))
    pair = [F.col(f"{p}_{c}").alias(f"{p}_{n}") for p in "ab" for c, n in (("feature_ord", "ord"), ("segment_idx", "idx"))] + [px.alias("px"), py.alias("py")]
    pair += [haversine(f"{p}_ay", f"{p}_ax", py, px).alias(f"{p}_m") for p in "ab"] if measured else []
    found = hit.select(*place, node_id(F.col("r.x"), F.col("r.y")).alias("node"), *pair)
    if not split_all:
        first = Window.partitionBy("node", *place).orderBy("a_ord", "a_idx", "b_ord", "b_idx", "px", "py")
        found = found.withColumn("before", F.lag(F.lit(True)).over(first)).where("before is null")
    return found.select("area_id", "node", "px", "py", "a_ord", "a_idx", "b_ord", "b_idx", *(["a_m", "b_m"] if measured else []))


def split_segments(segments: DataFrame, met: DataFrame, *, repeated: bool = False) -> DataFrame:
    """``(area_id, feature_ord, segment_idx, j, x1, y1, x2, y2, own)``: the pieces of every segment between its ends and its measured crossings, by distance from its start.

    ``own`` is false if a piece ends at a crossing whose other segment comes earlier, so that the place has been seen before. ``repeated``: a place may be met more than once on a segment.
    """
    key = ["feature_ord", "segment_idx", "area_id"]
    on = lambda p: met.select(F.col(f"{p}_ord").alias(key[0]), F.col(f"{p}_idx").alias(key[1]), key[2], F.lit(1).alias("part"), F.col(f"{p}_m").alias("dist"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit(p == "a").alias("own"))
    inner = on("a").unionByName(on("b"))
    if repeated:
        inner = inner.groupBy(*key, "part", "dist", "x", "y").agg(F.max("own").alias("own"))
    ends = segments.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("dist"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(F.lit(2).alias("part"), F.lit(0.0).alias("dist"), F.col("bx").alias("x"), F.col("by").alias("y")),
    )).alias("p")).select(*key, "p.*", F.lit(True).alias("own"))
    order = Window.partitionBy(*key).orderBy("part", "dist", "x", "y")
    after = [F.lead(c).over(order).alias(n) for c, n in (("x", "x2"), ("y", "y2"), ("own", "own"))]
    pieces = ends.unionByName(inner).select("area_id", *key[:2], (F.row_number().over(order) - 1).alias("j"), F.col("x").alias("x1"), F.col("y").alias("y1"), *after)
    return pieces.where("x2 is not null")
