"""Geometry, identity keys and display texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000
M_PER_DEGREE = 111_320
ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1: ColumnOrName, lng1: ColumnOrName, lat2: ColumnOrName, lng2: ColumnOrName) -> Column:
    """Metres along the great circle (L1)."""
    lat1, lng1, lat2, lng2 = map(col, (lat1, lng1, lat2, lng2))
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2) * half(lng1, lng2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def polyline_length(coords: ColumnOrName) -> Column:
    """Metres of an array of (lng, lat); 0 for fewer than two points (L3)."""
    c = col(coords)
    steps = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(F.size(c) > 1, F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)).otherwise(F.lit(0.0))


def micro(degrees: ColumnOrName, digits: int = 6) -> Column:
    """A coordinate as a whole number of 10**-digits degrees, halves upwards."""
    return F.floor(col(degrees) * 10**digits + 0.5).cast("long")


def node_id(lng_e6: ColumnOrName, lat_e6: ColumnOrName) -> Column:
    """One number for a place in micro-degrees, as joins and loops use it."""
    return (col(lat_e6).cast("long") + 90_000_000) * 400_000_000 + col(lng_e6) + 180_000_000


def micro_text(e6: ColumnOrName) -> Column:
    """The shortest decimal text of micro-degrees."""
    n = col(e6).cast("long")
    size = F.abs(n)
    whole, part = F.floor(size / 1_000_000).cast("string"), size % 1_000_000
    return F.concat(F.when(n < 0, "-").otherwise(""), whole, F.when(part > 0, F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0")))).otherwise(""))


def node_key(node: ColumnOrName) -> Column:
    """``lat,lng`` of a node number (L4)."""
    n = col(node)
    lat, lng = F.floor(n / 400_000_000) - 90_000_000, F.pmod(n, F.lit(400_000_000)) - 180_000_000
    return F.concat_ws(",", micro_text(lat), micro_text(lng))


def edge_id(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Two node keys in string order, joined by a bar."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def physical_id(edge: ColumnOrName) -> Column:
    return F.concat(F.lit("physical:"), col(edge))


def crossing_fraction(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column]:
    """Where the segments a-b and c-d meet, as fractions of each; null if they are parallel or too short (L2)."""
    ex, ey, fx, fy = col(bx) - col(ax), col(by) - col(ay), col(dx) - col(cx), col(dy) - col(cy)
    denominator = ex * fy - ey * fx
    safe = F.when(F.abs(denominator) >= 1e-12, denominator)
    gx, gy = col(cx) - col(ax), col(cy) - col(ay)
    return (gx * fy - gy * fx) / safe, (gx * ey - gy * ex) / safe


def planar_metres(lat0: ColumnOrName) -> tuple[Column, Column]:
    """Metres per degree of longitude and of latitude near a latitude."""
    return M_PER_DEGREE * F.cos(F.radians(col(lat0))), F.lit(float(M_PER_DEGREE))


def distance_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from a point to a segment; of a segment without length, to its point."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(squared > 0, squared)))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def between(a: ColumnOrName, b: ColumnOrName, t: ColumnOrName) -> Column:
    """Linear interpolation."""
    return col(a) + (col(b) - col(a)) * col(t)


def bbox_area(south, west, north, east) -> Column:
    """Square metres of a box."""
    south, west, north, east = map(col, (south, west, north, east))
    return F.abs((north - south) * M_PER_DEGREE * (east - west) * M_PER_DEGREE * F.cos(F.radians((north + south) / 2)))


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def _whole(x: Column) -> Column:
    """Halves upwards, with thousands commas."""
    return F.format_number(F.floor(x + 0.5), 0)


def area_text(square_metres: ColumnOrName) -> Column:
    """mi², acres or ft²."""
    m = col(square_metres)
    miles, acres = m / 2_589_988, m / 4046.86
    return (
        F.when(miles >= 0.01, F.concat(_fixed(miles, 1), F.lit(" mi²")))
        .when(acres >= 0.01, F.concat(_fixed(acres, 1), F.lit(" acres")))
        .otherwise(F.concat(_whole(m * 10.7639), F.lit(" ft²")))
    )


def elevation_text(metres: ColumnOrName) -> Column:
    return F.concat(_whole(col(metres) * 3.28084), F.lit(" ft"))


def distance_text(metres: ColumnOrName) -> Column:
    """Miles from one mile on, else feet."""
    feet = col(metres) * 3.28084
    return F.when(feet >= 5280, F.concat(_fixed(feet / 5280, 1), F.lit(" mi"))).otherwise(elevation_text(metres))


def duration_text(seconds: ColumnOrName) -> Column:
    """Seconds under a minute, else minutes, else hours and minutes (L12); what is no finite number is written as it is, in seconds."""
    s = col(seconds)
    unclear = F.isnan(s) | (F.abs(s) == float("inf"))
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60 + 0.5)
    return (
        F.when(unclear, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 60, F.concat(F.floor(s + 0.5).cast("string"), F.lit(" s")))
        .when(hours == 0, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
    )


def coordinate_text(degrees: ColumnOrName) -> Column:
    return _fixed(col(degrees), 6)


def escaped_xml(text: ColumnOrName) -> Column:
    """Text safe inside an element."""
    out = col(text)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out
