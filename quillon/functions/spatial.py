"""Geometry in WKT (points, lines, polygons of one ring) and positions on the globe, all native. Malformed text gives null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6_371_008.8  # mean radius in metres, fixed value
#: Metres a unit. Fixed values.
UNITS = {"metre": 1.0, "kilometre": 1000.0, "mile": 1609.344, "degree": math.pi * EARTH / 180, "radian": EARTH}


def geometry(wkt: Column) -> Column:
    """struct<kind, points>: the kind in capitals, points as struct<x,y>; a leading <reference system> is passed over."""
    bare = F.regexp_replace(wkt, r"^\s*<[^>]*>\s*", "")
    kind = F.upper(F.regexp_extract(bare, r"^\s*([A-Za-z]+)", 1))
    pairs = F.regexp_extract_all(bare, F.lit(r"([-+0-9.eE]+\s+[-+0-9.eE]+)"), 1)
    at = lambda p, i: F.split(p, r"\s+")[i].try_cast("double")
    return F.when(kind.isin("POINT", "LINESTRING", "POLYGON"), F.struct(kind.alias("kind"), F.transform(pairs, lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y"))).alias("points")))


def _segments(g: Column) -> Column:
    p = g["points"]
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(p) > 1, pairs).otherwise(F.transform(p, lambda a: F.struct(a.alias("a"), a.alias("b"))))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on(p: Column, s: Column) -> Column:
    box = (p["x"] >= F.least(s["a"]["x"], s["b"]["x"])) & (p["x"] <= F.greatest(s["a"]["x"], s["b"]["x"])) & (p["y"] >= F.least(s["a"]["y"], s["b"]["y"])) & (p["y"] <= F.greatest(s["a"]["y"], s["b"]["y"]))
    return box & (_turn(s["a"], s["b"], p) == 0)


def _meet(s: Column, t: Column) -> Column:
    cross = (_turn(s["a"], s["b"], t["a"]) * _turn(s["a"], s["b"], t["b"]) < 0) & (_turn(t["a"], t["b"], s["a"]) * _turn(t["a"], t["b"], s["b"]) < 0)
    return cross | _on(s["a"], t) | _on(s["b"], t) | _on(t["a"], s) | _on(t["b"], s)


def _on_edge(p: Column, g: Column) -> Column:
    return F.exists(_segments(g), lambda s: _on(p, s))


def _inside(p: Column, g: Column) -> Column:
    """Strictly inside a polygon's ring: an odd number of edges to the right."""
    def right(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * F.try_divide(p["y"] - a["y"], b["y"] - a["y"]) + a["x"])

    return (g["kind"] == "POLYGON") & ~_on_edge(p, g) & (F.size(F.filter(_segments(g), right)) % 2 == 1)


def sf_intersects(g: Column, h: Column) -> Column:
    touch = F.exists(_segments(g), lambda s: F.exists(_segments(h), lambda t: _meet(s, t)))
    return touch | F.exists(g["points"], lambda p: _inside(p, h)) | F.exists(h["points"], lambda p: _inside(p, g))


def sf_disjoint(g: Column, h: Column) -> Column:
    return ~sf_intersects(g, h)


def _covers(g: Column, h: Column) -> Column:
    """Whether no part of h leaves g; for a polygon g, crossings of edges show as points outside or proper crossings."""
    proper = F.exists(_segments(g), lambda s: F.exists(_segments(h), lambda t: (_turn(s["a"], s["b"], t["a"]) * _turn(s["a"], s["b"], t["b"]) < 0) & (_turn(t["a"], t["b"], s["a"]) * _turn(t["a"], t["b"], s["b"]) < 0)))
    return F.forall(h["points"], lambda p: _inside(p, g) | _on_edge(p, g)) & ~proper & F.forall(_segments(h), lambda s: _middle_in(s, g))


def _middle_in(s: Column, g: Column) -> Column:
    mid = F.struct(((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y"))
    return _inside(mid, g) | _on_edge(mid, g)


def sf_contains(g: Column, h: Column) -> Column:
    """h lies in g and not on its edge alone."""
    inner = F.exists(h["points"], lambda p: _inside(p, g)) | F.exists(_segments(h), lambda s: _inside(F.struct(((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y")), g))
    return _covers(g, h) & F.when(g["kind"] == "POLYGON", inner | (h["kind"] == "POLYGON")).otherwise(True)


def sf_within(g: Column, h: Column) -> Column:
    return sf_contains(h, g)


def sf_equals(g: Column, h: Column) -> Column:
    return (g["kind"] == h["kind"]) & _covers(g, h) & _covers(h, g)


def dimension(g: Column) -> Column:
    return F.when(g["kind"] == "POINT", 0).when(g["kind"] == "LINESTRING", 1).otherwise(2).cast("long")


def is_empty(g: Column) -> Column:
    return F.size(g["points"]) == 0


def envelope(g: Column) -> Column:
    """struct<x1,y1,x2,y2>; null for an empty geometry."""
    xs, ys = F.transform(g["points"], lambda p: p["x"]), F.transform(g["points"], lambda p: p["y"])
    return F.when(F.size(g["points"]) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def great_circle(lat: Column, lon: Column, lat2: Column, lon2: Column, unit: str = "metre") -> Column:
    a, b = F.radians(lat), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * EARTH / UNITS[unit] * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def azimuth(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Forward azimuth in radians, clockwise from north, in [0, 2 pi)."""
    a, b, d = F.radians(lat), F.radians(lat2), F.radians(lon2 - lon)
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def angle(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Angle in the plane in radians, clockwise from the y axis, in [0, 2 pi)."""
    turned = F.atan2(x2 - x, y2 - y)
    return F.when(turned < 0, turned + 2 * math.pi).otherwise(turned)


def within_box(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Boxes over the date line have west > east."""
    across = F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east))
    return (lat >= south) & (lat <= north) & across


def east_of(lon: Column, from_lon: Column) -> Column:
    """Within half the globe eastwards."""
    gap = F.pmod(lon - from_lon, F.lit(360.0))
    return (gap > 0) & (gap <= 180)


def nearby(points: DataFrame, centre: tuple[float, float], radius: float, unit: str = "metre", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows within the radius, with column distance. A latitude range that the scan can push down goes first."""
    reach = math.degrees(radius * UNITS[unit] / EARTH)
    close = points.where(F.col(lat).between(centre[0] - reach, centre[0] + reach))
    rated = close.withColumn("distance", great_circle(F.col(lat), F.col(lon), F.lit(centre[0]), F.lit(centre[1]), unit))
    return rated.where(F.col("distance") <= radius)


#: Names in the query language; geometries are WKT strings there.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{name: (lambda f: lambda a, b: f(geometry(a), geometry(b)))(f) for name, f in {"sfintersects": sf_intersects, "sfdisjoint": sf_disjoint, "sfcontains": sf_contains, "sfwithin": sf_within, "sfequals": sf_equals, "ehequals": sf_equals, "rcc8eq": sf_equals, "ehdisjoint": sf_disjoint, "rcc8dc": sf_disjoint}.items()},
    "dimension": lambda a: dimension(geometry(a)), "isempty": lambda a: is_empty(geometry(a)), "convertlatlon": lambda lat, lon: F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")),
    "greatcircle": great_circle, "azimuth": azimuth, "azimuthdeg": lambda *a: F.degrees(azimuth(*a)), "angle": angle, "angledeg": lambda *a: F.degrees(angle(*a)), "withinbox": within_box,
}
