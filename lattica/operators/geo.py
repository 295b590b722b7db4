"""Geometry: distances, containment and intersection of points and polygons.

Points are [x, y] arrays, {type, coordinates} documents or {x, y} documents.
Containment and distances are plain arithmetic; polygons use ray casting over
constant vertices, and shapes stored in rows (lines, polygons) higher-order
functions over their coordinates: all of it runs as built-in functions.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Ctx, Ex, ExpressionError, path
from .rows import set_fields

EARTH = 6_378_100.0


def xy(e: Ex) -> tuple[Column, Column]:
    t, c = e.type, e.col
    if isinstance(t, T.StructType) and "coordinates" in t.fieldNames():
        c = c.getField("coordinates")
        t = t["coordinates"].dataType
    if isinstance(t, T.ArrayType):
        return F.get(c, F.lit(0)).cast("double"), F.get(c, F.lit(1)).cast("double")
    if isinstance(t, T.StructType) and len(t.fields) >= 2:
        a, b = t.fieldNames()[:2]
        return c.getField(a).cast("double"), c.getField(b).cast("double")
    return F.lit(None).cast("double"), F.lit(None).cast("double")


def central_angle(x: Column, y: Column, lon: float, lat: float) -> Column:
    """Radians between two points on a sphere (haversine)."""
    p, q = F.radians(y), F.lit(math.radians(lat))
    a = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(x - F.lit(lon)) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _point(value: Any) -> tuple[float, float, bool]:
    """(x, y, whether it is GeoJSON)."""
    if isinstance(value, dict):
        if "$geometry" in value:
            return _point(value["$geometry"])
        if "coordinates" in value:
            return float(value["coordinates"][0]), float(value["coordinates"][1]), True
        a, b = list(value.values())[:2]
        return float(a), float(b), False
    return float(value[0]), float(value[1]), False


def in_ring(x: Column, y: Column, ring: list, closed: bool = True) -> Column:
    """Ray casting; a point on an edge is inside if the ring is closed."""
    ring = [tuple(map(float, p)) for p in ring]
    if ring[0] == ring[-1]:
        ring = ring[:-1]
    odd, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        turn = (F.lit(bx - ax) * (y - F.lit(ay)) - F.lit(by - ay) * (x - F.lit(ax)))
        edge = edge | ((turn == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            odd = odd != (crosses & (x < F.lit(bx - ax) * (y - F.lit(ay)) / F.lit(by - ay) + F.lit(ax)))
    return F.coalesce(edge | odd if closed else odd & ~edge, F.lit(False))


def _in_polygon(x: Column, y: Column, rings: list) -> Column:
    out = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(x, y, hole, closed=False)
    return out


def _within(x: Column, y: Column, shape: dict[str, Any]) -> Column:
    if "$geometry" in shape:
        g = shape["$geometry"]
        if g["type"] == "Polygon":
            return _in_polygon(x, y, g["coordinates"])
        if g["type"] == "MultiPolygon":
            out = F.lit(False)
            for p in g["coordinates"]:
                out = out | _in_polygon(x, y, p)
            return out
        raise ExpressionError("$geoWithin takes a Polygon or MultiPolygon")
    ((kind, v),) = shape.items()
    if kind == "$box":
        (a, b), (c, d) = v
        return x.between(min(a, c), max(a, c)) & y.between(min(b, d), max(b, d))
    if kind == "$center":
        (a, b), r = v
        return F.pow(x - F.lit(float(a)), 2) + F.pow(y - F.lit(float(b)), 2) <= F.lit(float(r) ** 2)
    if kind == "$centerSphere":
        (a, b), r = v
        return central_angle(x, y, float(a), float(b)) <= F.lit(float(r))
    if kind == "$polygon":
        return in_ring(x, y, v)
    raise ExpressionError(f"unknown shape {kind}")


def geo_filter(e: Ex, op: str, value: Any, whole: dict[str, Any]) -> Column:
    if op == "$geoIntersects":
        return _intersects(e, value["$geometry"])
    x, y = xy(e)
    if op == "$geoWithin":
        return F.coalesce(_within(x, y, value), F.lit(False))
    d, limits = distance_to(x, y, value, op == "$nearSphere", whole)
    out = d.isNotNull()
    if limits[0] is not None:
        out = out & (d >= F.lit(float(limits[0])))
    if limits[1] is not None:
        out = out & (d <= F.lit(float(limits[1])))
    return F.coalesce(out, F.lit(False))


def distance_to(x: Column, y: Column, near: Any, sphere: bool, whole: dict[str, Any]) -> tuple[Column, tuple]:
    """(distance, (least, most)): metres from GeoJSON points, radians on a sphere or plane units else."""
    a, b, geo = _point(near)
    where = near if isinstance(near, dict) else {}
    limits = tuple(where.get(k, whole.get(k)) for k in ("$minDistance", "$maxDistance"))
    if geo:
        return central_angle(x, y, a, b) * EARTH, limits
    if sphere:
        return central_angle(x, y, a, b), limits
    return F.sqrt(F.pow(x - F.lit(a), 2) + F.pow(y - F.lit(b), 2)), limits


def near_order(df: DataFrame, spec: dict[str, Any]) -> Column | None:
    """The distance that a filter with a near condition sorts by."""
    for field, v in spec.items():
        if isinstance(v, dict):
            for op in ("$near", "$nearSphere"):
                if op in v:
                    return distance_to(*xy(path(field, Ctx(df))), v[op], op == "$nearSphere", v)[0]
    return None


def geo_near(df: DataFrame, spec: dict[str, Any], filters) -> DataFrame:
    key = spec.get("key")
    if key is None:
        key = next(f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) or isinstance(f.dataType, T.StructType) and "coordinates" in f.dataType.fieldNames())
    if spec.get("query"):
        df = df.filter(filters(spec["query"], Ctx(df)))
    e = path(key, Ctx(df))
    d, _ = distance_to(*xy(e), spec["near"], spec.get("spherical", False), {})
    values = {spec["distanceField"]: d * F.lit(float(spec.get("distanceMultiplier", 1)))}
    if spec.get("includeLocs"):
        values[spec["includeLocs"]] = e.col
    out = set_fields(df.withColumn("__d", d), values).filter("__d is not null")
    if spec.get("minDistance") is not None:
        out = out.filter(F.col("__d") >= float(spec["minDistance"]))
    if spec.get("maxDistance") is not None:
        out = out.filter(F.col("__d") <= float(spec["maxDistance"]))
    return out.orderBy("__d").drop("__d")


# shapes against shapes


def _parts(g: dict[str, Any]) -> tuple[list, list, list]:
    """(points, segments, polygons) of a constant geometry."""
    kind, c = g["type"], g.get("coordinates")
    if kind == "GeometryCollection":
        sets = [_parts(x) for x in g["geometries"]]
        return tuple([y for s in sets for y in s[i]] for i in range(3))
    if kind == "Point":
        return [c], [], []
    if kind == "MultiPoint":
        return c, [], []
    lines = {"LineString": [c], "MultiLineString": c}.get(kind)
    if lines is not None:
        return [], [(a, b) for line in lines for a, b in zip(line, line[1:], strict=False)], []
    polygons = {"Polygon": [c], "MultiPolygon": c}[kind]
    return [], [(a, b) for p in polygons for r in p for a, b in zip(r, r[1:], strict=False)], polygons


def _xy(p: Any) -> tuple[Column, Column]:
    """The two numbers of a constant or a column point."""
    if isinstance(p, Column):
        return F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double")
    return F.lit(float(p[0])), F.lit(float(p[1]))


def _turn(a: Any, b: Any, c: Any) -> Column:
    (ax, ay), (bx, by), (cx, cy) = _xy(a), _xy(b), _xy(c)
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on(a: Any, b: Any, p: Any) -> Column:
    """Whether a point lies on a segment."""
    (ax, ay), (bx, by), (x, y) = _xy(a), _xy(b), _xy(p)
    return (_turn(a, b, p) == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))


def _cross(s: tuple, t: tuple) -> Column:
    (a, b), (c, d) = s, t
    proper = ((_turn(a, b, c) > 0) != (_turn(a, b, d) > 0)) & ((_turn(c, d, a) > 0) != (_turn(c, d, b) > 0))
    return _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b) | proper


def _any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _segments(line: Column) -> Column:
    """The pairs of neighbours of an array of points."""
    pairs = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(line) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def _holds_point(ring: Column, p: Any, closed: bool) -> Column:
    """Whether a ring of a row holds a point: ray casting over its segments."""
    x, y = _xy(p)

    def crossed(odd: Column, s: Column) -> Column:
        (ax, ay), (bx, by) = _xy(s["a"]), _xy(s["b"])
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
        return odd != F.coalesce(hit, F.lit(False))

    segments = _segments(ring)
    edge = F.exists(segments, lambda s: _on(s["a"], s["b"], p))
    odd = F.aggregate(segments, F.lit(False), crossed)
    return odd | edge if closed else odd & ~edge


def _polygon_holds(rings: Column, p: Any) -> Column:
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return _holds_point(F.get(rings, F.lit(0)), p, True) & ~F.exists(holes, lambda h: _holds_point(h, p, False))


def _depth(t: T.DataType) -> int:
    return 1 + _depth(t.elementType) if isinstance(t, T.ArrayType) else 0


def _intersects(e: Ex, shape: dict[str, Any]) -> Column:
    """Built-in functions only: the constant shape's points, segments and polygons against those of each row."""
    points, segments, polygons = _parts(shape)
    names = e.type.fieldNames() if isinstance(e.type, T.StructType) else []
    c, kind = (e.col.getField("coordinates"), e.col.getField("type")) if "coordinates" in names else (e.col, None)
    depth = _depth(e.type["coordinates"].dataType) if kind is not None else 1
    corners = points + [s[0] for s in segments]

    def point(p: Any) -> Column:
        """A point of a row against the shape."""
        x, y = _xy(p)
        same = [(x == _xy(q)[0]) & (y == _xy(q)[1]) for q in points]
        return _any_of([_in_polygon(x, y, r) for r in polygons] + [_on(*s, p) for s in segments] + same)

    def line(ps: Column) -> Column:
        """A row's line against the shape."""
        own = _segments(ps)
        cross = F.exists(own, lambda s: _any_of([_cross((s["a"], s["b"]), t) for t in segments] + [_on(s["a"], s["b"], q) for q in points]))
        return cross | F.exists(ps, point)

    def polygon(rings: Column) -> Column:
        return F.exists(rings, line) | _any_of([_polygon_holds(rings, q) for q in corners])

    if depth == 0 or kind is None or depth == 1:
        x, y = xy(e)
        out = point(F.array(x, y))
    elif depth == 2:
        out = F.when(kind == "MultiPoint", F.exists(c, point)).otherwise(line(c))
    elif depth == 3:
        out = F.when(kind == "MultiLineString", F.exists(c, line)).otherwise(polygon(c))
    else:
        out = F.exists(c, polygon)
    return F.coalesce(out, F.lit(False))
