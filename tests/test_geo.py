"""Geometry against a row-by-row version."""

import random

import pytest

from lattica import api
from lattica.operators.geo import _parts


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(s, t) -> bool:
    (a, b), (c, d) = s, t
    if _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b):
        return True
    return (_turn(a, b, c) > 0) != (_turn(a, b, d) > 0) and (_turn(c, d, a) > 0) != (_turn(c, d, b) > 0)


def _inside(p, rings) -> bool:
    def ring(r) -> bool:
        odd = False
        for a, b in zip(r, r[1:], strict=False):
            if _on(a, b, p):
                return True
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    def edge(r) -> bool:
        return any(_on(a, b, p) for a, b in zip(r, r[1:], strict=False))

    return ring(rings[0]) and not any(ring(h) and not edge(h) for h in rings[1:])


def intersect(g: dict, h: dict) -> bool:
    (p1, s1, a1), (p2, s2, a2) = _parts(g), _parts(h)
    if any(_cross(s, t) for s in s1 for t in s2):
        return True
    ends1 = p1 + [s[0] for s in s1]
    ends2 = p2 + [s[0] for s in s2]
    if any(_inside(p, a) for p in ends1 for a in a2) or any(_inside(p, a) for p in ends2 for a in a1):
        return True
    if any(_on(*s, p) for s in s2 for p in p1) or any(_on(*s, p) for s in s1 for p in p2):
        return True
    return any(list(p) == list(q) for p in p1 for q in p2)


def _ring(rng, x, y, n):
    pts = [[x + rng.randint(0, n), y + rng.randint(0, n)] for _ in range(2)]
    (a, b), (c, d) = pts
    c, d = max(c, a + 1), max(d, b + 1)
    return [[float(p) for p in q] for q in ([a, b], [c, b], [c, d], [a, d], [a, b])]


def _shape(rng, kind):
    p = lambda: [float(rng.randint(0, 8)), float(rng.randint(0, 8))]
    if kind == "Point":
        return p()
    if kind in ("LineString", "MultiPoint"):
        return [p() for _ in range(rng.randint(2, 4))]
    if kind == "MultiLineString":
        return [[p() for _ in range(rng.randint(2, 3))] for _ in range(2)]
    x, y = rng.randint(0, 4), rng.randint(0, 4)
    polygon = lambda: [_ring(rng, x, y, 6), *([_ring(rng, x + 1, y + 1, 2)] if rng.random() < 0.5 else [])]
    return polygon() if kind == "Polygon" else [polygon(), polygon()]


_DEPTH = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


@pytest.mark.parametrize("kinds", [("Point",), ("LineString", "MultiPoint"), ("Polygon", "MultiLineString"), ("MultiPolygon",)])
def test_intersects_equals_brute_force(spark, kinds):
    rng = random.Random(len(kinds[0]))
    docs = [(i, (kinds[i % len(kinds)], _shape(rng, kinds[i % len(kinds)]))) for i in range(150)]
    df = spark.createDataFrame(docs, f"_id int, g struct<type:string,coordinates:{_DEPTH[kinds[0]]}>")
    for kind in ("Point", "MultiLineString", "Polygon") if len(kinds) == 1 else ("LineString", "MultiPolygon"):
        shape = {"type": kind, "coordinates": _shape(rng, kind)}
        want = [i for i, (k, c) in docs if intersect({"type": k, "coordinates": c}, shape)]
        assert sorted(r["_id"] for r in api.find(df, {"g": {"$geoIntersects": {"$geometry": shape}}}).collect()) == want, (kinds, shape)
