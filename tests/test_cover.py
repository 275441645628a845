"""Quadtree covers of polygons against the plain ray test."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from hearthspark.operators import cover, geo


def star(rng, x, y, size, n):
    """A ring around a point with ``n`` vertices at changing distances."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [{"x": x + size * (d := rng.uniform(0.3, 1)) * math.cos(a), "y": y + size * d * math.sin(a)} for a in turns]


def holds(ring, x, y):
    odd = False
    for a, b in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
            odd = not odd
    return odd


SHAPE = "struct<x:double,y:double>"


def test_points_in_polygons_equal_the_ray_test(spark):
    rng = random.Random(3)
    polygons = []
    for k in range(12):
        x, y, size = rng.uniform(-3, 3), rng.uniform(50, 55), 10 ** rng.uniform(-3, 0.5)
        holes = [star(rng, x, y, size * 0.2, 9)] if k % 2 else None
        polygons.append((k, star(rng, x, y, size, rng.choice([3, 8, 200])), holes))
    polygons.append((90, [{"x": 0.0, "y": 45.0}, {"x": 0.0, "y": 56.25}, {"x": 5.625, "y": 56.25}, {"x": 5.625, "y": 45.0}], [[{"x": 1.0, "y": 50.0}, {"x": 1.0, "y": 51.0}, {"x": 2.0, "y": 51.0}, {"x": 2.0, "y": 50.0}]] * 2))  # along the grid
    polygons += [(91, None, None), (92, [], None), (93, [{"x": 1.0, "y": 51.0}], None)]
    points = [(k, rng.uniform(49, 56), rng.uniform(-4, 6)) for k in range(1500)] + [(5000 + k, rng.choice([45.0, 50.0, 51.0, 56.25, 52.0]), rng.choice([0.0, 1.0, 2.0, 5.625, 3.0])) for k in range(60)] + [(9000, None, 1.0), (9001, 50.0, None)]
    p = spark.createDataFrame(points, "point_id int, lat double, lng double")
    z = spark.createDataFrame(polygons, f"name int, ring array<{SHAPE}>, holes array<array<{SHAPE}>>")
    want = {(i, n) for i, lat, lng in points for n, ring, holes in polygons if lat is not None and lng is not None and ring and holds(ring, lng, lat) and not any(holds(h, lng, lat) for h in holes or ())}
    for most in (1, 16):
        got = [(r["point_id"], r["name"]) for r in cover.points_in(p, z, most_edges=most, deepest=14).collect()]
        assert set(got) == want and len(got) == len(want) > 300
    assert {(r["point_id"], r["name"]) for r in geo.contains(p, z).filter("ring is not null").collect()} == want
    assert geo.contains(p, z.limit(0)).count() == 0 and geo.contains(p.limit(0), z).count() == 0


def test_a_country_has_a_bounded_number_of_cells():
    rng = random.Random(8)
    n = 20_000
    ring = [{"x": 8 * math.cos(a) * (r := 1 + 0.2 * math.sin(9 * a) + 0.002 * rng.random()), "y": 50 + 6 * math.sin(a) * r} for a in np.linspace(0, 2 * math.pi, n, endpoint=False)]
    cells = list(cover.cells_of(ring, None))
    inner = [c for c in cells if c[3] is None]
    assert len(cells) < n  # 0.1 degree cells of its box alone would be 240 * 144 = 34,560, each with all 20,000 vertices
    area = lambda some: sum((360 / 2**c[0]) ** 2 for c in some)
    x, y = np.array([v["x"] for v in ring]), np.array([v["y"] for v in ring])
    whole = abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2
    assert 0.94 * whole < area(inner) < whole  # nearly all points need no test
    assert sum(len(c[3][0]) for c in cells if c[3]) < 40 * n
    seen = {c[:3] for c in cells}
    assert len(seen) == len(cells) and not any((c[0] - k, c[1] >> k, c[2] >> k) in seen for c in cells for k in range(1, c[0]))


def test_covers_split_by_edges(spark):
    ring = [{"x": float(k % 7), "y": 50 + k / 50} for k in range(40)]
    df = spark.createDataFrame([(1, ring)], f"k int, ring array<{SHAPE}>")
    few, many = (cover.covers(df, key="k", most_edges=m, deepest=12).agg(F.count("*"), F.max(F.size("edges"))).first() for m in (4, 100))
    assert few[0] > many[0]
