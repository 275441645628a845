"""Squares that meet polygons: covers that reach as far as the squares, places and rings tested once."""

import math
import random

from pyspark.sql import functions as F

from hearthspark.operators import cover, geo, hazards

RING = "array<struct<x:double,y:double>>"


def _inside(x, y, ring):
    n = len(ring)
    return sum((ring[i][1] > y) != (ring[i - 1][1] > y) and x < (ring[i - 1][0] - ring[i][0]) * (y - ring[i][1]) / (ring[i - 1][1] - ring[i][1]) + ring[i][0] for i in range(n)) % 2 == 1


def _cross(a, b, c, d):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def _meets(x, y, h, ring):
    corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    return _inside(*corners[0], ring) or any(abs(v[0] - x) <= h and abs(v[1] - y) <= h for v in ring) or any(_cross(ring[i - 1], ring[i], corners[k - 1], corners[k]) for i in range(len(ring)) for k in range(4))


def _shapes(draw):
    """Stars of many sizes with up to 40 vertices, as rings in lng and lat."""
    out = []
    for _ in range(60):
        x, y, size, n = draw.uniform(-1, 1), draw.uniform(50, 51), 10 ** draw.uniform(-3, 0), draw.choice([3, 4, 12, 40])
        out.append([(x + size * draw.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * draw.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    return out


def test_squares_meet_polygons_as_by_hand(spark):
    draw = random.Random(8)
    rings = _shapes(draw)
    spots = [(k, draw.uniform(49.8, 51.2), draw.uniform(-1.2, 1.2)) for k in range(150)]
    points = spark.createDataFrame([*spots, (999, None, 1.0)], "point_id int, lat double, lng double")
    areas = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)] + [(777, None), (778, [])], f"area int, ring {RING}")
    for half in (0.0003, 0.05, 1.5):
        found = [tuple(r) for r in geo.meets(points, areas, half).select("point_id", "area").collect()]
        assert len(found) == len(set(found)) and set(found) == {(p, k) for p, y, x in spots for k, r in enumerate(rings) if _meets(x, y, half, r)}, half
    # sides that differ by point, from tiny to wider than all polygons
    own = {k: 10.0 ** (k % 5 - 3) for k, _, _ in spots}
    half = F.pow(F.lit(10.0), (F.col("point_id") % 5 - 3).cast("double"))
    found = {tuple(r) for r in geo.meets(points.filter("point_id < 999"), areas, half).select("point_id", "area").collect()}
    assert found == {(p, k) for p, y, x in spots for k, r in enumerate(rings) if _meets(x, y, own[p], r)}
    assert geo.meets(points.limit(0), areas, half).count() == 0


def test_covers_of_wide_squares_are_small():
    tiny = [{"x": x, "y": y} for x, y in ((0.0, 50.0), (1e-4, 50.0), (1e-4, 50.0001), (0.0, 50.0001))]
    assert len(list(cover.cells_of(tiny, None, reach=0.5))) <= 100
    long = [{"x": k / 1000, "y": 50 + (k % 2) / 1e4} for k in range(200)] + [{"x": 0.1, "y": 50.5}]
    assert len(list(cover.cells_of(long, None, reach=0.01))) <= 20_000


def test_places_and_rings_are_tested_once_and_lists_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(geo, "_LISTED", 7)
    seen, plain = [], geo.meets
    monkeypatch.setattr(geo, "meets", lambda p, a, half: seen.append((p.count(), a.count())) or plain(p, a, half))
    square = [{"x": x, "y": y} for x, y in ((0.1, 50.1), (1.1, 50.1), (1.1, 51.1), (0.1, 51.1))]
    points = spark.createDataFrame([(k, 50.0 + k % 4 / 10, 0.5) for k in range(60)] + [(99, None, 0.5)], "point_id int, lat double, lng double")
    areas = spark.createDataFrame([(k, {"NAME": f"n{k}"} if k % 2 else {"NAME": "", "REF": f"r{k}"}, square) for k in range(10)], f"kind int, properties map<string,string>, ring {RING}")
    found = sorted(tuple(r) for r in hazards.designations(points, areas, ("NAME", "REF")).collect())
    assert found == sorted((p, k, f"n{k}" if k % 2 else f"r{k}") for p in range(60) if p % 4 for k in range(10))
    assert seen == [(4 * 3, 2)]  # 15 points a place in lists of 7, 10 areas of one ring
