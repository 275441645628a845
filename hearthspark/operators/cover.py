"""Covers of polygons by cells of a quadtree, coarse inside and fine along the border, for joins of points with polygons.

Cells halve from 360 degrees on. A polygon's cells don't overlap; an inner cell lies in the polygon as a whole, a border
cell carries the edges that the ray of any of its points can meet (those in its band of latitudes and not to its left),
so that the test in a border cell gives what the test of the whole polygon gives. Cells without an edge are inner or
go; cells with more than ``most_edges`` edges of their own are split, down to level ``deepest``. So the number of cells
grows with the border's length in such small cells at most, and not with the area.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoints, tasks

WORLD, MOST_EDGES, DEEPEST = 360.0, 16, 22
#: A cover begins with cells of about a fourth of its polygon's width, so that few points outside meet it and keys are many.
_FINER = 2


def _edges(ring: list[dict] | None) -> np.ndarray:
    """Edges (ax, ay, bx, by) of a closed ring, each vertex with the one before it."""
    if not ring:
        return np.empty((0, 4))
    v = np.array([(p["x"], p["y"]) for p in ring], float)
    return np.concatenate([v, np.roll(v, 1, axis=0)], axis=1)


def _holds(edges: np.ndarray, x: float, y: float) -> bool:
    """Whether a ray from a point to the right meets an odd number of edges."""
    ax, ay, bx, by = edges.T
    spans = (ay > y) != (by > y)
    ax, ay, bx, by = ax[spans], ay[spans], bx[spans], by[spans]
    return bool(np.count_nonzero(x < (bx - ax) * (y - ay) / (by - ay) + ax) % 2)


def cells_of(outer: list[dict], holes: list[list[dict]] | None, *, most_edges: int = MOST_EDGES, deepest: int = DEEPEST, reach: float = 0.0) -> Iterator[tuple[int, int, int, list[np.ndarray] | None]]:
    """level, row, column of each cell, and None for inner cells or the edges of each ring that matter there.

    With ``reach``, of the polygon and all within so many degrees of it on either axis: edges matter in cells that they come
    so near to, and cells aren't split once they are as small as a square of that half side.
    """
    rings = [_edges(outer), *(_edges(h) for h in holes or ())]
    if not len(rings[0]) or not np.isfinite(rings[0]).all():
        return
    x0, y0, x1, y1 = rings[0][:, 0].min(), rings[0][:, 1].min(), rings[0][:, 0].max(), rings[0][:, 1].max()
    more = reach and reach * (1 + 1e-9) + 1e-9
    x0, y0, x1, y1 = x0 - more, y0 - more, x1 + more, y1 + more
    wide = max(x1 - x0, y1 - y0, WORLD / 2**deepest)
    level = min(deepest, max(0, int(np.floor(np.log2(WORLD / wide))) + _FINER))
    size = WORLD / 2**level
    stack = [(level, r, c, rings) for r in range(int(np.floor(y0 / size)), int(np.floor(y1 / size)) + 1) for c in range(int(np.floor(x0 / size)), int(np.floor(x1 / size)) + 1)]
    while stack:
        level, r, c, above = stack.pop()
        size = WORLD / 2**level
        left, low, right, high = c * size - more, r * size - more, (c + 1) * size + more, (r + 1) * size + more
        rings, own = [], 0
        for e in above:
            e = e[(np.minimum(e[:, 1], e[:, 3]) <= high) & (np.maximum(e[:, 1], e[:, 3]) >= low) & (np.maximum(e[:, 0], e[:, 2]) >= left)]
            rings.append(e)
            near = e[np.minimum(e[:, 0], e[:, 2]) <= right]
            own += int(np.count_nonzero(_touches(near, left, low, right, high)))
        if not own:
            x, y = (left + right) / 2, (low + high) / 2
            if _holds(rings[0], x, y) and not any(_holds(h, x, y) for h in rings[1:]):
                yield level, r, c, None
        elif own <= most_edges or level >= deepest or size <= 2 * reach:
            yield level, r, c, rings
        else:
            stack += [(level + 1, 2 * r + i, 2 * c + j, rings) for i in (0, 1) for j in (0, 1)]


def _touches(e: np.ndarray, left: float, low: float, right: float, high: float) -> np.ndarray:
    """Whether each edge, whose box meets the cell, may have a point in it: not if all corners are on one side of its line."""
    ax, ay, bx, by = e.T
    side = np.stack([(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (left, right) for y in (low, high)])
    # a little slack keeps edges that pass a corner
    slack = 1e-9 * (np.abs(bx - ax) + np.abs(by - ay)) * (right - left)
    return (side.min(axis=0) <= slack) & (side.max(axis=0) >= -slack)


_EDGE = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def covers(polygons: DataFrame, *, key: str, most_edges: int = MOST_EDGES, deepest: int = DEEPEST, reach: float = 0.0) -> DataFrame:
    """The cells of each polygon (ring, and holes if there are any): key, level, r, c, inner, outer and inner rings' edges."""
    holes = F.col("holes") if "holes" in polygons.columns else F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    edge = pa.list_(pa.struct([(n, pa.float64()) for n in ("ax", "ay", "bx", "by")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda e: [dict(zip(("ax", "ay", "bx", "by"), x, strict=True)) for x in e.tolist()]
        shape = None
        for batch in batches:
            shape = shape or pa.schema([("key", batch.schema.field(0).type), ("level", pa.int32()), ("r", pa.int64()), ("c", pa.int64()), ("inner", pa.bool_()), ("edges", edge), ("hole_edges", pa.list_(edge))])
            for k, ring, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for level, r, c, rings in cells_of(ring, inside, most_edges=most_edges, deepest=deepest, reach=reach):
                    rows.append({"key": k, "level": level, "r": r, "c": c, "inner": rings is None, "edges": None if rings is None else told(rings[0]), "hole_edges": None if rings is None else [told(h) for h in rings[1:] if len(h)]})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    kind = polygons.schema[key].dataType.simpleString()
    return polygons.select(F.col(key), F.col("ring"), holes.alias("holes")).mapInArrow(run, f"key {kind}, level int, r long, c long, inner boolean, edges {_EDGE}, hole_edges array<{_EDGE}>")


#: So many edges are tested in generated code; lambdas over longer lists are many times slower an edge.
_UNROLLED = 8


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """The ray test of a point on a list of edges."""

    def hit(e: Column) -> Column:
        spans = (e.getField("ay") > y) != (e.getField("by") > y)
        return spans & (x < (e.getField("bx") - e.getField("ax")) * (y - e.getField("ay")) / (e.getField("by") - e.getField("ay")) + e.getField("ax"))

    short = F.lit(False)
    for k in range(_UNROLLED):
        short = short != F.coalesce(hit(F.get(edges, F.lit(k))), F.lit(False))
    return F.when(F.size(edges) <= _UNROLLED, short).otherwise(F.size(F.filter(edges, hit)) % 2 == 1)


def _met(points: DataFrame, polygons: DataFrame, own: list[str], most_edges: int, deepest: int, reach: float) -> DataFrame:
    """Points (lat, lng) and the cells that they lie in: the points' columns, ``own`` of the polygons, __inner, __edges and __holes.

    An equality join on cells: a point has one cell a level that any cover uses. Points out of the ring's box (a little wider
    than it and ``reach`` are) go. Cells carry their polygon's row, so pairs aren't joined again.
    """
    spark = points.sparkSession
    shared_checkpoints(spark)
    # small files would put all covers into one task
    dealt = polygons.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    numbered = dealt.withColumn("__polygon", F.monotonically_increasing_id()).checkpoint()
    cells = covers(numbered, key="__polygon", most_edges=most_edges, deepest=deepest, reach=reach).checkpoint()
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most ``deepest`` + 1
    xs, ys, more = F.transform("ring", lambda v: v.getField("x")), F.transform("ring", lambda v: v.getField("y")), reach + 1e-9
    bounds = {"__x0": F.array_min(xs) - more, "__x1": F.array_max(xs) + more, "__y0": F.array_min(ys) - more, "__y1": F.array_max(ys) + more}
    rows = numbered.select(F.col("__polygon").alias("key"), *own, *(b.alias(n) for n, b in bounds.items()))
    full = cells.select("key", F.col("level").alias("__l"), F.col("r").alias("__row"), F.col("c").alias("__column"), F.col("inner").alias("__inner"), F.col("edges").alias("__edges"), F.col("hole_edges").alias("__holes")).join(rows.hint("merge"), "key")
    size = lambda k: F.lit(WORLD) / F.pow(F.lit(2.0), k)
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")))
    p = p.withColumn("__r", F.floor(F.col("lat") / size(F.col("__level")))).withColumn("__c", F.floor(F.col("lng") / size(F.col("__level"))))
    p = p.repartition(tasks(points), "__level", "__r", "__c")
    boxed = F.col("lng").between(F.col("__x0"), F.col("__x1")) & F.col("lat").between(F.col("__y0"), F.col("__y1"))
    return p.join(full.hint("merge"), (F.col("__level") == F.col("__l")) & (F.col("__r") == F.col("__row")) & (F.col("__c") == F.col("__column")) & boxed)


def points_in(points: DataFrame, polygons: DataFrame, *, most_edges: int = MOST_EDGES, deepest: int = DEEPEST) -> DataFrame:
    """Every pair of a point (lat, lng) and a polygon (ring, and holes if there are any) that holds it, with both rows' columns.

    Points in inner cells need no test.
    """
    own = [c for c in polygons.columns if c not in points.columns]
    met = _met(points, polygons, own, most_edges, deepest, 0.0)
    held = F.col("__inner") | (_odd(F.col("__edges"), F.col("lng"), F.col("lat")) & ((F.size("__holes") == 0) | ~F.exists("__holes", lambda h: _odd(h, F.col("lng"), F.col("lat")))))
    return met.filter(held).select(*points.columns, *own)


def _crosses(edges: Column, box: Column) -> Column:
    """Whether an edge of a list has a point in a box: each edge is clipped to the box's two ranges."""

    def clipped(a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        """The part of an edge (0 to 1) whose coordinate is in [lo, hi]; an empty one where none is."""
        step = b - a
        t0, t1 = (lo - a) / F.nullif(step, F.lit(0.0)), (hi - a) / F.nullif(step, F.lit(0.0))
        flat = F.when(a.between(lo, hi), 0.0).otherwise(2.0)
        return F.when(step == 0, flat).otherwise(F.least(t0, t1)), F.when(step == 0, 1.0).otherwise(F.greatest(t0, t1))

    def hit(e: Column) -> Column:
        x0, x1 = clipped(e.getField("bx"), e.getField("ax"), box.getField("lng0"), box.getField("lng1"))
        y0, y1 = clipped(e.getField("by"), e.getField("ay"), box.getField("lat0"), box.getField("lat1"))
        return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))

    short = F.lit(False)
    for k in range(_UNROLLED):
        short = short | ((F.size(edges) > k) & hit(F.get(edges, F.lit(k))))
    return F.when(F.size(edges) <= _UNROLLED, short).otherwise(F.exists(edges, hit))


def squares_in(points: DataFrame, polygons: DataFrame, reach: float, *, most_edges: int = MOST_EDGES, deepest: int = DEEPEST) -> DataFrame:
    """Every pair of a point (lat, lng, and a ``box`` of at most ``reach`` degrees on each side of it) and a polygon's outer ring that meets the box, with both rows' columns but the ring.

    All points of an inner cell, and all that is within ``reach`` of them, lie in the polygon; so only boxes near the border are tested.
    """
    own = [c for c in polygons.columns if c not in (*points.columns, "ring", "holes")]
    met = _met(points, polygons.select(*own, "ring"), own, most_edges, deepest, reach)
    edges, box = F.col("__edges"), F.col("box")
    return met.filter(F.col("__inner") | _odd(edges, box.getField("lng0"), box.getField("lat0")) | _crosses(edges, box)).select(*points.columns, *own)
