"""Polygons (arrays of x, y) as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.once import once

#: Context in pixels around a clip, and around an estimate; tolerances in degrees.
CLIP_PADDING, ESTIMATE_PADDING = 20, 12
AXIS_TOLERANCE, UPRIGHT_TOLERANCE, FLAT = 0.01, 5.0, 1e-6


def polygon(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def xs(p: Column) -> Column:
    return F.transform(p, lambda v: v["x"])


def ys(p: Column) -> Column:
    return F.transform(p, lambda v: v["y"])


def _box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    box = F.struct(*(c.cast("int").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))
    return F.when((left < right) & (top < bottom), box)


def clipped_bounds(p: Column, width: Column, height: Column) -> Column:
    """Whole-pixel bounds inside an image; null where nothing is left."""
    return _box(F.greatest(F.lit(0), F.floor(F.array_min(xs(p)))), F.greatest(F.lit(0), F.floor(F.array_min(ys(p)))), F.least(width, F.ceil(F.array_max(xs(p)))), F.least(height, F.ceil(F.array_max(ys(p)))))


def clip_bounds(p: Column, width: Column, height: Column, padding: int = CLIP_PADDING) -> Column:
    """Clipped bounds and context around them."""
    b = clipped_bounds(p, width, height)
    padded = _box(F.greatest(F.lit(0), b["left"] - padding), F.greatest(F.lit(0), b["top"] - padding), F.least(width, b["right"] + padding), F.least(height, b["bottom"] + padding))
    return F.when(b.isNotNull(), padded)


def estimate_bounds(p: Column, width: Column, height: Column, padding: int = ESTIMATE_PADDING) -> Column:
    """Bounds of the pixels that a colour estimate looks at: one more on the right and below."""
    return _box(F.greatest(F.lit(0), F.floor(F.array_min(xs(p))) - padding), F.greatest(F.lit(0), F.floor(F.array_min(ys(p))) - padding), F.least(width, F.ceil(F.array_max(xs(p))) + padding + 1), F.least(height, F.ceil(F.array_max(ys(p))) + padding + 1))


def translated(p: Column, left: Column, top: Column) -> Column:
    return F.transform(p, lambda v: F.struct((v["x"] - left).alias("x"), (v["y"] - top).alias("y")))


def _with_next(p: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the one after it; after the last comes the first."""
    return once(p, lambda q: F.transform(q, lambda a, k: f(a, F.get(q, (k + 1) % F.size(q)))))


def longest_edge(p: Column) -> Column:
    """length, dx and dy of the longest edge; of several, the first."""
    edges = _with_next(p, lambda a, b: F.struct(F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("length"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    ranked = F.transform(edges, lambda e, k: F.struct(e["length"].alias("length"), (-k).alias("first"), e["dx"].alias("dx"), e["dy"].alias("dy")))
    return F.array_max(ranked)


def readable_angle(degrees: Column) -> Column:
    """The angle in [-90, 90) of the same line."""
    return F.pmod(degrees + 90.0, F.lit(180.0)) - 90.0


def baseline_angle(p: Column) -> Column:
    return once(longest_edge(p), lambda edge: F.when(edge["length"] > 0, readable_angle(F.degrees(F.atan2(edge["dy"], edge["dx"])))))


def local(p: Column, angle: Column) -> Column:
    """The polygon in a frame turned by an angle in degrees."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.transform(p, lambda v: F.struct((v["x"] * c + v["y"] * s).alias("x"), (v["y"] * c - v["x"] * s).alias("y")))


def frame(p: Column, angle: Column) -> Column:
    def bounds(q: Column) -> Column:
        return F.struct(F.array_min(xs(q)).alias("min_x"), F.array_max(xs(q)).alias("max_x"), F.array_min(ys(q)).alias("min_y"), F.array_max(ys(q)).alias("max_y"))

    return once(once(local(p, angle), bounds), lambda b: F.when((b["max_x"] > b["min_x"]) & (b["max_y"] > b["min_y"]), b))


def is_axis_aligned(angle: Column, tolerance: float = AXIS_TOLERANCE) -> Column:
    return F.abs(angle - F.bround(angle / 90.0) * 90.0) <= tolerance


def _one_sign(crosses: Column, empty: bool) -> Column:
    """Whether all that are not flat have one sign. empty: what holds where none is left."""

    def of(c: Column) -> Column:
        above, below = F.coalesce(F.array_max(c) > FLAT, F.lit(False)), F.coalesce(F.array_min(c) < -FLAT, F.lit(False))
        return F.when(c.isNotNull(), ~(above & below) if empty else above != below)

    return once(crosses, of)


def is_convex(p: Column) -> Column:
    """All turns go the same way; at least one is a turn."""
    edges = _with_next(p, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    return _one_sign(_with_next(edges, lambda a, b: a["x"] * b["y"] - a["y"] * b["x"]), empty=False)


def holds_point(p: Column, x: Column, y: Column) -> Column:
    """Whether a convex polygon holds a point; its edges count as inside."""
    return _one_sign(_with_next(p, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])), empty=True)


def holds_rectangle(p: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return holds_point(p, left, top) & holds_point(p, right, top) & holds_point(p, right, bottom) & holds_point(p, left, bottom)


def offsets(low: Column, high: Column) -> Column:
    """Whole numbers from low to high, nearest to 0 first, of equals the smaller first."""
    return F.transform(F.array_sort(F.transform(F.sequence(low, high), lambda v: F.struct(F.abs(v).alias("a"), v.alias("v")))), lambda s: s["v"])


def is_vertical(direction: Column) -> Column:
    return F.coalesce(direction.isin("vert", "vert270", "eaVert", "wordArtVert", "wordArtVertRtl"), F.lit(False))


def text_rotation(shape_rotation: Column, direction: Column) -> Column:
    turn = F.when(direction == "vert270", 270.0).when(is_vertical(direction), 90.0).otherwise(0.0)
    return F.pmod(shape_rotation + turn, F.lit(360.0))
