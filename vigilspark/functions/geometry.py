"""Geometry kernel over ARRAY<STRUCT<x, y>> rings and lines, as Column expressions.

Not-a-number ranks above all numbers in Spark; every predicate here is false for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions.numbers import round_half_even

TOLERANCE = 1e-9
AREA_TOLERANCE = 1e-6


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def ring_of(points: list[tuple[float, float]]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))
    return out


def edges(ring: Column) -> Column:
    """Consecutive pairs (a, b)."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to the nearest point of the segment; to a where it has no length."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def signed_side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def side_of_line(a: Column, b: Column, p: Column) -> Column:
    """left, right, or on_line within the tolerance from the line."""
    length = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    cross = signed_side(a, b, p)
    return F.when(F.abs(cross) <= TOLERANCE * F.greatest(length, F.lit(TOLERANCE)), "on_line").when(cross > 0, "left").otherwise("right")


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def is_degenerate(ring: Column) -> Column:
    return area(ring) <= TOLERANCE


def on_boundary(p: Column, ring: Column, tolerance: float = TOLERANCE) -> Column:
    return F.exists(edges(ring), lambda e: segment_distance(p, e["a"], e["b"]) <= tolerance)


def ray_inside(p: Column, ring: Column) -> Column:
    """Half-open ray cast to the right."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < x)

    return F.aggregate(edges(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def classify_point(p: Column, ring: Column) -> Column:
    """boundary, inside or outside; the boundary is asked first."""
    return F.when(on_boundary(p, ring), "boundary").when(ray_inside(p, ring), "inside").otherwise("outside")


def point_in_ring(p: Column, ring: Column) -> Column:
    """For configuration checks: the boundary counts as inside."""
    return on_boundary(p, ring) | ray_inside(p, ring)


def clip_area(subject: Column, clip: Column) -> Column:
    """Area of subject within clip by clipping at each edge; right for convex counter-clockwise clips, 0 for clockwise ones."""
    zero = F.lit(0.0)

    def cut(points: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        ring = F.concat(F.slice(points, F.size(points), F.least(F.size(points), F.lit(1))), points)  # each point after the one before it

        def part(pair: Column) -> Column:
            s, t = pair["a"], pair["b"]
            ss, st = s["side"], t["side"]
            r = ss / F.nullif(ss - st, zero)
            meet = F.struct((s["x"] + r * (t["x"] - s["x"])).alias("x"), (s["y"] + r * (t["y"] - s["y"])).alias("y"))
            own = F.struct(t["x"].alias("x"), t["y"].alias("y"))
            none = F.slice(F.array(own), 1, 0)
            return F.when((ss >= 0) & (st >= 0), F.array(own)).when((ss < 0) & (st >= 0), F.array(meet, own)).when((ss >= 0) & (st < 0), F.array(meet)).otherwise(none)

        sided = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), signed_side(a, b, p).alias("side")))
        return F.when(F.size(points) == 0, points).otherwise(F.flatten(F.transform(edges(sided), part)))

    start = F.slice(subject, 1, F.size(subject) - 1)
    left = F.aggregate(edges(clip), F.transform(start, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), cut)
    return F.when(F.size(left) < 3, zero).otherwise(area(F.concat(left, F.slice(left, 1, 1))))


def contains(outer: Column, inner: Column) -> Column:
    return F.forall(inner, lambda p: point_in_ring(p, outer))


def touches(a: Column, b: Column) -> Column:
    return F.exists(a, lambda p: on_boundary(p, b)) | F.exists(b, lambda p: on_boundary(p, a))


def meaningful_overlap(a: Column, b: Column) -> Column:
    return clip_area(a, b) > AREA_TOLERANCE


def self_intersecting(ring: Column) -> Column:
    """Whether two edges that are not neighbours cross properly."""
    e = F.transform(edges(ring), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("i")))
    last = F.size(ring) - 2

    def crosses(s: Column, t: Column) -> Column:
        d = [signed_side(s["a"], s["b"], t["a"]), signed_side(s["a"], s["b"], t["b"]), signed_side(t["a"], t["b"], s["a"]), signed_side(t["a"], t["b"], s["b"])]
        apart = (t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == last))
        return apart & (d[0] * d[1] < 0) & (d[2] * d[3] < 0)

    return F.exists(e, lambda s: F.exists(e, lambda t: crosses(s, t)))


def is_closed(ring: Column, tolerance: float = AREA_TOLERANCE) -> Column:
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return (F.abs(first["x"] - last["x"]) <= tolerance) & (F.abs(first["y"] - last["y"]) <= tolerance)


def valid_ring(ring: Column) -> Column:
    """At least four finite coordinates, three of them distinct, and some area."""
    all_finite = F.forall(ring, lambda p: finite(p["x"], p["y"]))
    keys = F.array_distinct(F.transform(ring, lambda p: F.struct(F.round(p["x"] / TOLERANCE).alias("x"), F.round(p["y"] / TOLERANCE).alias("y"))))
    return F.coalesce((F.size(ring) >= 4) & all_finite & (F.size(keys) >= 3) & ~is_degenerate(ring), F.lit(False))


def valid_polygon(ring: Column) -> Column:
    return valid_ring(ring) & is_closed(ring) & ~self_intersecting(ring)


def valid_line(line: Column) -> Column:
    return F.coalesce((F.size(line) >= 2) & F.forall(line, lambda p: finite(p["x"], p["y"])), F.lit(False))


def valid_coordinate(x: Column, y: Column, space: Column) -> Column:
    """Finite; image coordinates lie in the unit square."""
    unit = x.between(0.0, 1.0) & y.between(0.0, 1.0)
    return finite(x, y) & ((space != "image_normalized") | unit)


def valid_box(box: Column) -> Column:
    c = [box[n] for n in ("x_min", "y_min", "x_max", "y_max")]
    inside = F.lit(True)
    for v in c:
        inside = inside & v.between(0.0, 1.0)
    return F.coalesce(finite(*c) & inside & (c[0] < c[2]) & (c[1] < c[3]), F.lit(False))


def box_point(box: Column, policy: Column) -> Column:
    """Centre, or the middle of the lower edge for the policy footpoint."""
    return F.struct(((box["x_min"] + box["x_max"]) / 2).alias("x"), F.when(policy == "footpoint", box["y_max"]).otherwise((box["y_min"] + box["y_max"]) / 2).alias("y"))


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    h = F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))
    size = lambda c: (c["x_max"] - c["x_min"]) * (c["y_max"] - c["y_min"])
    both = w * h
    union = size(a) + size(b) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def snap(v: Column, noise: float = 1e-6) -> Column:
    """A coordinate up to `noise` outside of [0, 1] moves to its edge; one beyond, or not finite, is null."""
    return F.when(finite(v) & (v >= -noise) & (v <= 1 + noise), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def normalize_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Pixels as shares of the frame; null where a corner lies outside or the box has no area."""
    c = [snap(v / F.nullif(size, F.lit(0))) for v, size in ((x1, width), (y1, height), (x2, width), (y2, height))]
    good = (c[0] < c[2]) & (c[1] < c[3])
    return F.when(good, F.struct(*(v.alias(n) for v, n in zip(c, ("x_min", "y_min", "x_max", "y_max"), strict=True))))


def canonical_ring(ring: Column, space: Column) -> Column:
    """A ring with rounded coordinates (6 places in images, 3 in venues), closed by its first point unless it is within the tolerance."""
    image = space == "image_normalized"
    place = lambda v: F.when(image, round_half_even(v, 6)).otherwise(round_half_even(v, 3))
    out = F.transform(ring, lambda p: F.struct(place(p["x"]).alias("x"), place(p["y"]).alias("y")))
    return F.get(F.transform(F.array(out), lambda r: F.when((F.size(r) == 0) | is_closed(r), r).otherwise(F.concat(r, F.slice(r, 1, 1)))), F.lit(0))


def triangles(ring: Column) -> Column:
    """The triangles of a ring's edges with its first point, counter-clockwise, each with the sign of its winding.

    Their signed sum is the polygon whatever its shape: what lies outside of a concave one cancels out.
    """
    first = F.get(ring, F.lit(0))

    def one(e: Column) -> Column:
        turn = signed_side(first, e["a"], e["b"])
        corner = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
        second, third = F.when(turn > 0, corner(e["a"])).otherwise(corner(e["b"])), F.when(turn > 0, corner(e["b"])).otherwise(corner(e["a"]))
        return F.struct(F.array(corner(first), second, third, corner(first)).alias("ring"), F.signum(turn).alias("sign"))

    return F.filter(F.transform(edges(ring), one), lambda t: t["sign"] != 0)


def overlay_area(a: Column, b: Column) -> Column:
    """Area of the intersection of two simple polygons, concave ones and either winding included."""

    def apart(s: Column, t: Column) -> Column:
        lows, highs = (lambda r, c: F.array_min(F.transform(r, lambda p: p[c]))), (lambda r, c: F.array_max(F.transform(r, lambda p: p[c])))
        return (highs(s, "x") <= lows(t, "x")) | (highs(t, "x") <= lows(s, "x")) | (highs(s, "y") <= lows(t, "y")) | (highs(t, "y") <= lows(s, "y"))

    def of(both: Column) -> Column:  # each polygon's triangles are made once
        def pair(total: Column, t: Column) -> Column:
            return F.aggregate(both["b"], total, lambda u, v: u + F.when(apart(t["ring"], v["ring"]), 0.0).otherwise(t["sign"] * v["sign"] * clip_area(t["ring"], v["ring"])))

        return F.aggregate(both["a"], F.lit(0.0), pair)

    turned = F.signum(signed_area(a)) * F.signum(signed_area(b))
    area_ = F.get(F.transform(F.array(F.struct(triangles(a).alias("a"), triangles(b).alias("b"))), of), F.lit(0))
    return F.greatest(area_ * turned, F.lit(0.0))


def overlay_contains(outer: Column, inner: Column, overlap: Column | None = None) -> Column:
    """Whether no part of inner lies outside of outer; common boundaries do not matter. overlap: their overlay_area where it is known."""
    return (area(inner) > AREA_TOLERANCE) & ((overlay_area(outer, inner) if overlap is None else overlap) >= area(inner) - AREA_TOLERANCE)


def overlay_touches(a: Column, b: Column, overlap: Column | None = None) -> Column:
    """Whether only the boundaries of two polygons meet."""
    return touches(a, b) & ((overlay_area(a, b) if overlap is None else overlap) <= AREA_TOLERANCE)


def overlay_valid(ring: Column) -> Column:
    """Closed, without crossing edges, and with an area beyond the tolerance."""
    return valid_polygon(ring) & (area(ring) > AREA_TOLERANCE)
