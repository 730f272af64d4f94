"""Rounding and texts of doubles against Python's own; overlay of polygons against sampled points."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import geometry as G
from vigilspark.functions import numbers


def doubles(n, seed):
    rng = random.Random(seed)
    out = [0.0, -0.0, 1.0, -1.5, 2.5, 0.1, 2.675, 1.005, 0.5, 1e16, 1e15, 9999999999999998.0, 123456789012345680.0, 1e-4, 1e-5, 0.00012345, 5e-324, 1.7976931348623157e308, 2e23, 4.8726570057e288, 1e22, 1e23, float("inf"), float("-inf"), 4503599627370496.5]
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        elif kind == 1:
            x = rng.uniform(-1000, 1000)
        elif kind == 2:
            x = round(rng.uniform(-100, 100), rng.randrange(8))
        else:
            x = (2 * rng.randrange(10**6) + 1) / 2 / 10 ** rng.randrange(7)  # ties, or next to them
        if not math.isnan(x):
            out.append(x)
    return out


def test_shortest_text_is_python_repr(spark):
    xs = doubles(100_000, 1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").repartition(8)
    wrong = [(xs[r.i], r.s) for r in df.select("i", numbers.shortest(F.col("x")).alias("s")).collect() if r.s != repr(xs[r.i])]
    assert not wrong, (len(wrong), wrong[:10])
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(numbers.shortest(F.col("x")).alias("s")).collect() == [(None,), ("nan",)]


def test_shortest_text_of_powers_of_two(spark):
    """Below them doubles lie closer than above, so the fewest digits need not be the nearest ones."""
    xs = [2.0**k for k in range(-1074, 1024)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    assert [r.s for r in df.select("i", numbers.shortest(F.col("x")).alias("s")).orderBy("i").collect()] == [repr(x) for x in xs]


@pytest.mark.parametrize("places", [0, 1, 3, 6, 12])
def test_rounding_is_python_round(spark, places):
    xs = [x for x in doubles(100_000, 2) if abs(x) * 10**places < 1 << 51]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").repartition(8)
    got = {r.i: r.y for r in df.select("i", numbers.round_half_even(F.col("x"), places).alias("y")).collect()}
    wrong = [(x, got[i], round(x, places)) for i, x in enumerate(xs) if got[i] != round(x, places)]
    assert not wrong, (len(wrong), wrong[:10])


def test_overlay_of_random_stars(spark):
    """Star-shaped polygons of both windings, against the share of grid points in both."""
    rng = random.Random(3)

    def star(cx, cy):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(5, 9)))
        ring = [(cx + (r := rng.uniform(0.3, 1)) * math.cos(a), cy + r * math.sin(a)) for a in angles]
        ring = ring if max((b - a) % (2 * math.pi) for a, b in zip(angles, [*angles[1:], angles[0]], strict=True)) < math.pi else [(cx - 1.0, cy - 1.0), (cx + 1.0, cy - 1.0), (cx + 0.0, cy + 1.0)]
        ring.append(ring[0])
        return ring[::-1] if rng.random() < 0.5 else ring

    def inside(x, y, ring):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)) % 2 == 1

    pairs = [(star(0, 0), star(rng.uniform(-1, 1), rng.uniform(-1, 1))) for _ in range(25)]
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {ring}, b {ring}")
    got = {r.i: (r.ab, r.ba, r.aa, r.area) for r in df.select("i", G.overlay_area(F.col("a"), F.col("b")).alias("ab"), G.overlay_area(F.col("b"), F.col("a")).alias("ba"), G.overlay_area(F.col("a"), F.col("a")).alias("aa"), G.area(F.col("a")).alias("area")).collect()}
    step = 0.02
    grid = [(-1 + step * (i + 0.5), -1 + step * (j + 0.5)) for i in range(int(2 / step)) for j in range(int(2 / step))]
    for i, (a, b) in enumerate(pairs):
        want = step * step * sum(inside(x, y, a) and inside(x, y, b) for x, y in grid)
        ab, ba, aa, own = got[i]
        assert abs(ab - want) < 0.05 and abs(ab - ba) < 1e-9 and abs(aa - own) < 1e-9
