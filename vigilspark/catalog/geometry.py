"""Queries: geometry kernel, boxes, spatial joins, line crossings, configuration validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import EVENTS, events, query, table
from vigilspark.functions import geometry as G
from vigilspark.operators import configuration, spatial

#: Rings of the examples, closed.
SQUARE = [(0.15, 0.15), (0.55, 0.15), (0.55, 0.55), (0.15, 0.55), (0.15, 0.15)]
ELL = [(0.4, 0.4), (0.95, 0.4), (0.95, 0.6), (0.6, 0.6), (0.6, 0.95), (0.4, 0.95), (0.4, 0.4)]
TRIANGLE = [(0.6, 0.05), (0.95, 0.05), (0.775, 0.35), (0.6, 0.05)]
TABLE = [(0.2, 0.2), (0.31, 0.2), (0.31, 0.31), (0.2, 0.31), (0.2, 0.2)]
BENCH = [(0.7, 0.42), (0.85, 0.42), (0.85, 0.55), (0.7, 0.55), (0.7, 0.42)]
PRIVATE = [(0.5, 0.5), (0.58, 0.5), (0.58, 0.58), (0.5, 0.58), (0.5, 0.5)]
CLOSED = [(0.0, 0.7), (0.3, 0.7), (0.3, 0.9), (0.0, 0.9), (0.0, 0.7)]
ZONES = {"zone-a": SQUARE, "zone-b": ELL, "zone-c": TRIANGLE}


def _edge_rows(rings: dict) -> str:
    return ", ".join(f"('{n}', {ax}, {ay}, {bx}, {by})" for n, r in rings.items() for (ax, ay), (bx, by) in zip(r, r[1:], strict=False))


def _place_sql(rings: dict, name: str) -> str:
    """Location of every observation in every ring, from one row per edge."""
    return f"""{name}_e(id, ax, ay, bx, ey) AS (SELECT c1, c2::DOUBLE, c3::DOUBLE, c4::DOUBLE, c5::DOUBLE FROM (VALUES {_edge_rows(rings)}) v(c1, c2, c3, c4, c5)),
{name}_d AS (SELECT frame, id, x, y, ax, ay, bx, ey, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / ((bx - ax) ** 2 + (ey - ay) ** 2))) AS u FROM obs, {name}_e),
{name} AS (SELECT frame, id, bool_or(sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (ey - ay)) ** 2) <= 1e-9) AS boundary,
  count(*) FILTER ((ay > y) <> (ey > y) AND x < (bx - ax) * (y - ay) / nullif(ey - ay, 0) + ax) % 2 = 1 AS inside FROM {name}_d GROUP BY frame, id)"""


def polygons(spark, rings: dict):
    return spark.createDataFrame([(1, n, [{"x": x, "y": y} for x, y in r]) for n, r in rings.items()], "version int, profile_id string, ring array<struct<x:double,y:double>>")


@query(f"WITH {EVENTS}, {_place_sql(ZONES, 'p')} SELECT frame, id, CASE WHEN boundary THEN 'boundary' WHEN inside THEN 'inside' ELSE 'outside' END AS location FROM p")
def geo_classify_point(spark, d):
    e = events(spark, d)
    each = F.array(*(F.struct(F.lit(n).alias("id"), G.classify_point(F.struct("x", "y"), G.ring_of(r)).alias("location")) for n, r in ZONES.items()))
    return e.select("frame", F.explode(each).alias("p")).select("frame", "p.id", "p.location")


@query(f"WITH {EVENTS}, s AS (SELECT frame, (0.8 - 0.1) * (y - 0.2) - (0.6 - 0.2) * (x - 0.1) AS side, greatest(0, least(1, ((x - 0.1) * 0.7 + (y - 0.2) * 0.4) / 0.65)) AS u, x, y FROM obs) SELECT frame, round(side, 9) AS side, CASE WHEN abs(side) <= 1e-9 THEN 'on_line' WHEN side > 0 THEN 'left' ELSE 'right' END AS which, round(sqrt((x - 0.1 - u * 0.7) ** 2 + (y - 0.2 - u * 0.4) ** 2), 9) AS distance FROM s")
def geo_segment(spark, d):
    a, b, p = G.point(0.1, 0.2), G.point(0.8, 0.6), F.struct("x", "y")
    return events(spark, d).select("frame", F.round(G.signed_side(a, b, p), 9).alias("side"), G.side_of_line(a, b, p).alias("which"), F.round(G.segment_distance(p, a, b), 9).alias("distance"))


_BOX = "l_discount * 640 AS x1, l_tax * 480 AS y1, l_discount * 640 + l_quantity * 12 AS x2, l_tax * 480 + l_quantity * 10 AS y2"


@query(f"""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_BOX} FROM lineitem), n AS (SELECT *, x1 / 640 AS a, y1 / 480 AS b, x2 / 640 AS c, y2 / 480 AS d FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ok, CASE WHEN ok THEN round(least(c, 1), 9) END AS x_max, CASE WHEN ok THEN round((least(b, 1) + least(d, 1)) / 2, 9) END AS centre_y, CASE WHEN ok THEN round(least(d, 1), 9) END AS foot_y FROM (SELECT *, c <= 1 + 1e-6 AND d <= 1 + 1e-6 AND a < c AND b < d AS ok FROM n)""")
def geo_normalize_box(spark, d):
    c = [F.col("l_discount") * 640, F.col("l_tax") * 480, F.col("l_discount") * 640 + F.col("l_quantity") * 12, F.col("l_tax") * 480 + F.col("l_quantity") * 10]
    box = G.normalize_box(*c, F.lit(640), F.lit(480))
    li = table(spark, d, "lineitem").withColumn("box", box)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("box").isNotNull().alias("ok"), F.round("box.x_max", 9).alias("x_max"), F.round(G.box_point(F.col("box"), F.lit("centroid"))["y"], 9).alias("centre_y"), F.round(G.box_point(F.col("box"), F.lit("footpoint"))["y"], 9).alias("foot_y"))


@query("""WITH r AS (SELECT s_suppkey, (s_suppkey % 7) / 10.0::DOUBLE AS x, (s_suppkey % 5) / 10.0::DOUBLE AS y, 0.1 + (s_suppkey % 4) / 10.0::DOUBLE AS w, 0.1 + (s_suppkey % 3) / 10.0::DOUBLE AS h FROM supplier)
SELECT s_suppkey, round(w * h, 9) AS area, true AS valid, s_suppkey % 2 = 1 AS crossed, round(greatest(0, least(x + w, 0.55) - greatest(x, 0.15)) * greatest(0, least(y + h, 0.55) - greatest(y, 0.15)), 9) AS clipped FROM r""")
def geo_polygons(spark, d):
    k = F.col("s_suppkey")
    x, y, w, h = k % 7 / 10, k % 5 / 10, 0.1 + k % 4 / 10, 0.1 + k % 3 / 10
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h), G.point(x, y))
    bow = F.array(G.point(x, y), G.point(x + w, y + h), G.point(x + w, y), G.point(x, y + h), G.point(x, y))
    s = table(spark, d, "supplier").withColumn("ring", ring).withColumn("bow", F.when(k % 2 == 1, bow).otherwise(ring))
    return s.select("s_suppkey", F.round(G.area(F.col("ring")), 9).alias("area"), G.valid_polygon(F.col("ring")).alias("valid"), G.self_intersecting(F.col("bow")).alias("crossed"), F.round(G.clip_area(F.col("ring"), G.ring_of(SQUARE)), 9).alias("clipped"))


@query(f"""WITH {EVENTS}, {_place_sql(ZONES, 'p')}, m AS (SELECT frame, bool_or(boundary) AS boundary, list_sort(list(id) FILTER (inside)) AS hit FROM p GROUP BY frame)
SELECT frame, CASE WHEN boundary THEN 'boundary' WHEN len(coalesce(hit, [])) = 0 THEN 'outside' WHEN len(hit) = 1 OR list_contains(hit, 'zone-b') THEN 'inside' ELSE 'ambiguous' END AS status,
CASE WHEN boundary OR len(coalesce(hit, [])) = 0 THEN NULL WHEN len(hit) = 1 THEN hit[1] WHEN list_contains(hit, 'zone-b') THEN 'zone-b' END AS profile_id FROM m""")
def spatial_membership(spark, d):
    p = events(spark, d).select(F.col("frame").alias("point_id"), "x", "y", F.lit(1).alias("version"))
    return spatial.membership(p, polygons(spark, ZONES), ["version"], ["zone-b"]).select(F.col("point_id").alias("frame"), "status", "profile_id")


_RINGS = f"{_place_sql(ZONES, 'z')}, {_place_sql({'table-1': TABLE, 'table-2': BENCH}, 't')}, {_place_sql({'private-1': PRIVATE}, 'pr')}, {_place_sql({'closed-1': CLOSED}, 'ex')}"
_EVALUATED = f"""WITH {EVENTS}, {_RINGS}, zz AS (SELECT frame, bool_or(boundary) AS zb, list_sort(list(id) FILTER (inside)) AS zh FROM z GROUP BY frame), tt AS (SELECT frame, bool_or(boundary) AS tb, max(id) FILTER (inside) AS th FROM t GROUP BY frame),
a AS (SELECT zz.*, tb, th, pr.boundary AS pb, pr.inside AND NOT pr.boundary AS pi, ex.boundary AS eb, ex.inside AND NOT ex.boundary AS ei FROM zz JOIN tt USING (frame) JOIN pr USING (frame) JOIN ex USING (frame)),
b AS (SELECT *, CASE WHEN pb THEN 'privacy_boundary' WHEN pi THEN NULL WHEN eb THEN 'exclusion_boundary' WHEN ei THEN NULL WHEN zb THEN 'zone_boundary' WHEN tb THEN 'table_boundary' END AS error_code FROM a)"""


def _evaluate(spark, d):
    p = events(spark, d).select(F.col("frame").alias("point_id"), "x", "y", F.lit(1).alias("version"))
    return spatial.evaluate(p, polygons(spark, {"private-1": PRIVATE}), polygons(spark, {"closed-1": CLOSED}), polygons(spark, ZONES), polygons(spark, {"table-1": TABLE, "table-2": BENCH}), ["version"])


@query(f"""{_EVALUATED} SELECT frame, CASE WHEN pi THEN 'privacy' WHEN ei THEN 'excluded' WHEN len(zh) > 1 THEN 'ambiguous' WHEN len(zh) = 1 THEN 'inside' ELSE 'outside' END AS status,
CASE WHEN NOT pi AND NOT ei AND len(zh) = 1 THEN zh[1] END AS zone_profile_id, CASE WHEN NOT pi AND NOT ei AND coalesce(len(zh), 0) <= 1 THEN th END AS table_profile_id FROM b WHERE error_code IS NULL""")
def spatial_observations(spark, d):
    return _evaluate(spark, d)[0].select(F.col("point_id").alias("frame"), "status", "zone_profile_id", "table_profile_id")


@query(f"{_EVALUATED} SELECT frame, error_code FROM b WHERE error_code IS NOT NULL")
def spatial_quarantine(spark, d):
    return _evaluate(spark, d)[1].select(F.col("point_id").alias("frame"), "error_code")


@query(f"""WITH {EVENTS}, m AS (SELECT track, frame, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, frame)),
s AS (SELECT *, 0.2::DOUBLE AS ax, 0.505::DOUBLE AS ay, 0.8::DOUBLE AS bx, 0.505::DOUBLE AS ey FROM m WHERE px IS NOT NULL)
SELECT track, frame, CASE WHEN hit THEN 'crossed' ELSE 'not_crossed' END AS crossing_state, CASE WHEN hit THEN CASE WHEN py > ay THEN 'forward' ELSE 'reverse' END END AS direction FROM (
SELECT *, (py > ay) <> (y > ay) AND ((x - px) * (ay - py) - (y - py) * (ax - px)) * ((x - px) * (ey - py) - (y - py) * (bx - px)) < 0 AS hit FROM s)""")
def spatial_line_crossings(spark, d):
    out = spatial.line_crossings(events(spark, d), ["track"], ((0.2, 0.505), (0.8, 0.505)))
    return out.select("track", "frame", "crossing_state", "direction")


_ENTITIES = """e AS (SELECT 'v' || (n_nationkey % 9) AS version_id, n_nationkey AS k, 'zone-' || n_nationkey AS profile_id, 'zone-' || (n_nationkey + CASE WHEN n_nationkey % 6 = 0 THEN 100 ELSE 0 END) AS target, (n_nationkey % 7) / 10.0::DOUBLE AS x, 0.1 + (n_nationkey % 2) / 5.0::DOUBLE AS w FROM nation)"""


def _configuration(spark, d):
    """Zones, a table for each (those of odd keys stick out of their zone), and cameras."""
    k = F.col("n_nationkey")
    x, w = k % 7 / 10, F.when(k % 8 == 0, 0.0).otherwise(0.2)
    box = lambda x0, y0, x1, y1: F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1), G.point(x0, y0))
    n, none, key = table(spark, d, "nation"), F.lit(None), k.cast("string")
    base = [F.concat(F.lit("v"), (k % 9).cast("string")).alias("version_id")]
    refs = F.array(F.struct(F.lit("zone").alias("category"), F.concat(F.lit("zone-"), (k + F.when(k % 6 == 0, 100).otherwise(0)).cast("string")).alias("profile_id")))

    def entity(category: str, name: str, shape: str, ring, status, zone, refs_):
        return n.select(
            *base, F.lit(category).alias("category"), F.concat(F.lit(name), key).alias("profile_id"), k.cast("int").alias("ord"), F.lit("venue_local").alias("space"), F.lit(shape).alias("geometry_type"), ring.alias("ring"),
            none.cast("string").alias("camera_id"), status.alias("status"), F.lit("count").alias("task"), F.lit(1).alias("priority"), zone.cast("string").alias("zone_profile_id"), refs_.alias("refs"),
        )

    zone_ring = box(x, F.lit(0.1), x + w, F.lit(0.3))
    zones = entity("zone", "zone-", "polygon", zone_ring, F.lit("active"), none, F.slice(refs, 1, 0))
    tables = entity("table", "table-", "polygon", box(x + 0.05, F.lit(0.15), x + 0.05 + 0.1 + k % 2 / 5, F.lit(0.25)), F.lit("active"), F.concat(F.lit("zone-"), key), F.slice(refs, 1, 0))
    cameras = entity("camera", "cam-", "point", none.cast(zones.schema["ring"].dataType), F.when(k % 4 == 0, "offline").otherwise("active"), none, refs)
    return zones.unionByName(tables).unionByName(cameras)


_FINDINGS = f"""{_ENTITIES}, broken AS (SELECT DISTINCT version_id FROM e WHERE k % 6 = 0 OR k % 8 = 0),
findings AS (SELECT version_id, 'reference' AS stage, 'error' AS severity, 'dangling_zone' AS code, 'cam-' || k AS profile_id, target AS other_id FROM e WHERE k % 6 = 0
UNION ALL SELECT version_id, 'geometry', 'error', 'degenerate', profile_id, NULL FROM e WHERE k % 8 = 0
UNION ALL SELECT version_id, 'camera', 'error', 'camera_not_active', 'cam-' || k, NULL FROM e WHERE k % 4 = 0
UNION ALL SELECT version_id, 'compatibility', 'warning', 'zone_not_covered', profile_id, NULL FROM e WHERE profile_id NOT IN (SELECT target FROM e)
UNION ALL SELECT a.version_id, 'spatial', 'error', 'table_overlap', 'table-' || a.k, 'table-' || b.k FROM e a JOIN e b ON a.version_id = b.version_id AND a.k < b.k AND (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * 0.1 > 1e-6 WHERE a.version_id NOT IN (SELECT version_id FROM broken)
UNION ALL SELECT version_id, 'spatial', 'error', 'invalid_containment', 'table-' || k, profile_id FROM e WHERE k % 2 = 1 AND version_id NOT IN (SELECT version_id FROM broken))"""


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def config_findings(spark, d):
    return configuration.validate(_configuration(spark, d))


@query(f"WITH {_FINDINGS} SELECT v AS version_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS valid FROM (SELECT DISTINCT version_id AS v FROM e) LEFT JOIN findings ON v = version_id GROUP BY v")
def config_summary(spark, d):
    e = _configuration(spark, d)
    return configuration.summary(configuration.validate(e), e.select("version_id").distinct())


@query(f"WITH {_ENTITIES} SELECT version_id, count(*) AS zones, count(*) AS cameras, min_by(profile_id, profile_id) AS first_zone FROM e GROUP BY version_id")
def config_hydrated(spark, d):
    n = configuration.nested(_configuration(spark, d))
    return n.select("version_id", F.size("zones").cast("long").alias("zones"), F.size("cameras").cast("long").alias("cameras"), F.array_min(F.transform("zones", lambda z: z["profile_id"])).alias("first_zone"))


#: The policies of pairs, written from their description: all pairs not named otherwise allow an overlap.
@query("""WITH policy AS (SELECT category, other_category, CASE WHEN category = 'table' AND other_category = 'table' THEN 'reject' WHEN other_category = 'zone' AND category IN ('table','queue_area','service_area') THEN 'validate' WHEN category = 'privacy_roi' AND other_category = 'exclusion_roi' THEN 'validate' ELSE 'allow' END AS overlap,
CASE WHEN (category, other_category) IN (('zone','zone'), ('queue_area','service_area'), ('queue_area','queue_area'), ('camera','zone')) THEN 'warning' ELSE 'error' END AS severity,
other_category = 'zone' AND category IN ('table','queue_area','service_area') AS containment, category = 'entrance' AS touch
FROM (VALUES ('table','table'), ('table','zone'), ('queue_area','zone'), ('service_area','zone'), ('entrance','zone'), ('zone','zone'), ('queue_area','service_area'), ('queue_area','queue_area'), ('privacy_roi','exclusion_roi'), ('camera','zone')) v(category, other_category)
UNION ALL SELECT a, b, 'allow', 'error', false, false FROM (VALUES ('privacy_roi'), ('exclusion_roi')) p(a), (VALUES ('zone'), ('table'), ('queue_area'), ('service_area'), ('entrance')) q(b)), names AS (SELECT ['camera','zone','table','entrance','privacy_roi','exclusion_roi','service_area','queue_area'] AS n),
pair AS (SELECT s_suppkey, n[s_suppkey % 8 + 1] AS a, n[s_suppkey // 8 % 8 + 1] AS b FROM supplier, names)
SELECT s_suppkey, a, b, overlap, severity, containment, touch FROM pair LEFT JOIN policy ON (category = a AND other_category = b) OR (category = b AND other_category = a)""")
def config_policies(spark, d):
    """The policy of each pair of entities, in either order."""
    k = F.col("s_suppkey")
    name = lambda n: F.element_at(F.array(*map(F.lit, configuration.CATEGORIES)), (n % 8 + 1).cast("int"))
    pairs = table(spark, d, "supplier").select("s_suppkey", name(k).alias("a"), name(F.floor(k / 8)).alias("b"))
    p = configuration.policies(spark)
    rest = ("overlap", "severity", "containment", "touch")
    turned = p.where("category <> other_category").select(F.col("other_category").alias("a"), F.col("category").alias("b"), *rest)
    return pairs.join(p.select(F.col("category").alias("a"), F.col("other_category").alias("b"), *rest).unionByName(turned), ["a", "b"], "left").select("s_suppkey", "a", "b", "overlap", "severity", "containment", "touch")


@query("""SELECT 'v' || (p_partkey % 50) AS version_id, 'p' || (p_partkey % 200) AS profile_id FROM part WHERE p_partkey % 4 IN (1, 2) OR (p_partkey % 4 = 0 AND p_partkey % 3 = 0) GROUP BY ALL""")
def config_waiting_contexts(spark, d):
    k = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, ("zone", "queue_area", "service_area", "table"))), (k % 4 + 1).cast("int"))
    e = table(spark, d, "part").select(F.concat(F.lit("v"), (k % 50).cast("string")).alias("version_id"), category.alias("category"), F.concat(F.lit("p"), (k % 200).cast("string")).alias("profile_id"), F.when(k % 3 == 0, "waiting_area").otherwise("lobby").alias("zone_type"))
    return configuration.waiting_contexts(e)


@query("""WITH e AS (SELECT n_nationkey % 5 AS v, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 4 END AS c, n_nationkey % 4 IN (0, 1) OR (n_nationkey % 4 < 3 AND n_nationkey % 2 = 1) OR (n_nationkey % 4 = 2 AND n_nationkey % 5 = 0) AS venue FROM nation)
SELECT c_custkey AS point_id, c_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM e WHERE venue AND e.v = c_custkey % 5 AND (e.c IS NULL OR e.c = c_custkey % 6)) AS needs_venue_point FROM customer""")
def spatial_needs_venue_point(spark, d):
    k = F.col("n_nationkey")
    category = F.element_at(F.array(*map(F.lit, ("zone", "table", "privacy_roi", "camera"))), (k % 4 + 1).cast("int"))
    e = table(spark, d, "nation").select((k % 5).alias("version_id"), F.when(k % 3 != 0, k % 4).alias("camera_id"), category.alias("category"), F.when(k % 5 == 0, "venue_local").otherwise("image_normalized").alias("space"))
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("point_id"), (c % 5).alias("version_id"), (c % 6).alias("camera_id"), F.when(c % 2 == 0, "image_normalized").otherwise("venue_local").alias("space"))
    return spatial.needs_venue_point(points, e).select("point_id", "needs_venue_point")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 4 = s_suppkey % 5 AND s_suppkey % 7 <> 0 ELSE s_suppkey % 2 = 0 OR s_suppkey % 5 IN (1, 2) END AS applies FROM supplier""")
def spatial_line_applies(spark, d):
    k = F.col("s_suppkey")
    scope, reference = F.when(k % 3 == 0, "camera").otherwise("venue"), F.when(k % 7 != 0, (k % 4).cast("string"))
    cameras = F.when(k % 2 == 1, F.array(F.lit("1"), F.lit("2")))
    return table(spark, d, "supplier").select("s_suppkey", spatial.line_applies(scope, reference, cameras, (k % 5).cast("string")).alias("applies"))


@query(f"""{_EVALUATED}, n AS (SELECT * FROM b, (VALUES (1), (2)) twice(t)) SELECT frame, CASE WHEN pi THEN 'privacy' WHEN ei THEN 'excluded' WHEN len(zh) > 1 THEN 'ambiguous' WHEN len(zh) = 1 THEN 'inside' ELSE 'outside' END AS status FROM n WHERE error_code IS NULL""")
def spatial_repeated_points(spark, d):
    """Repeated rows of a point give one observation each."""
    p = events(spark, d).select(F.col("frame").alias("point_id"), "x", "y", F.lit(1).alias("version"))
    rings = [polygons(spark, x) for x in ({"private-1": PRIVATE}, {"closed-1": CLOSED}, ZONES, {"table-1": TABLE, "table-2": BENCH})]
    return spatial.evaluate(p.union(p), *rings, ["version"])[0].select(F.col("point_id").alias("frame"), "status")


#: Rings beside the zones: a table that lies in no zone, one across a zone's edge, and one that overlaps another.
_SIDE = [(0.05, 0.05), (0.12, 0.05), (0.12, 0.12), (0.05, 0.12), (0.05, 0.05)]
_ACROSS = [(0.45, 0.18), (0.65, 0.18), (0.65, 0.28), (0.45, 0.28), (0.45, 0.18)]
_OVER = [(0.25, 0.25), (0.36, 0.25), (0.36, 0.36), (0.25, 0.36), (0.25, 0.25)]
_TABLES = {"table-1": TABLE, "table-2": BENCH, "table-3": _SIDE, "table-4": _ACROSS, "table-5": _OVER}
_ROIS = {"private-1": PRIVATE, "closed-1": CLOSED}


def _camera_inputs(spark, d):
    """Versions 1 (published) and 2 (draft); camera 0 declares zones and regions, camera 1 the image's regions only (its version has no tables), camera 2 zone-b and zone-c, camera 3 nothing is known of."""
    e, f = events(spark, d), F.col("frame").cast("long")
    points = e.select(
        F.col("frame").alias("point_id"), F.when(f % 10 == 7, F.lit(2)).when(f % 4 == 1, F.lit(3)).otherwise(F.lit(1)).alias("version"), F.when(f % 4 == 3, F.when(f % 3 == 0, "cam-3").otherwise("cam-0")).otherwise(F.concat(F.lit("cam-"), (f % 4).cast("string"))).alias("camera_id"),
        F.when((f % 5 == 0) | (f % 4 == 1), "image_normalized").otherwise("venue_local").alias("space"), F.when(f % 50 != 4, F.col("x")).alias("x"), F.when(f % 50 == 5, F.col("y") + 1).otherwise(F.col("y")).alias("y"),
    )
    some, none = F.array(F.lit("zone-a"), F.lit("zone-b"), F.lit("zone-c")), F.array().cast("array<string>")
    cams = spark.range(5).select(
        F.element_at(F.array(*map(F.lit, (1, 3, 1, 2, 2))), (F.col("id") + 1).cast("int")).alias("version"), F.when(F.col("id").isin(3, 4), "draft").otherwise("published").alias("status"),
        F.element_at(F.array(*map(F.lit, ("cam-0", "cam-1", "cam-2", "cam-0", "cam-2"))), (F.col("id") + 1).cast("int")).alias("camera_id"), F.when(F.col("id") == 0, some).when(F.col("id") == 2, F.slice(some, 2, 2)).otherwise(none).alias("zones"),
        F.when(F.col("id") <= 1, F.array(F.lit("private-1"))).otherwise(none).alias("privacy"), F.when(F.col("id") <= 1, F.array(F.lit("closed-1"))).otherwise(none).alias("exclusion"),
    )
    rows = [(v, k, n, "image_normalized" if v == 3 else "venue_local", [{"x": x, "y": y} for x, y in r], ["table-1", "table-5"] if n == "zone-a" else None)
            for v in (1, 2, 3) for k, rings in (("zone", ZONES), ("table", _TABLES), ("privacy", {"private-1": PRIVATE}), ("exclusion", {"closed-1": CLOSED})) if not (v == 3 and k in ("zone", "table")) for n, r in rings.items()]
    polygons_ = spark.createDataFrame(rows, "version int, kind string, profile_id string, space string, ring array<struct<x:double,y:double>>, contained array<string>")
    return points, cams, polygons_


_CAMERAS = f"""WITH {EVENTS}, {_place_sql(ZONES, 'z')}, {_place_sql(_TABLES, 't')}, {_place_sql({'private-1': PRIVATE}, 'pr')}, {_place_sql({'closed-1': CLOSED}, 'ex')},
c AS (SELECT frame, frame::BIGINT AS n, CASE WHEN n % 10 = 7 THEN 2 WHEN n % 4 = 1 THEN 3 ELSE 1 END AS version, CASE WHEN n % 4 = 3 THEN CASE WHEN n % 3 = 0 THEN 3 ELSE 0 END ELSE n % 4 END AS cam, n % 5 = 0 OR n % 4 = 1 AS image FROM obs),
zz AS (SELECT frame, bool_or(boundary) AS zb, list_sort(list(id) FILTER (inside)) AS zh FROM z JOIN c USING (frame) WHERE version = 1 AND (cam = 0 OR cam = 2 AND id <> 'zone-a') GROUP BY frame),
tt AS (SELECT frame, bool_or(boundary) AS tb, list_sort(list(id) FILTER (inside)) AS th FROM t GROUP BY frame),
k AS (SELECT c.*, version = 1 AND cam IN (0, 2) OR version = 3 AND cam = 1 AS seen, coalesce(zb, false) AS zb, coalesce(zh, []) AS zh, tb, coalesce(th, []) AS th, cam < 2 AND image = (version = 3) AS roi, pr.boundary AS pb, pr.inside AND NOT pr.boundary AS pi, ex.boundary AS eb, ex.inside AND NOT ex.boundary AS ei
  FROM c LEFT JOIN zz USING (frame) LEFT JOIN tt USING (frame) JOIN pr USING (frame) JOIN ex USING (frame)),
j AS (SELECT frame, zh, th, roi AND pi AS pi, roi AND ei AND NOT pi AS ei, CASE WHEN len(zh) > 1 OR version = 1 AND len(th) > 1 AND NOT list_contains(th, 'table-5') THEN 'ambiguous' END AS amb, version,
  CASE WHEN n % 50 = 4 OR n % 50 = 5 AND image THEN 'invalid_point' WHEN version = 2 THEN 'not_published' WHEN NOT seen THEN 'unknown_camera' WHEN roi AND pb THEN 'privacy_boundary' WHEN roi AND pi THEN NULL WHEN roi AND eb THEN 'exclusion_boundary' WHEN roi AND ei THEN NULL
    WHEN image AND version = 1 THEN 'venue_point_required' WHEN zb THEN 'zone_boundary' WHEN version = 1 AND tb THEN 'table_boundary' END AS error_code FROM k WHERE n % 50 <> 5 OR image)"""


@query(f"""{_CAMERAS} SELECT frame, CASE WHEN pi THEN 'privacy' WHEN ei THEN 'excluded' WHEN amb IS NOT NULL THEN amb WHEN len(zh) = 1 THEN 'inside' ELSE 'outside' END AS status, CASE WHEN pi THEN 'private-1' WHEN ei THEN 'closed-1' END AS roi_profile_id,
CASE WHEN NOT pi AND NOT ei AND amb IS NULL THEN zh[1] END AS zone_profile_id, CASE WHEN NOT pi AND NOT ei AND amb IS NULL AND version = 1 THEN CASE WHEN len(th) > 1 THEN 'table-5' ELSE th[1] END END AS table_profile_id,
CASE WHEN NOT pi AND NOT ei AND amb IS NULL AND zh[1] = 'zone-a' THEN 'table-1,table-5' END AS contained FROM j WHERE error_code IS NULL""")
def spatial_camera_observations(spark, d):
    """Camera-scoped evaluation; venue points beyond the rings are left to spatial_camera_errors' data."""
    points, cams, rings = _camera_inputs(spark, d)
    good = spatial.evaluate_cameras(points.where("not (point_id % 50 = 5 and space = 'venue_local')"), cams, rings, None, ["table-5"])[0]
    return good.select(F.col("point_id").alias("frame"), "status", "roi_profile_id", "zone_profile_id", "table_profile_id", F.array_join("contained_tables", ",").alias("contained"))


@query(f"{_CAMERAS} SELECT frame, error_code FROM j WHERE error_code IS NOT NULL")
def spatial_camera_errors(spark, d):
    points, cams, rings = _camera_inputs(spark, d)
    return spatial.evaluate_cameras(points.where("not (point_id % 50 = 5 and space = 'venue_local')"), cams, rings, None, ["table-5"])[1].select(F.col("point_id").alias("frame"), "error_code")


#: Shapes of unit cells, counter-clockwise: an L, a U and a square, as cells and as rings.
_SHAPES = {
    "l": ([(0, 0), (1, 0), (2, 0), (0, 1), (0, 2)], [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)]),
    "u": ([(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2)], [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)]),
    "s": ([(0, 0), (1, 0), (0, 1), (1, 1)], [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]),
}
_CELLS = ", ".join(f"('{n}', {x}, {y})" for n, (cells, _) in _SHAPES.items() for x, y in cells)


@query(f"""WITH c(s, x, y) AS (VALUES {_CELLS}), k AS (SELECT s_suppkey, ['l', 'u', 's'][s_suppkey % 3 + 1] AS sa, ['l', 'u', 's'][s_suppkey // 3 % 3 + 1] AS sb, s_suppkey // 9 % 5 - 1 AS dx, s_suppkey // 45 % 5 - 1 AS dy FROM supplier),
a AS (SELECT s_suppkey, x, y FROM k JOIN c ON s = sa), b AS (SELECT s_suppkey, x + dx AS x, y + dy AS y FROM k JOIN c ON s = sb), n AS (SELECT s_suppkey, count(*) AS n FROM b GROUP BY ALL),
i AS (SELECT s_suppkey, count(*) AS cells FROM a JOIN b USING (s_suppkey, x, y) GROUP BY ALL), g AS (SELECT DISTINCT a.s_suppkey FROM a JOIN b ON a.s_suppkey = b.s_suppkey AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
SELECT s_suppkey, coalesce(cells, 0)::DOUBLE AS overlap, coalesce(cells, 0) = n AS contains, cells IS NULL AND g.s_suppkey IS NOT NULL AS touches FROM k JOIN n USING (s_suppkey) LEFT JOIN i USING (s_suppkey) LEFT JOIN g USING (s_suppkey)""")
def geo_overlay(spark, d):
    """Concave shapes against each other at all offsets, some clockwise; the SQL counts unit cells."""
    k = F.col("s_suppkey")
    shape = lambda n, dx, dy: F.element_at(F.array(*(F.array(*(F.struct((F.lit(float(x)) + dx).alias("x"), (F.lit(float(y)) + dy).alias("y")) for x, y in r)) for _, r in _SHAPES.values())), (n % 3 + 1).cast("int"))
    zero = F.lit(0.0)
    a, b = shape(k, zero, zero), shape(F.floor(k / 3), F.floor(k / 9) % 5 - 1.0, F.floor(k / 45) % 5 - 1.0)
    # milliseconds a row: dealt to all tasks, as a small file would be one
    dealt = table(spark, d, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    s = dealt.select("s_suppkey", F.when(k % 2 == 0, a).otherwise(F.reverse(a)).alias("a"), F.when(k % 7 < 3, b).otherwise(F.reverse(b)).alias("b"))
    s = s.withColumn("overlap", G.overlay_area(F.col("a"), F.col("b")))
    return s.select("s_suppkey", F.round("overlap", 9).alias("overlap"), G.overlay_contains(F.col("a"), F.col("b"), F.col("overlap")).alias("contains"), G.overlay_touches(F.col("a"), F.col("b"), F.col("overlap")).alias("touches"))


@query("""WITH r AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS image, s_suppkey / 7.0::DOUBLE AS x, s_suppkey / 9.0::DOUBLE AS y, s_suppkey % 3 = 0 AS open FROM supplier)
SELECT s_suppkey, CASE WHEN open THEN 4 ELSE 5 END + CASE WHEN open THEN 1 ELSE 0 END AS points, round_even(x, CASE WHEN image THEN 6 ELSE 3 END) AS x, round_even(y, CASE WHEN image THEN 6 ELSE 3 END) AS y FROM r""")
def geo_canonical_ring(spark, d):
    """Rings rounded by their space and closed."""
    k = F.col("s_suppkey")
    x, y = k / 7, k / 9
    open_ring = F.array(G.point(x, y), G.point(x + 1, y), G.point(x + 1, y + 1), G.point(x, y + 1))
    ring = F.when(k % 3 == 0, open_ring).otherwise(F.concat(open_ring, F.slice(open_ring, 1, 1)))
    s = table(spark, d, "supplier").select("s_suppkey", G.canonical_ring(ring, F.when(k % 2 == 0, "image_normalized").otherwise("venue_local")).alias("r"))
    return s.select("s_suppkey", F.size("r").alias("points"), F.col("r")[0]["x"].alias("x"), F.col("r")[F.size("r") - 1]["y"].alias("y"))
