"""Spatial joins: points with zones, tables and regions; line crossings.

Polygons are a dimension, yet a join does not rely on broadcasting them: each polygon is
listed under the few cells of its own size that its bounding box covers, and points look
up their cell of every size that their scope has, so it stays an equi-join at any size
and extent; Spark still broadcasts a small side itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import geometry as G

#: Cells are squares of 2**level; a polygon's level is that of its longer side, between these.
LEVELS = (-20, 40)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _hits(points: DataFrame, polygons: DataFrame, on: list[str], aggregates: list[Column]) -> DataFrame:
    """Every row of points with aggregates over the polygons whose bounding box holds it (columns _kind, _id, _space, _location: inside, boundary or outside).

    points: on, x, y; polygons: on, kind, profile_id, its_space, ring. Equal rows of points are one row with a number until
    the end, and all columns travel along, so the points are dealt once and nothing is joined back.
    """
    xs, ys, level = F.col("_ring.x"), F.col("_ring.y"), F.col("_level")
    named = polygons.select(*(F.col(c).alias(f"_on_{c}") for c in on), F.col("kind").alias("_kind"), F.col("profile_id").alias("_id"), F.col("its_space").alias("_space"), F.col("ring").alias("_ring"))
    boxed = named.withColumns({"_x0": F.array_min(xs) - G.TOLERANCE, "_x1": F.array_max(xs) + G.TOLERANCE, "_y0": F.array_min(ys) - G.TOLERANCE, "_y1": F.array_max(ys) + G.TOLERANCE})
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    boxed = boxed.withColumn("_level", F.greatest(F.least(F.ceil(F.log2(side)), F.lit(LEVELS[1])), F.lit(LEVELS[0])).cast("int"))
    listed = boxed.withColumn("_px", F.explode(F.sequence(_cell(F.col("_x0"), level), _cell(F.col("_x1"), level)))).withColumn("_py", F.explode(F.sequence(_cell(F.col("_y0"), level), _cell(F.col("_y1"), level)))).withColumnRenamed("_level", "_of")
    levels = boxed.groupBy(*(f"_on_{c}" for c in on)).agg(F.collect_set("_level").alias("_levels"))  # at most one for each level, by scope
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_on_{c}") for c in on))
    once = points.groupBy(*points.columns).agg(F.count("*").alias("_times"))
    own = once.join(levels, same, "left").drop(*(f"_on_{c}" for c in on)).withColumn("_level", F.explode_outer("_levels")).drop("_levels")
    own = own.withColumn("_cx", _cell(F.col("x"), level)).withColumn("_cy", _cell(F.col("y"), level))
    held = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    near = own.join(listed, same & (level == F.col("_of")) & (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py")) & held, "left")
    near = near.withColumn("_location", F.when(F.col("_id").isNotNull(), G.classify_point(F.struct("x", "y"), F.col("_ring"))))
    hit = near.groupBy(*points.columns, "_times").agg(*aggregates)
    return hit.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times", "_turn")


def _first(kind: str, own_space: bool = False) -> Column:
    """The first polygon of a kind, by id, that holds the point or has it on its boundary."""
    hit = (F.col("_kind") == kind) & F.col("_location").isin("inside", "boundary")
    return F.min(F.when(hit & (F.col("_space") == F.col("space")) if own_space else hit, F.struct(F.col("_id").alias("profile_id"), F.col("_location").alias("location")))).alias(f"_{kind}")


def _matched(kind: str) -> list[Column]:
    """Aggregates: whether a polygon's boundary holds the point, and the polygons that hold it."""
    own = F.col("_kind") == kind
    return [F.bool_or(own & (F.col("_location") == "boundary")).alias(f"_{kind}_boundary"), F.array_sort(F.collect_set(F.when(own & (F.col("_location") == "inside"), F.col("_id")))).alias(f"_{kind}_ids")]


def _of_kind(polygons: DataFrame, on: list[str], kind: str) -> DataFrame:
    return polygons.select(*on, F.lit(kind).alias("kind"), "profile_id", F.lit(None).cast("string").alias("its_space"), "ring")


def _membership(name: str, priority: list[str] | None) -> tuple[Column, Column]:
    """Status and polygon of a point by the aggregates of _matched()."""
    ids = F.coalesce(F.col(f"_{name}_ids"), F.array().cast("array<string>"))
    first = F.get(F.filter(F.array(*(F.lit(p) for p in priority or [""])), lambda p: F.array_contains(ids, p)), F.lit(0))
    n = F.size(ids)
    status = F.when(F.col(f"_{name}_boundary"), "boundary").when(n == 0, "outside").when((n == 1) | first.isNotNull(), "inside").otherwise("ambiguous")
    return status, F.when(status == "inside", F.when(n == 1, F.get(ids, F.lit(0))).otherwise(first))


def membership(points: DataFrame, polygons: DataFrame, on: list[str], priority: list[str] | None = None) -> DataFrame:
    """Each point (point_id) with status inside, outside, ambiguous or boundary, and the polygon it belongs to.

    A boundary of any polygon makes the point one for quarantine. Of several matches the first of priority counts.
    """
    status, profile = _membership("polygon", priority)
    hit = _hits(points, _of_kind(polygons, on, "polygon"), on, _matched("polygon"))
    return hit.withColumns({"status": status, "profile_id": profile, "matched": F.coalesce("_polygon_ids", F.array().cast("array<string>"))}).select(*points.columns, "status", "profile_id", "matched")


def evaluate(points: DataFrame, privacy: DataFrame, exclusion: DataFrame, zones: DataFrame, tables: DataFrame, on: list[str], zone_priority: list[str] | None = None, table_priority: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Spatial observations and quarantined points. Privacy comes before exclusion, exclusion before zones and tables.

    Of privacy (and exclusion) regions the first by profile_id that holds a point counts; a boundary that comes before it
    makes the point one for quarantine. All polygons are joined and aggregated at once. An ambiguous point names neither zone
    nor table; a table without a zone is outside and keeps its name.
    """
    kinds = {"privacy": privacy, "exclusion": exclusion, "zone": zones, "table": tables}
    all_polygons = reduce(DataFrame.unionByName, (_of_kind(df, on, k) for k, df in kinds.items()))
    at = _hits(points, all_polygons, on, [_first("privacy"), _first("exclusion"), *_matched("zone"), *_matched("table")])
    (zone_status, zone), (table_status, table) = _membership("zone", zone_priority), _membership("table", table_priority)
    private, excluded = F.coalesce(F.col("_privacy.location") == "inside", F.lit(False)), F.coalesce(F.col("_exclusion.location") == "inside", F.lit(False))
    bad = (
        F.when(F.col("_privacy.location") == "boundary", "privacy_boundary").when(private, None).when(F.col("_exclusion.location") == "boundary", "exclusion_boundary").when(excluded, None)
        .when(zone_status == "boundary", "zone_boundary").when(table_status == "boundary", "table_boundary")
    )
    ambiguous, inside = (zone_status == "ambiguous") | (table_status == "ambiguous"), zone_status == "inside"
    status = F.when(private, "privacy").when(excluded, "excluded").when(ambiguous, "ambiguous").when(inside, "inside").otherwise("outside")
    named = ~(private | excluded | ambiguous)
    marked = at.withColumns({"error_code": bad, "status": status, "zone_profile_id": F.when(named, zone), "table_profile_id": F.when(named, table)})
    good = marked.where("error_code is null").select(*points.columns, "status", "zone_profile_id", "table_profile_id")
    return good, marked.where("error_code is not null").select(*points.columns, "error_code")


#: Coordinate spaces.
IMAGE, VENUE = "image_normalized", "venue_local"


def evaluate_cameras(points: DataFrame, cameras: DataFrame, polygons: DataFrame, zone_priority: list[str] | None = None, table_priority: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Spatial observations and quarantined points of cameras under the pinned configuration versions.

    points: point_id, version, camera_id, space, x, y. cameras: version, status, camera_id and the profile ids that the camera
    declares (zones, privacy, exclusion: arrays). polygons: version, kind (zone, table, privacy, exclusion), profile_id, space,
    ring, and for zones contained (table profile ids). Tables belong to all cameras of their version.

    In this order: a point without coordinates, or outside of its space, is invalid_point; a version that is not published,
    or a camera that it lacks, is an error; privacy and then exclusion regions of the point's own space (the first by profile
    id; a boundary that comes before it is an error); a point of the image where the camera declares venue geometry needs a
    venue point; zones, then tables (boundaries are errors). Several zones or tables without a priority are ambiguous, and
    an ambiguous point names none; a table without a zone is outside and keeps its name; inside carries the zone's tables.
    """
    keys = ["version", "camera_id"]
    known = cameras.groupBy(*keys).agg(F.min("status").alias("_status"), *(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))).alias(f"_{c}") for c in ("zones", "privacy", "exclusion")))
    named = polygons.select("version", "kind", "profile_id", F.col("space").alias("its_space"), "ring")

    def of(column: str, kind: str) -> Column:
        return F.transform(column, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("profile_id")))

    own = known.select(*keys, F.explode(F.concat(of("_zones", "zone"), of("_privacy", "privacy"), of("_exclusion", "exclusion"))).alias("_p"))
    declared = own.select(*keys, "_p.kind", "_p.profile_id").join(named, ["version", "kind", "profile_id"])
    tables = known.select(*keys).join(named.where("kind = 'table'"), "version")
    each = declared.unionByName(tables)
    venue = each.groupBy(*keys).agg(F.bool_or(F.col("kind").isin("zone", "table") | (F.col("its_space") == VENUE)).alias("_venue"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    in_image = (F.col("space") != IMAGE) | (F.col("x").between(0, 1) & F.col("y").between(0, 1))
    valid = F.coalesce(finite("x") & finite("y") & in_image & F.col("space").isin(IMAGE, VENUE), F.lit(False))

    at = _hits(points, each, keys, [_first("privacy", True), _first("exclusion", True), *_matched("zone"), *_matched("table")])
    at = at.join(known.select(*keys, "_status"), keys, "left").join(venue, keys, "left")

    (zone_status, zone), (table_status, table) = _membership("zone", zone_priority), _membership("table", table_priority)
    private, excluded = F.coalesce(F.col("_privacy.location") == "inside", F.lit(False)), F.coalesce(F.col("_exclusion.location") == "inside", F.lit(False))
    versions = cameras.groupBy("version").agg(F.min("status").alias("_version_status"))
    at = at.join(versions, "version", "left")
    bad = (
        F.when(~valid, "invalid_point").when(~F.col("_version_status").eqNullSafe(F.lit("published")), "not_published").when(F.col("_status").isNull(), "unknown_camera")
        .when(F.col("_privacy.location") == "boundary", "privacy_boundary").when(private, None).when(F.col("_exclusion.location") == "boundary", "exclusion_boundary").when(excluded, None)
        .when((F.col("space") == IMAGE) & F.coalesce("_venue", F.lit(False)), "venue_point_required").when(zone_status == "boundary", "zone_boundary").when(table_status == "boundary", "table_boundary")
    )
    ambiguous = (zone_status == "ambiguous") | (table_status == "ambiguous")
    status = F.when(private, "privacy").when(excluded, "excluded").when(ambiguous, "ambiguous").when(zone_status == "inside", "inside").otherwise("outside")
    names = ~(private | excluded | ambiguous)
    marked = at.withColumns({"error_code": bad, "status": status, "roi_profile_id": F.when(private, F.col("_privacy.profile_id")).when(excluded, F.col("_exclusion.profile_id")), "zone_profile_id": F.when(names, zone), "table_profile_id": F.when(names, table)})
    contained = polygons.where("kind = 'zone'").select("version", F.col("profile_id").alias("zone_profile_id"), F.col("contained").alias("contained_tables"))
    good = marked.where("error_code is null").join(contained, ["version", "zone_profile_id"], "left")
    return good.select(*points.columns, "status", "roi_profile_id", "zone_profile_id", "table_profile_id", "contained_tables"), marked.where("error_code is not null").select(*points.columns, "error_code")


def needs_venue_point(points: DataFrame, entities: DataFrame) -> DataFrame:
    """Points (version_id, camera_id, space) with needs_venue_point: their camera declares venue geometry, but they are in image coordinates.

    Zones and tables are venue geometry; privacy and exclusion regions are where their space says so. Entities without camera_id hold for all cameras of their version.
    """
    venue = F.col("category").isin("zone", "table") | (F.col("category").isin("privacy_roi", "exclusion_roi") & (F.col("space") == "venue_local"))
    declared = entities.where(venue).select("version_id", "camera_id").distinct()
    every = declared.where("camera_id is null").select("version_id", F.lit(True).alias("_every"))
    own = declared.where("camera_id is not null").select("version_id", "camera_id", F.lit(True).alias("_own"))
    both = points.join(every, "version_id", "left").join(own, ["version_id", "camera_id"], "left")
    needs = (F.col("space") == "image_normalized") & (F.col("_every").isNotNull() | F.col("_own").isNotNull())
    return both.withColumn("needs_venue_point", F.coalesce(needs, F.lit(False))).drop("_every", "_own")


def line_applies(scope: Column, reference_camera: Column, cameras: Column, camera: Column) -> Column:
    """Whether a line holds for a camera: a camera's own line for that camera only, others for those they list, or for all where they list none."""
    listed = F.size(F.coalesce(cameras, F.array().cast("array<string>"))) == 0
    return F.when(scope == "camera", F.coalesce(reference_camera == camera, F.lit(False))).otherwise(listed | F.coalesce(F.array_contains(cameras, camera), F.lit(False)))


def line_crossings(points: DataFrame, keys: list[str], line: tuple[tuple[float, float], ...], direction: str = "both") -> DataFrame:
    """Crossings of a line's edges between a track's consecutive points, the first edge counting.

    A strict change of side over the edge's own extent is a crossing: forward from left to right. An end on the line is reported as touching.
    """
    w = Window.partitionBy(*keys).orderBy("t", "frame")
    moved = points.withColumn("before", F.lag(F.struct("x", "y", "t", "frame")).over(w)).where("before is not null")
    p, q = F.col("before"), F.struct("x", "y")
    crossing, touching = F.lit(None).cast("string"), F.lit(False)
    for (ax, ay), (bx, by) in reversed(list(zip(line, line[1:], strict=False))):
        a, b = G.point(ax, ay), G.point(bx, by)
        side_p, side_q = G.side_of_line(a, b, p), G.side_of_line(a, b, q)
        spans = G.signed_side(p, q, a) * G.signed_side(p, q, b) < 0
        cross = side_p.isin("left", "right") & side_q.isin("left", "right") & (side_p != side_q) & spans
        crossing = F.when(cross, F.when(side_p == "left", "forward").otherwise("reverse")).otherwise(crossing)
        touching = touching | (G.segment_distance(p, a, b) <= G.TOLERANCE) | (G.segment_distance(q, a, b) <= G.TOLERANCE)
    out = moved.withColumn("direction", crossing).withColumn("crossing_state", F.when(F.col("direction").isNotNull(), "crossed").when(touching, "touching").otherwise("not_crossed"))
    return out if direction == "both" else out.withColumn("crossing_state", F.when((F.col("crossing_state") == "crossed") & (F.col("direction") != direction), "not_crossed").otherwise(F.col("crossing_state")))
