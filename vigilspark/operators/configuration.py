"""Configuration validation in eight stages, over one table of entities per version.

entities: version_id, category, profile_id, ord, space, geometry_type, ring
(array of points), camera_id, status, task, priority, zone_profile_id, refs (array of
struct<category, profile_id>). Findings: version_id, stage, severity, code, profile_id, other_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.functions import geometry as G

CATEGORIES = ("camera", "zone", "table", "entrance", "privacy_roi", "exclusion_roi", "service_area", "queue_area")
POLYGONS = tuple(c for c in CATEGORIES if c not in ("camera", "entrance"))
#: Geometry spaces that a category accepts.
SPACES = {"zone": ("venue_local",), "table": ("venue_local",), "service_area": ("venue_local",), "queue_area": ("venue_local",), "entrance": ("venue_local",), "privacy_roi": ("venue_local", "image_normalized"), "exclusion_roi": ("venue_local", "image_normalized"), "camera": ("venue_local",)}
#: What unordered pairs of categories may do: overlap (allow, reject, validate), severity, whether a declared parent must contain the child, whether boundaries may touch.
POLICIES = (
    ("table", "table", "reject", "error", False, False),
    ("table", "zone", "validate", "error", True, False),
    ("queue_area", "zone", "validate", "error", True, False),
    ("service_area", "zone", "validate", "error", True, False),
    ("entrance", "zone", "allow", "error", False, True),
    ("zone", "zone", "allow", "warning", False, False),
    ("queue_area", "service_area", "allow", "warning", False, False),
    ("queue_area", "queue_area", "allow", "warning", False, False),
    ("privacy_roi", "zone", "allow", "error", False, False),
    ("privacy_roi", "table", "allow", "error", False, False),
    ("privacy_roi", "queue_area", "allow", "error", False, False),
    ("privacy_roi", "service_area", "allow", "error", False, False),
    ("privacy_roi", "entrance", "allow", "error", False, False),
    ("exclusion_roi", "zone", "allow", "error", False, False),
    ("exclusion_roi", "table", "allow", "error", False, False),
    ("exclusion_roi", "queue_area", "allow", "error", False, False),
    ("exclusion_roi", "service_area", "allow", "error", False, False),
    ("exclusion_roi", "entrance", "allow", "error", False, False),
    ("privacy_roi", "exclusion_roi", "validate", "error", False, False),
    ("camera", "zone", "allow", "warning", False, False),
)
FINDING = ("version_id", "stage", "severity", "code", "profile_id", "other_id")


def _found(df: DataFrame, stage: str, severity: str | Column, code: str | Column, other: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("version_id", F.lit(stage).alias("stage"), lit(severity).alias("severity"), lit(code).alias("code"), F.col("profile_id"), (other if other is not None else F.lit(None)).cast("string").alias("other_id"))


def structural(e: DataFrame) -> DataFrame:
    """Duplicate or blank profile ids within a category, and versions without cameras."""
    again = e.groupBy("version_id", "category", "profile_id").count().where("count > 1")
    blank = e.where("profile_id is null or trim(profile_id) = ''")
    none = e.groupBy("version_id").agg(F.count_if(F.col("category") == "camera").alias("n")).where("n = 0").withColumn("profile_id", F.lit(None).cast("string"))
    return _found(again, "structural", "error", "duplicate_profile_id", F.col("category")).unionByName(_found(blank, "structural", "error", "blank_profile_id", F.col("category"))).unionByName(_found(none, "structural", "error", "no_cameras"))


def references(e: DataFrame) -> DataFrame:
    """References to entities that the version lacks."""
    refs = e.select("version_id", "profile_id", F.explode("refs").alias("r")).select("version_id", "profile_id", F.col("r.category").alias("category"), F.col("r.profile_id").alias("target"))
    known = e.select("version_id", "category", F.col("profile_id").alias("target")).distinct()
    return _found(refs.join(known, ["version_id", "category", "target"], "left_anti"), "reference", "error", F.concat(F.lit("dangling_"), F.col("category")), F.col("target"))


def coordinates(e: DataFrame) -> DataFrame:
    """Points outside of their space, and image geometry that names no camera."""
    shaped = e.where("ring is not null")
    bad = shaped.where(~F.forall("ring", lambda p: F.coalesce(G.valid_coordinate(p["x"], p["y"], F.col("space")), F.lit(False))))
    homeless = shaped.where("space = 'image_normalized' and camera_id is null")
    return _found(bad, "coordinate", "error", "out_of_bounds").unionByName(_found(homeless, "coordinate", "error", "missing_camera"))


def geometry(e: DataFrame) -> DataFrame:
    """The first failing check of each polygon or line: contract, ring, closure, crossing; cameras are not examined."""
    space_ok = F.lit(True)
    for c, spaces in SPACES.items():
        space_ok = F.when(F.col("category") == c, F.col("space").isin(*spaces)).otherwise(space_ok)
    ring = F.col("ring")
    entrance = F.col("category") == "entrance"
    polygon = F.col("category").isin(*POLYGONS) | (entrance & (F.col("geometry_type") == "polygon"))
    code = (
        F.when(~space_ok, "wrong_space").when(~F.when(entrance, F.col("geometry_type").isin("linestring", "polygon")).otherwise(F.col("geometry_type") == "polygon"), "wrong_type")
        .when(entrance & (F.col("geometry_type") == "linestring") & ~G.valid_line(ring), "bad_line").when(polygon & ~G.is_closed(ring), "not_closed").when(polygon & ~G.valid_ring(ring), "degenerate").when(polygon & G.self_intersecting(ring), "self_intersecting")
    )
    return _found(e.where("category <> 'camera' and ring is not null").withColumn("code", code).where("code is not null"), "geometry", "error", F.col("code"))


def policies(spark: SparkSession) -> DataFrame:
    """The policies of pairs as rows."""
    return spark.createDataFrame(list(POLICIES), "category string, other_category string, overlap string, severity string, containment boolean, touch boolean")


def spatial(e: DataFrame) -> DataFrame:
    """Pairs of polygons of one version and space whose meaningful overlap a policy rejects.

    Only categories of such policies are paired and clipped. A self-join by version and space: a venue's version holds
    tens of polygons, so its pairs are few however many versions there are.
    """
    rejected = [(a, b) for a, b, overlap, *_ in POLICIES if overlap == "reject"]
    p = e.where(F.col("category").isin(*sorted({c for pair in rejected for c in pair})) & (F.col("geometry_type") == "polygon")).select("version_id", "space", "category", "profile_id", "ord", "ring")
    q = p.select("version_id", "space", *(F.col(c).alias(f"{c}_2") for c in ("category", "profile_id", "ord", "ring")))
    wanted = reduce(lambda x, y: x | y, (F.least("category", "category_2").eqNullSafe(min(pair)) & F.greatest("category", "category_2").eqNullSafe(max(pair)) for pair in rejected))
    hit = p.join(q, ["version_id", "space"]).where(F.struct("category", "ord", "profile_id") < F.struct("category_2", "ord_2", "profile_id_2")).where(wanted).where(G.meaningful_overlap(F.col("ring"), F.col("ring_2")))
    code = F.when((F.col("category") == "table") & (F.col("category_2") == "table"), "table_overlap").otherwise("invalid_spatial_relationship")
    return _found(hit, "spatial", "error", code, F.col("profile_id_2"))


def containment(e: DataFrame) -> DataFrame:
    """Entities that name a zone (zone_profile_id), have to lie in it by policy, and do not."""
    children = [a for a, b, _, _, contained, _ in POLICIES if contained and b == "zone"]
    zones = e.where("category = 'zone' and geometry_type = 'polygon'").select("version_id", F.col("profile_id").alias("zone_profile_id"), F.col("ring").alias("zone_ring"))
    own = e.where(F.col("zone_profile_id").isNotNull() & F.col("category").isin(*children))
    return _found(own.join(zones, ["version_id", "zone_profile_id"]).where(~G.contains(F.col("zone_ring"), F.col("ring"))), "spatial", "error", "invalid_containment", F.col("zone_profile_id"))


def waiting_contexts(entities: DataFrame) -> DataFrame:
    """version_id and profile_id of what a version declares as a place to wait: queue areas, service areas, and zones of that type (zone_type)."""
    return entities.where(F.col("category").isin("queue_area", "service_area") | ((F.col("category") == "zone") & (F.col("zone_type") == "waiting_area"))).select("version_id", "profile_id").distinct()


def camera_entities(points: DataFrame, entities: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """The entities of a category that each point's camera declares (point_id, version_id, camera_id, profile_id, ring), and errors (point_id, error_code, target): cameras that the version lacks, and declared entities that it lacks.

    Of a camera_id's cameras the first by ord counts.
    """
    cams = entities.where("category = 'camera'").groupBy("version_id", "camera_id").agg(F.min_by("refs", F.struct("ord", "profile_id")).alias("refs"))
    at = points.select("point_id", "version_id", "camera_id").join(cams, ["version_id", "camera_id"], "left")
    lost = at.where("refs is null").select("point_id", F.lit("camera_not_configured").alias("error_code"), F.col("camera_id").cast("string").alias("target"))
    declared = at.select("point_id", "version_id", "camera_id", F.explode("refs").alias("r")).where(F.col("r.category") == category).select("point_id", "version_id", "camera_id", F.col("r.profile_id").alias("profile_id"))
    own = entities.where(F.col("category") == category).select("version_id", "profile_id", "ring")
    missing = declared.join(own, ["version_id", "profile_id"], "left_anti").select("point_id", F.lit(f"{category}_not_configured").alias("error_code"), F.col("profile_id").alias("target"))
    return declared.join(own, ["version_id", "profile_id"]), lost.unionByName(missing)


def cameras(e: DataFrame) -> DataFrame:
    """Cameras that are not active, or cover no zone."""
    c = e.where("category = 'camera'")
    covers = F.exists("refs", lambda r: r["category"] == "zone")
    return _found(c.where("status <> 'active'"), "camera", "error", "camera_not_active").unionByName(_found(c.where(~covers), "camera", "warning", "no_zone_covered"))


def privacy(e: DataFrame) -> DataFrame:
    """Cameras whose privacy regions ask for different actions, and privacy and exclusion regions of one camera, space and task."""
    p = e.where("category = 'privacy_roi'").withColumn("camera", F.coalesce("camera_id", F.lit("*")))
    x = e.where("category = 'exclusion_roi'").select("version_id", F.coalesce("camera_id", F.lit("*")).alias("camera"), "space", F.col("profile_id").alias("other"), F.col("task").alias("excluded_task"))
    mixed = p.groupBy("version_id", "camera").agg(F.size(F.collect_set("status")).alias("n")).where("n > 1").withColumnRenamed("camera", "profile_id")
    both = p.join(x, ["version_id", "camera", "space"]).where("task = excluded_task")
    return _found(mixed, "privacy", "error", "mixed_actions").unionByName(_found(both, "privacy", "warning", "privacy_exclusion_conflict", F.col("other")))


def compatibility(e: DataFrame) -> DataFrame:
    """Zones that no camera covers."""
    covered = e.where("category = 'camera'").select("version_id", F.explode("refs").alias("r")).where("r.category = 'zone'").select("version_id", F.col("r.profile_id").alias("profile_id")).distinct()
    return _found(e.where("category = 'zone'").join(covered, ["version_id", "profile_id"], "left_anti"), "compatibility", "warning", "zone_not_covered")


STAGES = (structural, references, coordinates, geometry, spatial, containment, cameras, privacy, compatibility)


def validate(entities: DataFrame) -> DataFrame:
    """All findings; the spatial stage is left out for versions that failed by reference or geometry."""
    parts = {s.__name__: s(entities) for s in STAGES}
    broken = parts["references"].unionByName(parts["geometry"]).select("version_id").distinct()
    for name in ("spatial", "containment"):
        parts[name] = parts[name].join(broken, "version_id", "left_anti").select(*FINDING)
    return reduce(DataFrame.unionByName, parts.values())


def summary(findings: DataFrame, versions: DataFrame) -> DataFrame:
    """errors, warnings and valid of every version."""
    n = findings.groupBy("version_id").agg(F.count_if(F.col("severity").isin("error", "critical")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = versions.select("version_id").join(n, "version_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("valid", F.col("errors") == 0)


def publishable(versions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Versions that may be published: valid, unchanged since validation, and newer than all published ones of their configuration."""
    top = F.max(F.when(F.col("status") == "published", F.col("number"))).over(Window.partitionBy("configuration_id"))
    return versions.withColumn("_top", F.coalesce(top, F.lit(0))).join(verdicts.where("valid").select("version_id"), "version_id", "left_semi").where("status = 'validated' and validated_revision = content_revision and number > _top").drop("_top")


def nested(entities: DataFrame) -> DataFrame:
    """One row per version with an array of entities for each category."""
    e = entities.withColumn("entity", F.struct("profile_id", "ord", "space", "geometry_type", "ring", "camera_id", "status", "task", "refs"))
    return e.groupBy("version_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("entity")))).alias(f"{c}s") for c in CATEGORIES))


def entities_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Entities from literal rows, for tests and small configurations."""
    return spark.createDataFrame(rows, "version_id string, category string, profile_id string, ord int, space string, geometry_type string, ring array<struct<x:double,y:double>>, camera_id string, status string, task string, priority int, zone_profile_id string, refs array<struct<category:string,profile_id:string>>")
