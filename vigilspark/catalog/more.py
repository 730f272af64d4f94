"""Queries: lists, links, models, counters, checks of results and of stored state."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.catalog.common import query, table
from vigilspark.catalog.rules import _uuid
from vigilspark.functions import ids
from vigilspark.operators import configuration, counters, reads, rules, temporal
from vigilspark.sources import frames


def _of(names, index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def _sessions(spark, d):
    k = F.col("o_orderkey")
    status = _of(("connecting", "active", "degraded", "reconnecting", "stopped", "failed"), k % 6)
    return table(spark, d, "orders").select(k.alias("session_id"), (F.col("o_custkey") % 10).alias("camera_id"), (F.col("o_custkey") % 3).alias("venue_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))


@query("SELECT o_orderkey AS session_id, o_orderdate AS started_at FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 6 = 1 ORDER BY o_orderdate DESC, o_orderkey")
def read_sessions_of_camera(spark, d):
    return reads.of_camera(_sessions(spark, d), 3, "active").select("session_id", "started_at")


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 6 < 4")
def read_running_sessions(spark, d):
    return reads.running(_sessions(spark, d)).select("session_id")


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 6 = 5")
def read_listed(spark, d):
    return reads.listed(_sessions(spark, d), venue_id=1, camera_id=None, status="failed").select("session_id")


@query("SELECT ['connecting','active','degraded','reconnecting','stopped','failed'][o_orderkey % 6 + 1] AS status, count(*) AS n FROM orders GROUP BY 1")
def read_counts_by(spark, d):
    return reads.counts_by(_sessions(spark, d), "status")


@query("SELECT DISTINCT o_custkey % 3 AS venue_id, o_custkey % 10 AS camera_id FROM orders ORDER BY 1, 2 LIMIT 12")
def read_distinct_pairs(spark, d):
    return reads.distinct_pairs(_sessions(spark, d), ["venue_id", "camera_id"], 12)


@query("SELECT o_orderkey AS version_id, o_orderkey % 1000 AS number FROM orders WHERE o_custkey % 50 = 7 ORDER BY number")
def read_ordered_versions(spark, d):
    v = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("configuration_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 1000).alias("number"))
    return reads.ordered_versions(v, 7).select("version_id", "number")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 <> 0 AND o_orderdate <= TIMESTAMP '1995-06-17 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def read_stale_leases(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    meta = F.to_json(F.struct(_of(("extracting", "uploading", "queued"), k % 3).alias("processing_state"), F.when(k % 4 != 0, ids.lease_time(t)).alias("processing_lease_until")))
    refs = table(spark, d, "orders").select(k.alias("id"), t.alias("created_at"), meta.alias("metadata"))
    return reads.stale_leases(refs, F.lit("1995-06-17 00:00:00").cast("timestamp"), 25).select("id")


@query("""WITH r AS (SELECT event_id, event_id % 40 AS ref FROM events), x AS (SELECT ref, -ref AS known FROM range(0, 40, 3) t(ref)), f AS (SELECT r.*, x.known, min(event_id) OVER (PARTITION BY r.ref) AS first FROM r LEFT JOIN x USING (ref))
SELECT event_id, coalesce(known, first) AS linked_event_id, known IS NULL AND event_id = first AS created FROM f""")
def read_linked(spark, d):
    requests = table(spark, d, "events").select("event_id", (F.col("event_id") % 40).alias("ref_id"))
    existing = spark.range(0, 40, 3).select(F.col("id").alias("ref_id"), (-F.col("id")).alias("event_id"))
    return reads.linked(requests, existing).select("event_id", "linked_event_id", "created")


@query("""WITH q AS (SELECT p_partkey, p_partkey % 6 AS m, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS v FROM part)
SELECT p_partkey, CASE WHEN m > 3 THEN 'not_found' WHEN m > 0 AND v IS NULL THEN 'version_required' WHEN m = 0 AND coalesce(v, 1) <> 1 THEN 'version_not_found' WHEN v = 3 THEN 'version_not_found' WHEN coalesce(v, 1) = 2 OR m = 3 THEN 'unavailable' ELSE 'ok' END AS outcome FROM q""")
def read_resolved_models(spark, d):
    """Model 0 has version 1 only, models 1 to 3 have 1 (active, but not of model 3) and 2 (deprecated)."""
    k = F.col("p_partkey")
    known = spark.createDataFrame([("0", "1", "active"), *((str(m), v, "active" if v == "1" and m < 3 else "deprecated") for m in (1, 2, 3) for v in ("1", "2"))], "model_id string, version string, state string")
    requests = table(spark, d, "part").select("p_partkey", (k % 6).cast("string").alias("model_id"), F.when(k % 4 > 0, (k % 4).cast("string")).alias("version"))
    return reads.resolved_models(requests, known).select("p_partkey", "outcome")


def _camera_points(spark, d):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    n = table(spark, d, "nation")
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    refs = F.array(*(F.struct(F.lit("zone").alias("category"), F.concat(F.lit("z"), ((k + i) % 9).cast("string")).alias("profile_id")) for i in (0, 4)))
    cams = n.select((k % 3).alias("version_id"), F.lit("camera").alias("category"), F.concat(F.lit("c"), k.cast("string")).alias("profile_id"), k.alias("ord"), (k % 7).alias("camera_id"), refs.alias("refs"), ring.alias("ring"))
    zones = n.where("n_nationkey < 7").select(F.explode(F.array(*(F.lit(v).cast("long") for v in (0, 1, 2)))).alias("version_id"), F.lit("zone").alias("category"), F.concat(F.lit("z"), k.cast("string")).alias("profile_id"), k.alias("ord"), F.lit(None).cast("long").alias("camera_id"), F.slice(refs, 1, 0).alias("refs"), ring.alias("ring"))
    points = table(spark, d, "customer").select(c.alias("point_id"), (c % 3).alias("version_id"), (c % 9).alias("camera_id"))
    return configuration.camera_entities(points, cams.unionByName(zones), "zone")


_CAMERA_POINTS = """c AS (SELECT n_nationkey % 3 AS v, n_nationkey % 7 AS cam, min(n_nationkey) AS k FROM nation GROUP BY ALL),
p AS (SELECT c_custkey AS point_id, c_custkey % 9 AS cam, c.k FROM customer LEFT JOIN c ON c.v = c_custkey % 3 AND c.cam = c_custkey % 9), z AS (SELECT point_id, (k + i) % 9 AS zone FROM p, (VALUES (0), (4)) t(i) WHERE k IS NOT NULL)"""


@query(f"WITH {_CAMERA_POINTS} SELECT point_id, 'z' || zone AS profile_id FROM z WHERE zone < 7")
def config_camera_zones(spark, d):
    return _camera_points(spark, d)[0].select("point_id", "profile_id")


@query(f"WITH {_CAMERA_POINTS} SELECT point_id, 'zone_not_configured' AS error_code, 'z' || zone AS target FROM z WHERE zone >= 7 UNION ALL SELECT point_id, 'camera_not_configured', cam::VARCHAR FROM p WHERE k IS NULL")
def config_camera_errors(spark, d):
    return _camera_points(spark, d)[1]


@query(f"""SELECT n AS name, coalesce(total, 0)::BIGINT AS total, false AS unknown FROM (SELECT unnest({list(counters.STAGES)!r}) AS n) LEFT JOIN (SELECT CASE event_type WHEN 'click' THEN 'frames' WHEN 'view' THEN 'detections' WHEN 'purchase' THEN 'outbox' ELSE 'mistyped' END AS name, sum(event_id % 5) AS total FROM events GROUP BY 1) ON n = name
UNION ALL SELECT 'mistyped', sum(event_id % 5)::BIGINT, true FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') HAVING count(*) > 0""")
def agg_stage_counts(spark, d):
    name = F.when(F.col("event_type") == "click", "frames").when(F.col("event_type") == "view", "detections").when(F.col("event_type") == "purchase", "outbox").otherwise("mistyped")
    return counters.stage_counts(table(spark, d, "events").select(name.alias("name"), (F.col("event_id") % 5).alias("amount")))


@query("""WITH t AS (SELECT user_id % 6 AS s, user_id AS track, max_by(event_id % 3, event_id) AS last FROM events GROUP BY ALL) SELECT s AS session_id, count(*) AS created, count(*) FILTER (last = 2) AS ended, count(*) FILTER (last <> 2) AS active FROM t GROUP BY 1""")
def agg_tracker_counts(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 6).alias("session_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_index"), _of(("active", "lost", "terminated"), F.col("event_id") % 3).alias("track_state"))
    return counters.tracker_counts(e)


@query("""WITH l AS (SELECT user_id AS queue_id, event_id AS seq, ['put','put','put','take','drop'][event_id % 5 + 1] AS action FROM events), s AS (SELECT *, sum(CASE action WHEN 'put' THEN 1 ELSE -1 END) OVER (PARTITION BY queue_id ORDER BY seq) AS depth FROM l)
SELECT queue_id, count(*) FILTER (action = 'put') AS enqueued, count(*) FILTER (action = 'take') AS dequeued, count(*) FILTER (action = 'drop') AS dropped, max(depth)::BIGINT AS largest FROM s GROUP BY 1""")
def agg_queue_counts(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("queue_id"), F.col("event_id").alias("seq"), _of(("put", "put", "put", "take", "drop"), F.col("event_id") % 5).alias("action"))
    return counters.queue_counts(log)


def _results(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("id"), F.when(k % 13 == 0, "other").otherwise("dwell_threshold").alias("rule_id"), F.lit("v1").alias("rule_version"), F.when(k % 11 == 0, "g2").otherwise("g1").alias("config"), F.lit("g1").alias("fact_config"),
        F.col("ts").cast("timestamp").alias("event_time"), F.when(k % 17 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("ts").cast("timestamp")).alias("fact_event_time"), _of(("match", "no_match", "invalid"), k % 3).alias("status"),
        F.when(k % 6 < 2, F.concat(F.lit("e"), k.cast("string"))).alias("event_id"), F.when(k % 4 == 0, "bad").alias("reason"), F.lit("s1").alias("session"), F.when(k % 5 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("evidence_ref_id"),
    )


@query("""SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'foreign_rule' WHEN event_id % 11 = 0 THEN 'mixed_configuration' WHEN event_id % 17 = 0 THEN 'event_time_changed' WHEN event_id % 3 <> 0 AND event_id % 6 < 2 THEN 'event_without_match'
WHEN event_id % 3 = 0 AND event_id % 6 >= 2 THEN 'match_without_event' WHEN event_id % 3 = 2 AND event_id % 4 <> 0 THEN 'invalid_without_reason' END AS result_error FROM events""")
def rule_result_errors(spark, d):
    return rules.result_errors(_results(spark, d), "dwell_threshold", "v1").select("id", "result_error")


@query(f"""WITH e AS (SELECT event_id AS id, event_id % 3 = 0 AS match, CASE WHEN event_id % 6 < 2 THEN 'e' || event_id ELSE '' END AS event, CASE WHEN event_id % 5 = 0 THEN 'r' || event_id END AS own FROM events)
SELECT id, CASE WHEN match THEN coalesce(own, {_uuid("'rule_evidence|' || event || '|s1'")}) END AS required, CASE WHEN match THEN own END AS optional, CASE WHEN match AND own IS NOT NULL THEN 'evidence_forbidden' END AS forbidden FROM e""")
def rule_evidence_policies(spark, d):
    r = _results(spark, d)
    required, optional, none = (rules.with_evidence(r, p).select("id", F.col("evidence_error" if p == "none" else "evidence_ref_id").alias({"none": "forbidden"}.get(p, p))) for p in ("required", "optional", "none"))
    return required.join(optional, "id").join(none, "id")


@query("SELECT user_id, count(DISTINCT event_type) AS scopes FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def rule_scope_errors(spark, d):
    f = table(spark, d, "events").select("user_id", F.lit("t").alias("tenant"), F.lit("v").alias("venue"), F.lit("s").alias("session"), F.col("event_type").alias("camera"), F.lit("g").alias("config"))
    return rules.scope_errors(f, ["user_id"])


@query("SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 7 > 0) AS valid FROM part")
def rule_valid_definitions(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, "1.0").otherwise("v1.0").alias("rule_version"), F.when(k % 3 == 0, "").otherwise("rule").alias("rule_name"), F.array(F.lit("dwell_interval")).alias("input_fact_types"), (k % 2 == 1).alias("cooldown_enabled"), (k % 7).alias("cooldown_seconds"))
    return rules.valid_definitions(p).select("p_partkey", "valid")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'present' WHEN 1 THEN 'present' WHEN 2 THEN 'absent' WHEN 3 THEN 'not_observed' WHEN 4 THEN 'not_observed' END AS kind FROM part")
def temporal_presence_kind(spark, d):
    return table(spark, d, "part").select("p_partkey", temporal.presence_kind(_of(("inside", "ambiguous", "outside", "excluded", "privacy", "boundary"), F.col("p_partkey") % 6)).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'session_id' WHEN event_id % 5 = 0 THEN 'track_id' WHEN event_id % 7 = 0 THEN 'configuration_version_id' END AS mismatch FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0")
def temporal_foreign_observations(spark, d):
    k, s = F.col("event_id"), F.lit("a")
    key = F.struct(F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(s).alias("session_id"), F.when(k % 5 == 0, "b").otherwise(s).alias("track_id"), s.alias("camera_id"), F.when(k % 7 == 0, "b").otherwise(s).alias("configuration_version_id"))
    o = table(spark, d, "events").select("event_id", key.alias("key"), *(s.alias(c) for c in ("session_id", "track_id", "camera_id", "configuration_version_id")))
    return temporal.foreign_observations(o).select("event_id", "mismatch")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'key_not_of_scope' WHEN p_partkey % 4 <> 2 THEN 'count_differs' WHEN p_partkey % 5 = 0 THEN 'track_without_position' END AS restore_error FROM part")
def temporal_restorable(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 7 != 0, "all").alias("key_track"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("occupied"), F.array(F.lit("c"), F.lit("a"), F.when(k % 5 == 0, "d").otherwise("b")).alias("positions"), (k % 4).alias("occupancy_count"))
    return temporal.restorable(p, "all").select("p_partkey", "restore_error")


_T = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || printf('%06d', epoch_us(ts) % 1000000) END || '+00:00'"


@query(f"""SELECT event_id, {_uuid(f"'dwell|k' || user_id || '|' || {_T} || '|' || {_T} || '|f1|p1'")} AS closed, {_uuid(f"'dwell|k' || user_id || '|' || {_T} || '|f1|p1'")} AS opened, {_uuid(f"'occupancy_snapshot|k' || user_id || '|' || {_T} || '|3|src'")} AS snapshot,
{_uuid(f"'k' || user_id || '|' || event_id || '|' || {_T} || '|absent|present|present|enter_confirmed'")} AS transition, {_uuid(f"'k' || user_id || '|' || {_T} || '|' || {_T} || '|' || value::DOUBLE || '|' || (value::DOUBLE / 3) || '|' || (value::DOUBLE * 1e-7) || '|' || (value::DOUBLE * 1e15) || '|f1|p1'")} AS measurement,
{_uuid(f"'evidence_extraction|r' || event_id || '|' || {_T} || '|' || {_T}")} AS extraction, {_uuid("'evidence_package|r' || event_id || '|abc'")} AS package FROM events""")
def id_derived(spark, d):
    """Identities of intervals, snapshots, transitions, measurements, extractions and packages."""
    e, t = table(spark, d, "events"), F.col("ts").cast("timestamp")
    key, ref = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.concat(F.lit("r"), F.col("event_id").cast("string"))
    none, v = F.lit(None).cast("timestamp"), F.col("value").cast("double")
    return e.select(
        "event_id", ids.interval_id("dwell", key, t, t, "f1", "p1").alias("closed"), ids.interval_id("dwell", key, t, none, "f1", "p1").alias("opened"), ids.snapshot_id(key, t, F.lit(3), F.lit("src")).alias("snapshot"),
        ids.transition_id(key, F.col("event_id"), t, F.lit("absent"), F.lit("present"), F.lit("present"), F.lit("enter_confirmed")).alias("transition"), ids.measurement_id(key, t, t, v, v / 3, v * 1e-7, v * 1e15, "f1", "p1").alias("measurement"),
        ids.extraction_id(ref, t, t).alias("extraction"), ids.package_id(ref, F.lit("abc")).alias("package"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN -3600000000 WHEN 2 THEN 19800000000 WHEN 3 THEN 250000 END AS us FROM part""")
def id_parsed_utc(spark, d):
    """Times with an offset; naive and malformed ones are null."""
    text = _of(("1970-01-01T00:00:00Z", "1970-01-01T00:00:00+01:00", "1970-01-01 00:00:00-05:30", "1970-01-01T00:00:00.25+00:00", "1970-01-01T00:00:00", "yesterday"), F.col("p_partkey") % 6)
    return table(spark, d, "part").select("p_partkey", F.unix_micros(ids.parsed_utc(text)).alias("us"))


@query("SELECT event_id::VARCHAR AS event_id, event_type, 't' || user_id AS tenant_id, 'cam' AS camera_id, ts AS event_time FROM events WHERE event_id % 4 <> 0")
def frame_event_rows(spark, d):
    """Event rows with the scope of their fact."""
    e = table(spark, d, "events").withColumn("event_id", F.col("event_id").cast("string")).withColumn("t", F.col("ts").cast("timestamp"))
    key = F.struct(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant_id"), F.lit("v").alias("venue_id"), F.lit("s").alias("session_id"), F.lit("cam").alias("camera_id"))
    events = e.select("event_id", "event_type", F.lit("1.0").alias("schema_version"), F.col("t").alias("event_time"), F.col("t").alias("produced_at"), F.lit("c").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id"), F.lit("src").alias("source"), F.lit("{}").alias("payload"))
    return frames.event_rows(e.where("cast(event_id as long) % 4 <> 0").select("event_id", key.alias("key")), events).select("event_id", "event_type", "tenant_id", "camera_id", "event_time")


@query("""SELECT event_id::VARCHAR AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def frame_envelopes(spark, d):
    return frames.envelopes(table(spark, d, "events").select("event_id", "event_type"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_custkey % 30 AS c, o_orderkey AS n, ['published','validated','draft'][o_orderkey % 3 + 1] AS s, o_orderkey % 5 <> 0 AS same, o_orderkey % 7 <> 0 AS valid FROM orders)
SELECT id AS version_id FROM v WHERE s = 'validated' AND same AND valid AND n > (SELECT coalesce(max(n), 0) FROM v w WHERE w.c = v.c AND w.s = 'published')""")
def config_publishable(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(k.alias("version_id"), (F.col("o_custkey") % 30).alias("configuration_id"), k.alias("number"), _of(("published", "validated", "draft"), k % 3).alias("status"), F.lit("r").alias("content_revision"), F.when(k % 5 == 0, "old").otherwise("r").alias("validated_revision"))
    return configuration.publishable(v, v.select("version_id", (F.col("version_id") % 7 != 0).alias("valid"))).select("version_id")


def _camera_regions(spark, d, category):
    """Cameras of three versions that declare zones, privacy and exclusion regions, some of which are missing; customers are points."""
    k = F.col("n_nationkey")
    name = lambda kind, n: F.concat(F.lit(f"{kind}-"), n.cast("string"))
    refs = F.array(*(F.struct(F.lit(kind).alias("category"), name(kind, (k + i) % 5).alias("profile_id")) for kind, i in (("zone", 0), ("privacy_roi", 1), ("privacy_roi", 3), ("exclusion_roi", 2))))
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    n = table(spark, d, "nation")
    cams = n.select(F.lit("camera").alias("category"), (k % 3).alias("version_id"), k.cast("string").alias("camera_id"), name("camera", k).alias("profile_id"), k.alias("ord"), refs.alias("refs"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    regions = n.where("n_nationkey < 12").select(F.explode(F.array(*map(F.lit, ("zone", "privacy_roi", "exclusion_roi")))).alias("category"), (k % 3).alias("version_id"), F.lit(None).cast("string").alias("camera_id"), F.floor(k / 3).alias("m")).select(
        "category", "version_id", "camera_id", F.concat_ws("-", "category", F.col("m").cast("string")).alias("profile_id"), F.lit(0).cast("long").alias("ord"), F.when(F.lit(False), F.array(F.struct(F.lit("").alias("category"), F.lit("").alias("profile_id")))).alias("refs"), ring.alias("ring"))
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("point_id"), (c % 3).alias("version_id"), (c % 30).cast("string").alias("camera_id"))
    return configuration.camera_entities(points, cams.unionByName(regions), category)


_REGION_POINTS = """p AS (SELECT c_custkey AS point_id, c_custkey % 3 AS v, c_custkey % 30 AS cam, n_nationkey AS k FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30 AND n_nationkey % 3 = c_custkey % 3)"""


@query(f"WITH {_REGION_POINTS} SELECT point_id, 'privacy_roi-' || (k + i) % 5 AS profile_id FROM p, (VALUES (1), (3)) t(i) WHERE (k + i) % 5 < 4")
def config_camera_privacy(spark, d):
    """Privacy regions of each point's camera; no version has the fifth."""
    return _camera_regions(spark, d, "privacy_roi")[0].select("point_id", "profile_id")


@query(f"WITH {_REGION_POINTS} SELECT point_id, 'exclusion_roi-' || (k + 2) % 5 AS profile_id FROM p WHERE (k + 2) % 5 < 4")
def config_camera_exclusions(spark, d):
    return _camera_regions(spark, d, "exclusion_roi")[0].select("point_id", "profile_id")


@query(f"WITH {_REGION_POINTS} SELECT point_id, 'exclusion_roi_not_configured' AS error_code, 'exclusion_roi-4' AS target FROM p WHERE (k + 2) % 5 = 4 UNION ALL SELECT point_id, 'camera_not_configured', cam::VARCHAR FROM p WHERE k IS NULL")
def config_camera_region_errors(spark, d):
    return _camera_regions(spark, d, "exclusion_roi")[1]


@query("""SELECT event_id, (CASE WHEN event_id % 7 = 0 THEN 'missing_user,' ELSE '' END) || (CASE WHEN value < 5 THEN 'small_value,' ELSE '' END) AS codes FROM events WHERE event_id % 7 = 0 OR value < 5 UNION ALL SELECT event_id, '' FROM events WHERE event_id % 7 <> 0 AND value >= 5""")
def frame_valid_rows(spark, d):
    """Rows that pass all checks, and the others with every check that they fail."""
    e = table(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    good, bad = schemas.split_valid(e, {"missing_user": F.col("user_id").isNotNull(), "small_value": F.col("value") >= 5})
    return good.select("event_id", F.lit("").alias("codes")).unionByName(bad.select("event_id", F.concat(F.array_join("error_codes", ","), F.lit(",")).alias("codes")))


@query("""SELECT event_id, 't' AS tenant_id, 'c' || user_id AS camera_id, strftime(ts, '%Y-%m-%d') AS event_date, '{"occupancy_count":' || (event_id % 5) || ',"event_id":' || event_id || '}' AS payload FROM events""")
def frame_fact_rows(spark, d):
    """Facts as rows of the log."""
    text = lambda c: F.lit(c).cast("string")
    key = F.struct(F.lit("t").alias("tenant_id"), text(None).alias("venue_id"), text(None).alias("session_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("camera_id"), text(None).alias("configuration_version_id"), text(None).alias("track_id"), text(None).alias("semantic_context"))
    f = table(spark, d, "events").select(key.alias("key"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_id") % 5).alias("occupancy_count"), "event_id")
    rows = frames.fact_rows(f)
    return rows.select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), "tenant_id", "camera_id", F.col("event_date").cast("string").alias("event_date"), "payload")
