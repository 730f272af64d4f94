"""Queries: rules, data quality, evidence requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import EVENTS, HOURS, PRESENCE, events, presence, query
from vigilspark.catalog.temporal import DWELL, OCCUPANCY
from vigilspark.operators import rules, temporal

REGISTRY = rules.default_registry()


def _scoped(df, track="track"):
    """Identity columns: one tenant, venue and configuration, the scope as camera."""
    return df.withColumns({"tenant": F.lit("t1"), "venue": F.lit("v1"), "session": F.lit("s1"), "camera": F.concat(F.lit("cam"), F.col("scope").cast("string")), "track": F.col(track).cast("string"), "config": F.lit("cfg1")})


@query(f"""WITH RECURSIVE {PRESENCE}, {OCCUPANCY} SELECT scope, frame, CASE WHEN occupancy_count > 0 THEN 'started' ELSE 'ended' END AS phase,
  CASE WHEN occupancy_count > 0 THEN 'started' ELSE 'ended' END = 'started' AS opens FROM occupancy WHERE (occupancy_count - delta = 0 AND occupancy_count > 0) OR (occupancy_count - delta > 0 AND occupancy_count = 0)""")
def rule_occupancy_session(spark, d):
    s = _scoped(temporal.occupancy(presence(spark, d), ["scope"]).withColumn("event_time", F.col("t")).withColumn("context", F.lit(None).cast("string")))
    out = REGISTRY.evaluate("occupancy_session", "v1", s, {})
    return out.where("status = 'match'").select("scope", "frame", "phase", (F.col("phase") == "started").alias("opens"))


def dwell_facts(spark, d):
    i = temporal.dwell(presence(spark, d), ["track", "scope"], HOURS)
    return _scoped(i.withColumns({"event_time": F.col("dwell_last"), "last_seen": F.col("dwell_last"), "interval_start": F.col("dwell_start"), "interval_end": F.col("dwell_end"), "context": F.concat(F.lit("area"), (F.col("track") % 4).cast("string")), "first_occupancy": (F.col("track") % 3).cast("int")}))


_FACTS = f"""{PRESENCE}, {DWELL}, facts AS (SELECT track, scope, ordinal, 'area' || (track % 4) AS context, track % 3 AS first_occupancy, dwell_start, dwell_end, coalesce(dwell_end, seen) AS last,
  (epoch_us(coalesce(dwell_end, seen)) - epoch_us(dwell_start)) / 1e6 AS secs FROM dwell)"""
_ISO = "strftime(last, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(last) % 1000000 = 0 THEN '' ELSE '.' || printf('%06d', epoch_us(last) % 1000000) END || '+00:00'"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab89ab89ab89ab')[position(h[17] IN '0123456789abcdef')] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


def _rule_sql(rule: str, version: str, condition: str, event: str) -> str:
    name = f"'rule_event|t1|v1|s1|cam' || scope || '|' || track || '|' || context || '|{rule}|{version}|{event}|' || {_ISO} || '|cfg1'"
    return f"WITH RECURSIVE {_FACTS}, m AS (SELECT *, {condition} AS hit FROM facts) SELECT track::VARCHAR AS track, ordinal, CASE WHEN hit THEN 'match' ELSE 'no_match' END AS status, CASE WHEN hit THEN {_uuid(name)} END AS event_id FROM m"


def _rule(rule: str, version: str, config: dict):
    def run(spark, d):
        return REGISTRY.evaluate(rule, version, dwell_facts(spark, d), config).select("track", "ordinal", "status", "event_id")

    return run


for _name, _r, _v, _config, _where, _event in (
    ("rule_dwell_threshold", "dwell_threshold", "v1", {"dwell_threshold_seconds": 36000}, "secs >= 36000", "dwell_threshold_exceeded"),
    ("rule_queue_candidate", "queue_candidate", "v1", {"waiting_qualification_seconds": 36000, "queue_area_ids": ["area1", "area2"]}, "secs >= 36000 AND context IN ('area1','area2')", "queue_candidate"),
    ("rule_queue_candidate_v2", "queue_candidate", "v2", {"waiting_qualification_seconds": 7200, "queue_area_ids": ["area3"], "queue_max_length": 5}, "secs >= 7200 AND context = 'area3'", "queue_candidate"),
    ("rule_service_gap", "service_gap_candidate", "v1", {"service_gap_grace_seconds": 7200, "service_area_ids": ["area0", "area1"]}, "secs >= 7200 AND dwell_end IS NULL AND context IN ('area0','area1')", "service_gap_candidate"),
    ("rule_turnover_delay", "turnover_delay", "v1", {"turnover_delay_seconds": 3600, "service_window_seconds": 7200}, "secs >= 10800 AND dwell_end IS NULL AND first_occupancy > 0", "turnover_delay"),
):
    query(_rule_sql(_r, _v, _where, _event), _name)(_rule(_r, _v, _config))


@query(f"""WITH RECURSIVE {_FACTS} SELECT track::VARCHAR AS track, ordinal, dwell_start AS start_time, last AS end_time FROM facts WHERE secs >= 36000""")
def evidence_requests(spark, d):
    m = REGISTRY.evaluate("dwell_threshold", "v1", dwell_facts(spark, d), {"dwell_threshold_seconds": 36000})
    return rules.evidence_requests(m).join(m.select("event_id", "track", "ordinal"), "event_id").select("track", "ordinal", "start_time", "end_time")


@query(f"""WITH {EVENTS}, f AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE track END AS track, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'cfg1' END AS config,
  CASE WHEN event_id % 19 = 0 THEN -1.0 ELSE value END AS secs, 'c' || (event_id % 4) AS context, CASE WHEN event_id % 23 = 0 THEN 'cfg2' ELSE 'cfg1' END AS evaluation FROM obs),
x AS (SELECT event_id, list_sort(list_filter([CASE WHEN track IS NULL THEN 'DATA_MISSING_IDENTITY' END, CASE WHEN secs < 0 THEN 'DATA_NEGATIVE_DURATION' END, CASE WHEN secs < 5 THEN 'DATA_INCONSISTENT' END,
  CASE WHEN config IS NULL THEN 'DATA_INVALID_PROVENANCE' END, CASE WHEN context NOT IN ('c0','c1','c2') THEN 'DATA_UNKNOWN_CONTEXT' END, CASE WHEN config <> evaluation THEN 'DATA_CONFIG_MISMATCH' END], lambda z: z IS NOT NULL)) AS f FROM f)
SELECT event_id, array_to_string(f, ',') AS findings, CASE WHEN list_contains(f, 'DATA_CONFIG_MISMATCH') THEN 'critical' WHEN list_has_any(f, ['DATA_MISSING_IDENTITY','DATA_NEGATIVE_DURATION','DATA_INCONSISTENT']) THEN 'error' WHEN len(f) > 0 THEN 'warning' END AS severity FROM x""")
def rule_data_quality(spark, d):
    i = F.col("event_id")
    none = F.lit(None)
    f = events(spark, d).select(
        "event_id", F.when(i % 13 != 0, F.col("track").cast("string")).alias("track"), F.lit("cam").alias("camera"), F.col("t").alias("event_time"), F.col("t").alias("last_seen"), F.when(i % 17 != 0, "cfg1").alias("config"),
        F.when(i % 19 == 0, -1.0).otherwise(F.col("value")).alias("duration_seconds"), F.concat(F.lit("c"), (i % 4).cast("string")).alias("context"), F.when(i % 23 == 0, "cfg2").otherwise("cfg1").alias("evaluation_config"),
        none.cast("timestamp").alias("interval_start"), none.cast("timestamp").alias("interval_end"), none.cast("timestamp").alias("previous_event_time"), none.cast("double").alias("time_delta_seconds"),
        F.lit(True).alias("qualified"), F.lit(5.0).alias("minimum_seconds"), none.cast("int").alias("previous_count"), none.cast("int").alias("delta"), none.cast("int").alias("occupancy_count"), F.lit("1").alias("fsm_version"), F.lit("r1").alias("policy_revision"),
    )
    out = rules.data_quality(f, {"known_spatial_contexts": ["c0", "c1", "c2"]})
    return out.select("event_id", F.array_join("findings", ",").alias("findings"), "severity")


#: Six rules: id, version, configuration, fact type, and the condition, event type and findings in SQL.
_MANY = (
    ("dwell_threshold", "v1", {"dwell_threshold_seconds": 36000}, "dwell_interval", "secs >= 36000", "dwell_threshold_exceeded"),
    ("turnover_delay", "v1", {"turnover_delay_seconds": 3600, "service_window_seconds": 7200}, "dwell_interval", "secs >= 10800 AND dwell_end IS NULL AND first_occupancy > 0", "turnover_delay"),
    ("queue_candidate", "v1", {"waiting_qualification_seconds": 36000, "queue_area_ids": ["area1", "area2"]}, "waiting_interval", "secs >= 36000 AND context IN ('area1','area2')", "queue_candidate"),
    ("queue_candidate", "v2", {"waiting_qualification_seconds": 7200, "queue_area_ids": ["area3"], "queue_max_length": 5}, "waiting_interval", "secs >= 7200 AND context = 'area3'", "queue_candidate"),
    ("service_gap_candidate", "v1", {"service_gap_grace_seconds": 7200, "service_area_ids": ["area0", "area1"]}, "waiting_interval", "secs >= 7200 AND dwell_end IS NULL AND context IN ('area0','area1')", "service_gap_candidate"),
    ("data_quality", "v1", {"known_spatial_contexts": ["area0", "area1", "area2"]}, "any", "context = 'area3' OR config IS NULL", "data_quality"),
)
_FOUND = "array_to_string(list_filter([CASE WHEN config IS NULL THEN 'DATA_INVALID_PROVENANCE' END, CASE WHEN context = 'area3' THEN 'DATA_UNKNOWN_CONTEXT' END], lambda z: z IS NOT NULL), ',')"


def _many_sql() -> str:
    parts = []
    for rule, version, _, kind, hit, event in _MANY:
        name = f"'rule_event|t1|v1|s1|cam' || scope || '|' || track || '|' || context || '|{rule}|{version}|{event}|' || {_ISO} || '|' || coalesce(config, '')"
        bad = "false" if kind == "any" else "config IS NULL"
        status = f"CASE WHEN {bad} THEN 'invalid' WHEN {hit} THEN 'match' ELSE 'no_match' END"
        parts.append(f"SELECT track::VARCHAR AS track, ordinal, '{rule}' AS rule_id, '{version}' AS rule_version, {status} AS status, CASE WHEN {bad} THEN 'missing_scope' END AS reason, CASE WHEN {status} = 'match' THEN {_uuid(name)} END AS event_id, {_FOUND if kind == 'any' else 'NULL'} AS findings FROM many" + ("" if kind == "any" else f" WHERE fact_type = '{kind}'"))
    return f"WITH RECURSIVE {_FACTS}, many AS (SELECT *, CASE WHEN (track + ordinal) % 2 = 0 THEN 'dwell_interval' ELSE 'waiting_interval' END AS fact_type, CASE WHEN (track + ordinal) % 7 <> 0 THEN 'cfg1' END AS config FROM facts) " + " UNION ALL ".join(parts)


@query(_many_sql())
def rule_engine(spark, d):
    """Six rules over dwell and waiting facts in one pass over the facts."""
    even = (F.col("track").cast("long") + F.col("ordinal")) % 2 == 0
    none = {"previous_event_time": "timestamp", "time_delta_seconds": "double", "qualified": "boolean", "minimum_seconds": "double", "previous_count": "int", "delta": "int", "occupancy_count": "int"}
    f = dwell_facts(spark, d).withColumn("fact_type", F.when(even, "dwell_interval").otherwise("waiting_interval")).withColumn("config", F.when((F.col("track").cast("long") + F.col("ordinal")) % 7 != 0, F.col("config")))
    f = f.drop(*none).withColumns({k: F.lit(None).cast(t) for k, t in none.items()} | {"fsm_version": F.lit("1"), "policy_revision": F.lit("r1"), "evaluation_config": F.col("config")})
    out = REGISTRY.evaluate_all(f, [m[:3] for m in _MANY], ("track", "ordinal"))
    return out.select("track", "ordinal", "rule_id", "rule_version", "status", "reason", "event_id", F.col("details")["findings"].alias("findings"))


@query(f"""WITH RECURSIVE {_FACTS} SELECT track::VARCHAR AS track, min(last) AS first_match FROM facts WHERE secs >= 36000 GROUP BY track""")
def rule_first_matches(spark, d):
    """The first match of each track's repeated ones."""
    m = REGISTRY.evaluate("dwell_threshold", "v1", dwell_facts(spark, d), {"dwell_threshold_seconds": 36000})
    return rules.first_match_per_interval(m, ["track"]).select("track", F.col("event_time").alias("first_match"))
