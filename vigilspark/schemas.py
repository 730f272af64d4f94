"""Record contracts as DDL, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

SCHEMA_VERSIONS = ("1.0",)
BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
POINT = "struct<x:double,y:double,coordinate_space:string,policy:string>"
KEY = "struct<fsm_kind:string,tenant_id:string,venue_id:string,session_id:string,camera_id:string,configuration_version_id:string,track_id:string,semantic_context:string>"
CONTRACTS = {
    "frame_packet": "frame_id string, session_id string, schema_version string, frame_index int, event_time timestamp, width int, height int, source_ref string",
    "detection_observation": f"detection_id string, frame_id string, schema_version string, class_name string, confidence double, bounding_box {BOX}, event_time timestamp, session_id string, source_ref string, frame_index int, class_id int, image_width int, image_height int, detector_metadata map<string,string>",
    "track_observation": "track_id string, detection_id string, frame_id string, session_id string, schema_version string, event_time timestamp, track_state string, tracking_metadata map<string,string>",
    "spatial_observation": f"session_id string, track_id string, frame_id string, event_time timestamp, camera_id string, configuration_version_id string, spatial_point {POINT}, status string, zone_profile_id string, table_profile_id string, engine_version string",
    "temporal_transition": f"transition_id string, key {KEY}, from_state string, to_state string, event_kind string, reason string, observation_frame_id string, event_time timestamp, processing_time timestamp, configuration_version_id string, fsm_version string",
    "dwell_interval": f"interval_id string, key {KEY}, dwell_start timestamp, dwell_end timestamp, last_seen timestamp, duration_seconds double, qualified boolean, minimum_dwell_seconds double, reason string, policy_revision string",
    "occupancy_snapshot": f"snapshot_id string, key {KEY}, event_time timestamp, previous_count int, delta int, occupancy_count int, occupied_tracks array<string>, source_transition_id string, policy_revision string",
    "movement_measurement": f"measurement_id string, key {KEY}, previous_event_time timestamp, event_time timestamp, distance double, time_delta_seconds double, policy_revision string",
    "waiting_interval": f"interval_id string, key {KEY}, waiting_start timestamp, waiting_end timestamp, last_seen timestamp, duration_seconds double, qualified boolean, minimum_waiting_seconds double, reason string, policy_revision string",
    "event_envelope": "event_id string, event_type string, schema_version string, event_time timestamp, produced_at timestamp, correlation_id string, causation_id string, source string, payload string",
}


def contract(name: str) -> StructType:
    return _parse_datatype_string(CONTRACTS[name])


def assert_contract(df: DataFrame, name: str, optional: frozenset[str] = frozenset()) -> DataFrame:
    """df with the contract's columns in order; unknown columns and wrong types are errors."""
    want = {f.name: f.dataType for f in contract(name)}
    have = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
    if extra := sorted(set(have) - set(want)):
        raise ValueError(f"{name}: unknown columns {extra}")
    if missing := sorted(set(want) - set(have) - optional):
        raise ValueError(f"{name}: missing columns {missing}")
    if wrong := sorted(c for c, t in have.items() if t.simpleString() != want[c].simpleString()):
        raise ValueError(f"{name}: wrong types of {wrong}")
    return df.select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in want.items()))


def split_valid(df: DataFrame, checks: dict) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks (error code -> Column that holds when valid), and the rest with error_codes."""
    errors = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items())), lambda x: x.isNotNull())
    marked = df.withColumn("error_codes", errors)
    return marked.where(F.size("error_codes") == 0).drop("error_codes"), marked.where(F.size("error_codes") > 0)
