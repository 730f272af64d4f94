"""Counters of stages, trackers and queues: as aggregations, or observed while a job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Names that a stage may count under.
STAGES = ("frames", "detections", "tracks", "spatial", "temporal", "events", "outbox", "evidence_requested", "evidence_extracted", "evidence_uploaded", "evidence_finalized", "evidence_retried", "evidence_failed", "evidence_expired", "evidence_recovered")


def stage_counts(records: DataFrame, known: tuple[str, ...] = STAGES) -> DataFrame:
    """Sums of amount by name of records (name, amount), with zero for names that did not occur; unknown names are kept as errors."""
    names = records.sparkSession.createDataFrame([(n,) for n in known], "name string")
    sums = records.groupBy("name").agg(F.sum("amount").alias("total"))
    all_ = names.withColumn("_known", F.lit(True)).join(sums, "name", "full")
    return all_.select("name", F.coalesce("total", F.lit(0)).alias("total"), F.col("_known").isNull().alias("unknown"))


def tracker_counts(lifecycle: DataFrame) -> DataFrame:
    """Tracks created, ended and active of each session, from rows (session_id, track_id, frame_index, track_state)."""
    tracks = lifecycle.groupBy("session_id", "track_id").agg(F.max_by("track_state", "frame_index").alias("last"))
    return tracks.groupBy("session_id").agg(F.count("*").alias("created"), F.count_if(F.col("last") == "terminated").alias("ended"), F.count_if(F.col("last") != "terminated").alias("active"))


def queue_counts(log: DataFrame) -> DataFrame:
    """Frames put in, taken out and dropped, and the largest depth, of each queue, from its log (queue_id, seq, action: put, take or drop)."""
    from pyspark.sql import Window

    step = F.when(F.col("action") == "put", 1).when(F.col("action").isin("take", "drop"), -1).otherwise(0)
    depth = log.withColumn("_depth", F.sum(step).over(Window.partitionBy("queue_id").orderBy("seq")))
    n = lambda a: F.count_if(F.col("action") == a)
    return depth.groupBy("queue_id").agg(n("put").alias("enqueued"), n("take").alias("dequeued"), n("drop").alias("dropped"), F.max("_depth").alias("largest"))


def observed(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, whose rows are counted under each condition while whatever job runs over it; the observation has the counts then."""
    seen = Observation(name)
    return df.observe(seen, *(F.count_if(c).alias(k) for k, c in conditions.items())), seen
