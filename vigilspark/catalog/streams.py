"""Queries: streams replayed from the given tables, and the sink with one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.catalog.common import HOURS, arriving, events, presence, query, table
from vigilspark.catalog.common import ORACLES as _SQL
from vigilspark.catalog.temporal import CLASSES, WAITS, classified, waiting_rows
from vigilspark.operators import temporal
from vigilspark.sources import commits
from vigilspark.streaming import stateful
from vigilspark.streaming.presence import pump

#: Triggers of a replay, and tasks that hold its state, at least: a cluster of more cores has as many.
TRIGGERS, TASKS = 3, 8


def replayed(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives for rows that arrive in several triggers, in order of arrival."""
    spark, folder = rows.sparkSession, commits.shared_folder(rows.sparkSession, "replay")
    kept = commits.stored(rows, "replay-rows")
    cuts = kept.select(F.percentile_approx("arrival", [i / TRIGGERS for i in range(1, TRIGGERS)], 1000).alias("q")).first()["q"] or []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = kept.where(F.lit(True) if low is None else F.col("arrival") > low).where(F.lit(True) if high is None else F.col("arrival") <= high)
        part.coalesce(1).write.parquet(f"{folder}/in/p{i}")
    before = {k: spark.conf.get(k, None) for k in (stateful.PROVIDER_KEY, "spark.sql.shuffle.partitions")}
    try:
        stateful.use_rocksdb(spark)
        spark.conf.set("spark.sql.shuffle.partitions", max(TASKS, spark.sparkContext.defaultParallelism))
        out = make(spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"))
        pump(out, lambda b, i: b.write.parquet(f"{folder}/out/{i}"), f"{folder}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{folder}/out/*")


@query(_SQL["temporal_presence_replay"])
def stream_presence_replay(spark, d):
    """Presence as a stream, with late, reordered and repeated rows."""
    rows = arriving(spark, d).select("track", "t", "frame", "kind", "arrival")
    return replayed(rows, lambda s: stateful.stream_presence(s, "track", HOURS)).select("track", "frame", "status", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "reason")


def _by_time(rows: DataFrame) -> DataFrame:
    """Rows that arrive by time, those of one time by frame."""
    return rows.withColumn("arrival", F.unix_micros("t") * 4096 + F.col("frame").cast("long") % 4096)


@query(_SQL["temporal_classification"])
def stream_classification(spark, d):
    m = temporal.movement(events(spark, d), ["track"]).withColumn("distance", F.round("distance", 6))
    rows = _by_time(m.select("track", "t", "frame", "distance"))
    return replayed(rows, lambda s: stateful.stream_classification(s, "track", CLASSES)).select("track", "frame", F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.col("started").alias("qualification_started"))


@query(_SQL["temporal_waiting"])
def stream_waiting(spark, d):
    rows = _by_time(waiting_rows(spark, d).select("track", "t", "frame", "presence", "movement", "context"))
    return replayed(rows, lambda s: stateful.stream_waiting(s, "track", WAITS)).select("track", "frame", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "reason", "interval_start", "interval_end")


@query(_SQL["temporal_occupancy"].replace("scope, track, t, frame, delta, occupancy_count, occupancy_count - delta AS previous_count", "scope, frame, delta::INTEGER AS delta, occupancy_count::INTEGER AS occupancy_count, (occupancy_count - delta)::INTEGER AS previous_count"))
def stream_occupancy(spark, d):
    """Occupancy as a stream of confirmed entries and exits, its state a row for each track."""
    t = presence(spark, d).where("reason <> 'observed_stay'")
    rows = _by_time(t.select("scope", "t", "frame", F.col("track").cast("string").alias("track"), F.when(F.col("reason") == "enter_confirmed", "enter").otherwise("exit").alias("change")))
    return replayed(rows, lambda s: stateful.stream_occupancy(s, "scope", HOURS)).select("scope", "frame", "delta", "occupancy_count", "previous_count")


@query("""WITH e AS (SELECT event_id::VARCHAR AS event_id, event_type FROM events) SELECT 'facts' AS "table", event_id, NULL AS detail FROM e UNION ALL SELECT 'events', event_id, event_type FROM e
UNION ALL SELECT 'audit', event_id, 'me:operational_event.persisted' FROM e UNION ALL SELECT 'outbox', event_id, 'pending:0' FROM e""")
def sink_one_commit(spark, d):
    """Events in four batches that overlap, one of them sent twice; every event is a row of each of the four tables, once."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("event_time"), F.lit("{}").alias("payload"))
    folder = commits.shared_folder(spark, "sink")
    for name, part in (("b0", "event_id % 3 = 0"), ("b1", "event_id % 2 = 0"), ("b1", "event_id % 2 = 0"), ("b2", "event_id % 3 <> 0 or event_id % 5 = 0")):
        batch = e.where(part)
        commits.persist_operational(batch.select("event_id", "event_time", F.lit(1).alias("occupancy_count")), batch, folder, "me", name)
    store, none = commits.Store(spark, folder), F.lit(None).cast("string")
    detail = {"facts": none, "events": F.col("event_type"), "audit": F.concat_ws(":", "actor", "action"), "outbox": F.concat_ws(":", "status", "attempts")}
    out = None
    for name, what in detail.items():
        rows = store.read(name).select(F.lit(name).alias("table"), "event_id", what.alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out
