"""Registry of queries, and projections of the driver's tables onto the engine's contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.plans.machines import Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Events of one user are hours apart, so durations are hours here.
HOURS = Policy(reorder_window=6 * 3600, entry_confirmation=2, exit_confirmation=2, minimum_dwell=2 * 3600, exit_grace=4 * 3600, occlusion_tolerance=12 * 3600)


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: track, scope, t, frame, kind, x, y."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "present").when(F.col("event_type") == "signup", "absent").otherwise("not_observed")
    return e.select(
        F.col("user_id").alias("track"), (F.col("user_id") % 5).alias("scope"), F.col("ts").cast("timestamp").alias("t"), F.format_string("%012d", "event_id").alias("frame"), kind.alias("kind"),
        (F.col("event_id") * 37 % 100 / 100).alias("x"), (F.col("event_id") * 53 % 100 / 100).alias("y"), "event_id", "value",
    )


#: The same in SQL.
EVENTS = """obs AS (SELECT user_id AS track, user_id % 5 AS scope, ts AS t, printf('%012d', event_id) AS frame,
  CASE WHEN event_type IN ('click','view','purchase') THEN 'present' WHEN event_type = 'signup' THEN 'absent' ELSE 'not_observed' END AS kind,
  (event_id * 37 % 100) / 100.0::DOUBLE AS x, (event_id * 53 % 100) / 100.0::DOUBLE AS y, event_id, value FROM events)"""


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in an order of arrival with late rows, and some rows twice."""
    o = events(spark, sf_dir)
    late = o.withColumn("arrival", F.col("event_id") * 2 + F.when(F.col("event_id") % 7 == 0, 4000).when(F.col("event_id") % 5 == 0, 400).otherwise(0))
    return late.unionByName(late.where("event_id % 11 = 0").withColumn("arrival", F.col("arrival") + 1))


ARRIVING = """late AS (SELECT *, event_id * 2 + CASE WHEN event_id % 7 = 0 THEN 4000 WHEN event_id % 5 = 0 THEN 400 ELSE 0 END AS arrival FROM obs),
arriving AS (SELECT * FROM late UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM late WHERE event_id % 11 = 0)"""

#: Presence under HOURS, by the decision table: one recursion step per row of a track. Hours are micros here.
_H = 3_600_000_000
PRESENCE_OF = f"""n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, frame) AS rn, epoch_us(t) AS us FROM {{rows}}),
walk AS (
  SELECT track, rn, 'absent' AS f, CASE WHEN kind = 'present' THEN 'entering' ELSE 'absent' END AS s, 'observed_stay' AS reason,
    CASE WHEN kind = 'present' THEN us END AS since, CASE WHEN kind = 'present' THEN us END AS seen,
    CASE WHEN kind = 'present' THEN 1 ELSE 0 END AS en, 0 AS ex FROM n WHERE rn = 1
  UNION ALL
  SELECT track, rn, s, s2, reason, CASE WHEN s2 <> s THEN us ELSE since END, CASE WHEN kind = 'present' THEN us ELSE seen END,
    CASE WHEN s2 = 'entering' THEN en + 1 ELSE 0 END, CASE WHEN s2 = 'exiting' THEN ex + 1 ELSE 0 END FROM (
    SELECT *, CASE
      WHEN kind = 'present' AND s IN ('present', 'exiting') THEN 'present'
      WHEN kind = 'present' AND s = 'entering' THEN 'present'
      WHEN kind = 'present' THEN 'entering'
      WHEN s IN ('absent', 'entering') THEN 'absent'
      WHEN s = 'exiting' THEN CASE WHEN ex + 1 >= 2 THEN 'absent' ELSE 'exiting' END
      WHEN kind = 'absent' THEN CASE WHEN us - since >= {2 * _H} AND us - seen >= {4 * _H} THEN 'exiting' ELSE 'present' END
      ELSE CASE WHEN us - since >= {2 * _H} AND us - seen >= {12 * _H} THEN 'absent' ELSE 'present' END END AS s2,
    CASE WHEN kind = 'present' AND s = 'entering' THEN 'enter_confirmed'
      WHEN kind <> 'present' AND s = 'exiting' AND ex + 1 >= 2 THEN 'exit_confirmed'
      WHEN kind = 'not_observed' AND s = 'present' AND us - since >= {2 * _H} AND us - seen >= {12 * _H} THEN 'missing_expired'
      ELSE 'observed_stay' END AS reason
    FROM (SELECT n.track, n.rn, n.kind, n.us, w.s, w.since, w.seen, w.en, w.ex FROM walk w JOIN n ON n.track = w.track AND n.rn = w.rn + 1) j) k),
presence AS (SELECT n.track, n.scope, n.t, n.frame, w.f AS from_state, w.s AS to_state, w.reason FROM walk w JOIN n USING (track, rn))"""
PRESENCE = f"{EVENTS}, {PRESENCE_OF.format(rows='obs')}"


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.operators import temporal

    o = events(spark, sf_dir)
    return temporal.presence(o.select("track", "scope", "t", "frame", "kind"), ["track", "scope"], HOURS)
