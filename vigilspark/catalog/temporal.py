"""Queries: presence, dwell, occupancy, movement, classification, waiting, order of arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import ORACLES, ARRIVING, EVENTS, HOURS, PRESENCE, PRESENCE_OF, arriving, events, presence, query
from vigilspark.operators import temporal
from vigilspark.plans.machines import Policy


@query(f"WITH RECURSIVE {PRESENCE} SELECT track, frame, from_state, to_state, reason FROM presence")
def temporal_presence(spark, d):
    return presence(spark, d).select("track", "frame", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "reason")


DWELL = """marked AS (SELECT *, count(*) FILTER (reason = 'enter_confirmed') OVER (PARTITION BY track ORDER BY t, frame) AS ordinal FROM presence),
dwell AS (SELECT track, scope, ordinal, min(t) FILTER (reason = 'enter_confirmed') AS dwell_start, min(t) FILTER (reason IN ('exit_confirmed','missing_expired')) AS dwell_end,
  max(t) AS seen, min_by(reason, t) FILTER (reason IN ('exit_confirmed','missing_expired')) AS reason FROM marked WHERE ordinal > 0 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {PRESENCE}, {DWELL} SELECT track, ordinal, dwell_start, dwell_end, reason, (epoch_us(coalesce(dwell_end, seen)) - epoch_us(dwell_start)) / 1e6 AS duration_seconds FROM dwell")
def temporal_dwell(spark, d):
    return temporal.dwell(presence(spark, d), ["track", "scope"], HOURS).select("track", "ordinal", "dwell_start", "dwell_end", "reason", "duration_seconds")


OCCUPANCY = """changes AS (SELECT *, CASE WHEN reason = 'enter_confirmed' THEN 1 ELSE -1 END AS delta FROM presence WHERE reason IN ('enter_confirmed','exit_confirmed','missing_expired')),
occupancy AS (SELECT scope, track, t, frame, delta, sum(delta) OVER (PARTITION BY scope ORDER BY t, frame)::BIGINT AS occupancy_count FROM changes)"""


@query(f"WITH RECURSIVE {PRESENCE}, {OCCUPANCY} SELECT scope, track, t, frame, delta, occupancy_count, occupancy_count - delta AS previous_count FROM occupancy")
def temporal_occupancy(spark, d):
    return temporal.occupancy(presence(spark, d), ["scope"]).select("scope", "track", "t", "frame", "delta", "occupancy_count", "previous_count")


@query(f"WITH RECURSIVE {PRESENCE}, {OCCUPANCY} SELECT scope, track, frame, delta::INTEGER AS delta, occupancy_count::INTEGER AS occupancy_count FROM occupancy")
def temporal_occupancy_fold(spark, d):
    """The exact fold with the set of tracks as state; on clean input it equals the running sum."""
    t = presence(spark, d).where("reason <> 'observed_stay'")
    change = F.when(F.col("reason") == "enter_confirmed", "enter").otherwise("exit")
    out = temporal.occupancy_fold(t.select("scope", "t", "frame", F.col("track").cast("string").alias("track"), change.alias("change")), ["scope"], HOURS, tracks=False)
    return out.select("scope", F.col("track").cast("long").alias("track"), "frame", "delta", "occupancy_count")


@query(f"""WITH {EVENTS}, m AS (SELECT track, frame, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, epoch_us(t) - epoch_us(lag(t) OVER w) AS dt FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, frame))
SELECT track, frame, round(sqrt(dx*dx + dy*dy), 6) AS distance, dt / 1e6 AS time_delta_seconds, sqrt(dx*dx + dy*dy) > 0.4 AS moving FROM m""")
def temporal_movement(spark, d):
    m = temporal.movement(events(spark, d), ["track"], 0.4)
    return m.select("track", "frame", F.round("distance", 6).alias("distance"), "time_delta_seconds", "moving")


CLASSES = Policy(movement_enter=0.5, movement_exit=0.3, movement_qualification=6 * 3600)


def classified(spark, d):
    m = temporal.movement(events(spark, d), ["track"]).withColumn("distance", F.round("distance", 6))
    return temporal.classification(m.select("track", "t", "frame", "distance"), ["track"], CLASSES)


_CLASSIFY = f"""{EVENTS}, m AS (SELECT track, t, frame, epoch_us(t) AS us, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 6) AS d, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, frame)),
walk AS (SELECT track, rn, 'unknown' AS f, 'unknown' AS s, NULL::VARCHAR AS pending, NULL::BIGINT AS started, NULL::BIGINT AS told FROM m WHERE rn = 1
  UNION ALL SELECT track, rn, s, CASE WHEN switch THEN target ELSE s END,
    CASE WHEN switch OR s = 'unknown' OR target IS NULL OR target = s THEN NULL ELSE target END,
    CASE WHEN switch OR s = 'unknown' OR target IS NULL OR target = s THEN NULL WHEN pending = target THEN started ELSE us END,
    CASE WHEN switch AND s <> 'unknown' THEN started END FROM (
    SELECT *, s = 'unknown' OR (target <> s AND pending = target AND us - started >= 21600000000) IS TRUE AS switch FROM (
      SELECT m.track, m.rn, m.us, w.s, w.pending, w.started, CASE WHEN m.d > 0.5 THEN 'moving' WHEN w.s = 'unknown' OR m.d < 0.3 THEN 'stationary' END AS target
      FROM walk w JOIN m ON m.track = w.track AND m.rn = w.rn + 1) j) k)"""


@query(f"WITH RECURSIVE {_CLASSIFY} SELECT track, m.frame, f AS from_state, s AS to_state, make_timestamp(told) AS qualification_started FROM walk JOIN m USING (track, rn)")
def temporal_classification(spark, d):
    return classified(spark, d).select("track", "frame", F.col("from").alias("from_state"), F.col("to").alias("to_state"), F.col("started").alias("qualification_started"))


WAITS = Policy(waiting_qualification=5 * 3600, waiting_contexts=("c0", "c1"))


# Rows without a reason to end make up runs: a run's first row is its candidate, the first row five hours later begins the interval.
@query(f"""WITH p AS (WITH RECURSIVE {PRESENCE} SELECT track, frame, reason, to_state FROM presence), c AS (WITH RECURSIVE {_CLASSIFY} SELECT track, m.t, m.frame, s AS movement FROM walk JOIN m USING (track, rn)),
r AS (SELECT track, t, frame, CASE WHEN reason IN ('exit_confirmed','missing_expired') THEN reason WHEN movement <> 'stationary' THEN 'movement_exceeded'
    WHEN reason = 'observed_stay' AND to_state <> 'present' THEN 'not_present' WHEN track % 3 NOT IN (0, 1) THEN 'context_not_declared' END AS ended FROM c JOIN p USING (track, frame)),
g AS (SELECT *, count(ended) OVER (PARTITION BY track ORDER BY t, frame) AS run FROM r), first AS (SELECT *, min(t) FILTER (ended IS NULL) OVER (PARTITION BY track, run) AS candidate FROM g),
starts AS (SELECT *, min(t) FILTER (ended IS NULL AND epoch_us(t) - epoch_us(candidate) >= 18000000000) OVER (PARTITION BY track, run) AS began FROM first),
states AS (SELECT *, CASE WHEN ended IS NOT NULL THEN 'not_waiting' WHEN t >= began THEN 'waiting' ELSE 'candidate' END AS state FROM starts),
steps AS (SELECT *, coalesce(lag(state) OVER w, 'not_waiting') AS before, lag(began) OVER w AS began_before FROM states WINDOW w AS (PARTITION BY track ORDER BY t, frame))
SELECT track, frame, before AS from_state, state AS to_state, CASE WHEN ended IS NOT NULL THEN ended WHEN state = 'candidate' THEN 'qualifying' WHEN before = 'waiting' THEN 'stay' ELSE 'confirmed' END AS reason,
  CASE WHEN state = 'waiting' THEN began WHEN ended IS NOT NULL AND before = 'waiting' THEN began_before END AS interval_start, CASE WHEN ended IS NOT NULL AND before = 'waiting' THEN t END AS interval_end FROM steps""")
def temporal_waiting(spark, d):
    """Presence and classification in lockstep (equal key and place), then the waiting machine."""
    w = temporal.waiting(waiting_rows(spark, d), ["track"], WAITS)
    return w.select("track", "frame", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "reason", "interval_start", "interval_end")


def waiting_rows(spark, d):
    p = presence(spark, d).select("track", "frame", F.when(F.col("reason") == "observed_stay", F.when(F.col("to") == "present", "stay").otherwise("absent")).otherwise(F.col("reason")).alias("presence"))
    c = classified(spark, d).select("track", "t", "frame", F.col("to").alias("movement"))
    return temporal.lockstep(p, c, ["track"]).withColumn("context", F.concat(F.lit("c"), (F.col("track") % 3).cast("string")))


_ARRIVALS = f"""{EVENTS}, {ARRIVING}, p AS (SELECT *, strftime(t, '%Y%m%d%H%M%S%f') || frame AS place FROM arriving),
h AS (SELECT *, max(t) OVER w AS high_t, max(place) OVER w AS high FROM p WINDOW w AS (PARTITION BY track ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
told AS (SELECT *, CASE WHEN high IS NULL OR place > high THEN 'applied' WHEN place = high THEN 'deduplicated' WHEN epoch_us(high_t) - epoch_us(t) <= 21600000000 THEN 'reordered' ELSE 'late' END AS status FROM h)"""


@query(f"WITH {_ARRIVALS} SELECT track, arrival, frame, status FROM told")
def temporal_arrival_status(spark, d):
    return temporal.arrival_status(arriving(spark, d), ["track"], HOURS.reorder_window).select("track", "arrival", "frame", "status")


@query(f"""WITH RECURSIVE {_ARRIVALS}, applied AS (SELECT * FROM told WHERE status = 'applied'), {PRESENCE_OF.format(rows='applied')}
SELECT told.track, told.frame, status, from_state, to_state, reason FROM told LEFT JOIN presence ON status = 'applied' AND presence.track = told.track AND presence.frame = told.frame""")
def temporal_presence_replay(spark, d):
    """Presence in order of arrival, with duplicates, reordered and late rows."""
    out = temporal.presence(arriving(spark, d).select("track", "t", "frame", "kind", "arrival"), ["track"], HOURS, temporal.BY_ARRIVAL)
    return out.select("track", "frame", "status", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "reason")


@query(f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY track ORDER BY t, frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY t, frame) AS run FROM c) SELECT track, frame, kind, row_number() OVER (PARTITION BY track, run ORDER BY t, frame) AS streak FROM r""")
def temporal_streaks(spark, d):
    return temporal.streaks(events(spark, d), ["track"], "kind").select("track", "frame", "kind", F.col("streak").cast("long").alias("streak"))


@query(f"WITH RECURSIVE {PRESENCE} SELECT track, frame, array_to_string(list(to_state) OVER (PARTITION BY track ORDER BY t, frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS history FROM presence")
def temporal_history(spark, d):
    return temporal.history(presence(spark, d), ["track"], 8).select("track", "frame", F.array_join("history", ",").alias("history"))


@query(f"""WITH w AS ({ORACLES["temporal_waiting"]}), r AS (SELECT w.*, e.ts FROM w JOIN events e ON e.event_id = w.frame::BIGINT), l AS (SELECT track, max_by(to_state, (ts, frame)) AS state, max_by(interval_start, (ts, frame)) AS began, max(ts) AS seen FROM r GROUP BY track)
SELECT track, began AS waiting_start, seen AS last_seen, (epoch_us(seen) - epoch_us(began)) / 1e6 AS duration_seconds, epoch_us(seen) - epoch_us(began) >= 18000000000 AS qualified FROM l WHERE state = 'waiting'""")
def temporal_open_waiting(spark, d):
    """One row for each track that waits still; its id binds its start only, so it stays while the interval goes on."""
    w = temporal.waiting(waiting_rows(spark, d), ["track"], WAITS)
    return temporal.open_waiting(w, ["track"], WAITS).select("track", "waiting_start", "last_seen", "duration_seconds", "qualified")
