"""Temporal operators: folds of state machines over keys, dwell, occupancy, movement.

A fold shuffles rows by key, sorts them within partitions and runs them through a
machine as a stream: a task holds one key's state at a time, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.functions import ids
from vigilspark.plans.machines import INVALID, Classification, Machine, Occupancy, Policy, Presence, Waiting

#: Ways to order a key's rows: by event time, or as they arrived (which shows duplicates and late rows).
BY_TIME, BY_ARRIVAL = "time", "arrival"


def fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Machine], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """df's keys, t, frame and inputs with the machine's outputs. df needs t (timestamp) and frame (string).

    A row without one of its keys, t or frame has the status invalid_input and changes no state.
    """
    schema = T.StructType([*(df.schema[c] for c in dict.fromkeys([*keys, "t", "frame", *inputs])), *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in outputs.items())).fields])
    names = schema.names
    kept = names[: len(names) - len(outputs)]
    time_outputs = [n for n, t in outputs.items() if t == "timestamp"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, key, state = make(), None, None
        for f in frames:
            out = {n: [] for n in outputs}
            rows = {c: f[c].tolist() for c in inputs}
            valid = f[[*keys, "t", "frame"]].notna().all(axis=1).tolist()
            times = (f["t"].astype("int64") // (1000 if str(f["t"].dtype).endswith("[ns]") or "ns" in str(f["t"].dtype) else 1)).tolist()
            frame = f["frame"].tolist()
            for i, k in enumerate(zip(*(f[c].tolist() for c in keys), strict=True)):
                row = {c: None if isinstance(v := rows[c][i], float) and v != v else v for c in inputs}
                if valid[i]:
                    if k != key:
                        key, state = k, machine.initial()
                    state, got = machine.apply(state, row | {"t": times[i], "frame": frame[i]})
                else:
                    got = {"status": INVALID}
                for n in outputs:
                    out[n].append(got.get(n))
            for n in time_outputs:
                out[n] = pd.to_datetime(pd.Series(out[n], dtype="Int64"), unit="us", utc=True)
            yield pd.concat([f[kept].reset_index(drop=True), pd.DataFrame(out)], axis=1)[names]

    dealt = df.select(*dict.fromkeys([*kept, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def _order(by: str) -> list[str]:
    return ["t", "frame"] if by == BY_TIME else ["arrival", "t", "frame"]  # what arrives at once is taken by its place


def presence(observations: DataFrame, keys: list[str], policy: Policy, by: str = BY_TIME) -> DataFrame:
    """Transitions of presence for observations (keys, t, frame, kind; arrival for BY_ARRIVAL)."""
    return fold(observations, keys, _order(by), lambda: Presence(policy), ["kind"], {"status": "string", "from": "string", "to": "string", "reason": "string"})


def classification(measurements: DataFrame, keys: list[str], policy: Policy, by: str = BY_TIME) -> DataFrame:
    return fold(measurements, keys, _order(by), lambda: Classification(policy), ["distance"], {"status": "string", "from": "string", "to": "string", "started": "timestamp"})


def waiting(rows: DataFrame, keys: list[str], policy: Policy, by: str = BY_TIME) -> DataFrame:
    return fold(rows, keys, _order(by), lambda: Waiting(policy), ["presence", "movement", "context"], {"status": "string", "from": "string", "to": "string", "reason": "string", "interval_start": "timestamp", "interval_end": "timestamp"})


def lockstep(transitions: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys and frame, as the waiting machine takes them; a row without its partner is left out."""
    return classified.join(transitions.select(*keys, "frame", *[c for c in transitions.columns if c not in (*keys, *classified.columns)]), [*keys, "frame"])


def open_waiting(waits: DataFrame, keys: list[str], policy: Policy, fsm_version: str = "1") -> DataFrame:
    """The running interval of each key whose last applied row (of waiting()) waits: waiting_start, last_seen, duration_seconds, qualified and interval_id, which binds key and start only."""
    place = F.struct("t", "frame")
    last = waits.where("status = 'applied'").groupBy(*keys).agg(F.max_by("to", place).alias("_to"), F.max_by("interval_start", place).alias("waiting_start"), F.max("t").alias("last_seen"))
    out = last.where("_to = 'waiting'").drop("_to").withColumn("duration_seconds", (F.unix_micros("last_seen") - F.unix_micros("waiting_start")) / 1e6)
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    ident = ids.interval_id("waiting", key, F.col("waiting_start"), F.lit(None).cast("timestamp"), fsm_version, repr(policy))
    return out.withColumn("qualified", F.col("duration_seconds") >= policy.waiting_qualification).withColumn("interval_id", ident)


def occupancy_fold(changes: DataFrame, scope: list[str], policy: Policy, by: str = BY_TIME, tracks: bool = True) -> DataFrame:
    """Exact occupancy with late and duplicate rows: changes (scope, t, frame, track, change).

    tracks: whether each row lists the tracks that are present; without it a row costs the same however many there are.
    """
    listed = {"occupied_tracks": "array<string>"} if tracks else {}
    return fold(changes, scope, _order(by), lambda: Occupancy(policy, tracks), ["track", "change"], {"status": "string", "previous_count": "int", "delta": "int", "occupancy_count": "int"} | listed)


def dwell_event(reason: Column) -> Column:
    """open, close or stay of a presence transition."""
    return F.when(reason == "enter_confirmed", "open").when(reason.isin("exit_confirmed", "missing_expired", "session_closed"), "close").otherwise("stay")


def dwell(transitions: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """Intervals from confirmed entry to confirmed exit; the last may be open and ends with what was seen last."""
    w = Window.partitionBy(*keys).orderBy("t", "frame")
    ok = transitions.where("status = 'applied'").withColumn("event", dwell_event(F.col("reason")))
    marked = ok.withColumn("n", F.count(F.when(F.col("event") == "open", 1)).over(w)).where("n > 0")
    closing = F.when(F.col("event") == "close", F.col("t"))
    seconds = (F.unix_micros("dwell_last") - F.unix_micros("dwell_start")) / 1e6
    out = marked.groupBy(*keys, "n").agg(
        F.min(F.when(F.col("event") == "open", F.col("t"))).alias("dwell_start"),
        F.min(closing).alias("dwell_end"),
        F.max("t").alias("seen"),
        F.min_by("reason", F.when(F.col("event") == "close", F.col("t"))).alias("reason"),
    )
    return out.withColumn("dwell_last", F.coalesce("dwell_end", "seen")).withColumn("duration_seconds", seconds).withColumn("qualified", F.col("duration_seconds") >= policy.dwell_minimum).withColumnRenamed("n", "ordinal").drop("seen")


def occupancy(transitions: DataFrame, scope: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """A snapshot for every confirmed change of the number of present tracks; for clean input, by a running sum.

    Sums run within buckets of time, and over a scope's buckets, so a busy scope is many tasks: bucket_seconds should be a
    time in which one task can hold a scope's changes.
    """
    delta = F.when(F.col("reason") == "enter_confirmed", 1).when(F.col("reason").isin("exit_confirmed", "missing_expired") | ((F.col("reason") == "session_closed") & F.col("from").isin("present", "exiting")), -1)
    bucket = F.floor(F.unix_micros("t") / (bucket_seconds * 1_000_000))
    changes = transitions.where("status = 'applied'").withColumn("delta", delta).where("delta is not null").withColumn("_bucket", bucket)
    within = Window.partitionBy(*scope, "_bucket").orderBy("t", "frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = changes.withColumn("_count", F.sum("delta").over(within))
    before = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = inner.groupBy(*scope, "_bucket").agg(F.sum("delta").alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    starts = totals.select(*(F.col(c).alias(f"_k_{c}") for c in scope), F.col("_bucket").alias("_k__bucket"), "_before")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*scope, "_bucket"]))
    out = inner.join(starts, same).withColumn("occupancy_count", F.col("_count") + F.col("_before")).withColumn("previous_count", F.col("occupancy_count") - F.col("delta"))
    return out.select(*transitions.columns, "delta", "occupancy_count", "previous_count")


def movement(points: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Distance and time from each track's row before; the first row of a track has none."""
    w = Window.partitionBy(*keys).orderBy("t", "frame")
    before = F.lag(F.struct("x", "y", "t")).over(w)
    out = points.withColumn("before", before)
    out = out.withColumn("distance", F.hypot(F.col("x") - F.col("before.x"), F.col("y") - F.col("before.y"))).withColumn("time_delta_seconds", (F.unix_micros("t") - F.unix_micros("before.t")) / 1e6)
    return out.withColumn("moving", (F.col("distance") > threshold) & ~F.isnan("distance")).withColumn("previous_t", F.col("before.t")).drop("before")


def history(transitions: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The last `limit` states up to each row. Whole histories are the rows themselves, so limit is at least 1."""
    if limit < 1:
        raise ValueError("limit begins at 1")
    w = Window.partitionBy(*keys).orderBy("t", "frame").rowsBetween(1 - limit, Window.currentRow)
    return transitions.withColumn("history", F.collect_list("to").over(w))


def streaks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many rows in a row have had the same value."""
    w = Window.partitionBy(*keys).orderBy("t", "frame")
    change = rows.withColumn("_new", (F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return change.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("t", "frame"))).drop("_new", "_run")


def arrival_status(rows: DataFrame, keys: list[str], window_seconds: float) -> DataFrame:
    """The ordering discipline alone: status of each row in order of arrival against the greatest place before."""
    w = Window.partitionBy(*keys).orderBy("arrival", "t", "frame").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max(F.struct("t", "frame")).over(w)
    place = F.struct("t", "frame")
    status = F.when(high.isNull() | (place > high), "applied").when(place == high, "deduplicated").when(F.unix_micros(high["t"]) - F.unix_micros("t") <= round(window_seconds * 1e6), "reordered").otherwise("late")
    return rows.withColumn("status", status)


def presence_kind(status: Column) -> Column:
    """What a spatial status observes: inside and ambiguous are present, outside is absent, excluded and privacy are not observed."""
    return F.when(status.isin("inside", "ambiguous"), "present").when(status == "outside", "absent").when(status.isin("excluded", "privacy"), "not_observed")


def foreign_observations(observations: DataFrame, parts: tuple[str, ...] = ("session_id", "track_id", "camera_id", "configuration_version_id")) -> DataFrame:
    """Observations whose key (struct) is of another session, track, camera or configuration than they are, with the first part that differs."""
    differs = F.coalesce(*(F.when(~F.col(f"key.{p}").eqNullSafe(F.col(p)), F.lit(p)) for p in parts))
    return observations.withColumn("mismatch", differs).where("mismatch is not null")


def restorable(snapshots: DataFrame, scope_track: str) -> DataFrame:
    """Stored occupancy (key_track, occupied, positions: arrays of tracks, occupancy_count) with restore_error: a key of a single track, a count that is not the set's size, or a counted track without a position."""
    error = (
        F.when(~F.col("key_track").eqNullSafe(F.lit(scope_track)), "key_not_of_scope").when(F.size(F.array_distinct("occupied")) != F.col("occupancy_count"), "count_differs")
        .when(F.size(F.array_except("occupied", "positions")) > 0, "track_without_position")
    )
    return snapshots.withColumn("restore_error", error)
