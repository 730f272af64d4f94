"""Streams of presence, classification, waiting and occupancy: the machines of the batch folds, with typed state kept by Spark.

Each key of a per-track machine has one value state of typed columns. A scope of occupancy has a
value state for its place and count, and a map state with a row for each track, so a change reads
and writes one track however many the scope holds. State begins empty or from stored rows
(`initial`), which are checked as they come in.

Every state carries the state version and the policy it was made under; going on under another one
is an error of the query. Late rows are judged per key against the key's own watermark, as in batch;
there are no timers and nothing is dropped. Rows without key, time or frame come out as
`invalid_input` and change nothing.

Spark hands over a key's rows of one micro-batch in no order, so a task sorts them by arrival: the
rows of one trigger bound what it holds (files_per_trigger of the source).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilspark.plans.machines import APPLIED, DEDUPLICATED, ILLEGAL, INVALID, LATE, REORDERED, Classification, Machine, Policy, Presence, Waiting, micros

STATE_VERSION = "2"
#: The track of a scope's own key; a stored row of any other is not a scope's.
SCOPE_TRACK = "__occupancy_scope__"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BASE = "version string, revision string, t long, frame string, last_seen long, history array<string>"
#: Machine: (its state, inputs, outputs)
MACHINES = {
    Presence: (f"{_BASE}, state string, since long, last_present long, entry int, exit int, occlusion string, missing_since long", ["kind"], "status string, `from` string, `to` string, reason string"),
    Classification: (f"{_BASE}, state string, pending string, started long", ["distance"], "status string, `from` string, `to` string, started timestamp"),
    Waiting: (f"{_BASE}, state string, candidate long, start long", ["presence", "movement", "context"], "status string, `from` string, `to` string, reason string, interval_start timestamp, interval_end timestamp"),
}
OCCUPANCY = "status string, previous_count int, delta int, occupancy_count int"
_TRACK, _SCOPE = "t long, frame string, occupied boolean", "version string, revision string, t long, frame string, n int"
#: Stored rows that occupancy can begin from: one for each scope.
OCCUPANCY_INITIAL = "key_track string, version string, revision string, t timestamp, frame string, occupancy_count int, tracks array<struct<track:string,t:timestamp,frame:string,occupied:boolean>>"


class WrongState(ValueError):
    """Stored state that this version, policy or kind of machine must not go on from."""


def use_rocksdb(spark: SparkSession) -> None:
    """Streams with several state variables need Spark's RocksDB state store; the setting holds for the session's new queries."""
    spark.conf.set(PROVIDER_KEY, PROVIDER)


def checked(version: str, revision: str, policy: Policy) -> None:
    if version != STATE_VERSION:
        raise WrongState(f"state of version {version!r}, this is {STATE_VERSION!r}")
    if revision != repr(policy):
        raise WrongState("state of another policy")


def _micros(t) -> int | None:
    return None if pd.isna(t) else pd.Timestamp(t).value // 1000


def _time(m: int | None):
    return pd.NaT if m is None else pd.Timestamp(m, unit="us")


def _ordered(frames: Iterator[pd.DataFrame]) -> list[dict]:
    """A key's rows by arrival, those that arrive at once by time and frame."""
    rows = pd.concat(list(frames), ignore_index=True)
    by = ["arrival", "t", "frame"] if rows["arrival"].duplicated().any() else "arrival"
    return rows.sort_values(by, kind="stable").to_dict("records")


def _plain(v):
    return None if v is None or (isinstance(v, float) and v != v) else v


class FoldProcessor(StatefulProcessor):
    """A machine per key."""

    def __init__(self, kind: type[Machine], policy: Policy, names: list[str], clock: list[str]):
        self.kind, self.policy, self.names, self.clock = kind, policy, names, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", MACHINES[self.kind][0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self.kind(self.policy)
        fields = list(machine.initial())
        kept = self.state.get()
        if kept is None:
            now = machine.initial()
        else:
            checked(kept[0], kept[1], self.policy)
            now = dict(zip(fields, kept[2:], strict=True)) | {"history": list(kept[5] or [])}
        got, known = [], _plain(key[0]) is not None
        for r in _ordered(rows):
            t, frame = _micros(r["t"]), _plain(r["frame"])
            row = {c: _plain(r[c]) for c in MACHINES[self.kind][1]} | {"t": t if known else None, "frame": frame}
            now, out = machine.apply(now, row)
            got.append((key[0], r["t"], frame, *(_time(out.get(n)) if n in self.clock else out.get(n) for n in self.names[3:])))
        if known and now["t"] is not None:
            self.state.update((STATE_VERSION, repr(self.policy), *(now[f] for f in fields)))
        yield pd.DataFrame(got, columns=self.names)

    def close(self) -> None:
        pass


class OccupancyProcessor(StatefulProcessor):
    """Who is in a scope, track by track."""

    def __init__(self, policy: Policy, names: list[str]):
        self.policy, self.names = policy, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scope = handle.getValueState("scope", _SCOPE)
        self.tracks = handle.getMapState("tracks", "track string", _TRACK)

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        """A stored scope: its key must be the scope's own, each counted track must have a place, and the count must be theirs."""
        for r in initial.to_dict("records"):
            checked(r["version"], r["revision"], self.policy)
            if r["key_track"] != SCOPE_TRACK:
                raise WrongState(f"the state of {key[0]!r} is a single track's")
            tracks = list(r["tracks"]) if r["tracks"] is not None else []
            inside = [x for x in tracks if x["occupied"]]
            if len({x["track"] for x in tracks}) != len(tracks) or len(inside) != r["occupancy_count"]:
                raise WrongState(f"the count of {key[0]!r} is not that of its tracks")
            if any(pd.isna(x["t"]) or x["frame"] is None for x in inside):
                raise WrongState(f"a track of {key[0]!r} is counted without a place")
            for x in tracks:
                self.tracks.updateValue((x["track"],), (_micros(x["t"]), x["frame"], bool(x["occupied"])))
            self.scope.update((STATE_VERSION, repr(self.policy), _micros(r["t"]), r["frame"], int(r["occupancy_count"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.scope.get()
        at, n = (None, None), 0
        if kept is not None:
            checked(kept[0], kept[1], self.policy)
            at, n = (kept[2], kept[3]), kept[4]
        got, known = [], _plain(key[0]) is not None
        for r in _ordered(rows):
            place, track = (_micros(r["t"]), _plain(r["frame"])), _plain(r["track"])
            status, before, after = INVALID, None, None
            if known and None not in (*place, track):
                status, inside = self.judged(place, track, r["change"], at)
                if status == APPLIED:
                    at, before = place, n
                    n = after = n + {"enter": 1, "exit": -1}.get(r["change"], 0)
                    self.tracks.updateValue((track,), (*place, inside))
            got.append((key[0], r["t"], place[1], status, before, None if after is None else after - before, after))
        if known and at[0] is not None:
            self.scope.update((STATE_VERSION, repr(self.policy), *at, n))
        yield pd.DataFrame(got, columns=self.names).astype({c: "Int32" for c in self.names[4:]})

    def judged(self, place: tuple, track: str, change: str, at: tuple) -> tuple[str, bool]:
        """Status, and whether the track is inside afterwards."""
        own = self.tracks.getValue((track,)) if self.tracks.containsKey((track,)) else None
        if own is not None and tuple(own[:2]) == place:
            return DEDUPLICATED, own[2]
        inside = bool(own is not None and own[2])
        if at[0] is not None and place < at:
            return (REORDERED if at[0] - place[0] <= micros(self.policy.reorder_window) else LATE), inside
        if (change == "enter") == inside and change in ("enter", "exit"):
            return ILLEGAL, inside
        return APPLIED, inside if change not in ("enter", "exit") else change == "enter"

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, outputs: str, make, initial: DataFrame | None = None) -> DataFrame:
    if rows.sparkSession.conf.get(PROVIDER_KEY, "") != PROVIDER:
        raise ValueError(f"{PROVIDER_KEY} must be RocksDB: call use_rocksdb(spark) first")
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T._parse_datatype_string(f"t timestamp, frame string, {outputs}").fields])
    grouped = initial.groupBy(key) if initial is not None else None
    return rows.groupBy(key).transformWithStateInPandas(make(schema), schema, "append", "none", grouped)


def _fold(rows: DataFrame, key: str, kind: type[Machine], policy: Policy) -> DataFrame:
    clock = [f.name for f in T._parse_datatype_string(MACHINES[kind][2]).fields if f.dataType == T.TimestampType()]
    return _run(rows.select(key, "t", "frame", "arrival", *MACHINES[kind][1]), key, MACHINES[kind][2], lambda s: FoldProcessor(kind, policy, s.names, clock))


def stream_presence(rows: DataFrame, key: str, policy: Policy) -> DataFrame:
    """Transitions (key, t, frame, status, from, to, reason) of a stream of (key, t, frame, arrival, kind)."""
    return _fold(rows, key, Presence, policy)


def stream_classification(rows: DataFrame, key: str, policy: Policy) -> DataFrame:
    """Movement states of a stream of (key, t, frame, arrival, distance)."""
    return _fold(rows, key, Classification, policy)


def stream_waiting(rows: DataFrame, key: str, policy: Policy) -> DataFrame:
    """Waiting states and intervals of a stream of (key, t, frame, arrival, presence, movement, context)."""
    return _fold(rows, key, Waiting, policy)


def stream_occupancy(rows: DataFrame, scope: str, policy: Policy, initial: DataFrame | None = None) -> DataFrame:
    """Counts (scope, t, frame, status, previous_count, delta, occupancy_count) of a stream of (scope, t, frame, arrival, track, change).

    initial: stored scopes (scope and the columns of OCCUPANCY_INITIAL) to begin from.
    """
    return _run(rows.select(scope, "t", "frame", "arrival", "track", "change"), scope, OCCUPANCY, lambda s: OccupancyProcessor(policy, s.names), initial)


def occupancy_state(spark: SparkSession, checkpoint: str, scope: str) -> DataFrame:
    """What a stopped occupancy stream holds, as rows that stream_occupancy can begin from."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    at = lambda c: F.timestamp_micros(c)
    scopes = read("scope").select(F.col(f"key.{scope}").alias(scope), "value.*")
    tracks = read("tracks").select(F.col(f"key.{scope}").alias(scope), F.struct(F.col("user_map_key.track").alias("track"), at("user_map_value.t").alias("t"), F.col("user_map_value.frame").alias("frame"), F.col("user_map_value.occupied").alias("occupied")).alias("x"))
    listed = tracks.groupBy(scope).agg(F.array_sort(F.collect_list("x")).alias("tracks"))  # a scope's row holds its tracks
    return scopes.join(listed, scope).select(scope, F.lit(SCOPE_TRACK).alias("key_track"), "version", "revision", at("t").alias("t"), "frame", F.col("n").alias("occupancy_count"), "tracks")
