"""Typed stateful streams: each equals its batch fold, goes on from its state and from stored rows, and refuses foreign state."""

import datetime

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import temporal
from vigilspark.plans.machines import Policy
from vigilspark.streaming import stateful
from vigilspark.streaming.presence import pump

T0 = datetime.datetime(2026, 8, 1, 10)
POLICY = Policy(reorder_window=5, minimum_dwell=2, exit_grace=1, occlusion_tolerance=3, movement_enter=2.0, movement_exit=1.0, movement_qualification=3, waiting_qualification=4, waiting_contexts=("desk",))


def at(i):
    return T0 + datetime.timedelta(seconds=i)


def run(spark, tmp_path, df, make, parts=3, name="out"):
    """Rows that the stream gives for df, arriving in `parts` triggers."""
    stateful.use_rocksdb(spark)
    n = df.count()
    for i in range(parts):
        df.where(f"arrival >= {n * i // parts} and arrival < {n * (i + 1) // parts}").coalesce(1).write.parquet(str(tmp_path / f"{name}-in/p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in/*"))
    pump(make(stream), lambda b, _: b.write.mode("append").parquet(str(tmp_path / name)), str(tmp_path / f"{name}-cp")).awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def rows_of(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_classification_and_waiting(spark, tmp_path):
    moves = [(k, at(i), f"{i:05d}", None if i == 0 else float((i * 7 + j) % 5), i * 2 + j) for i in range(40) for j, k in enumerate("ab")]
    moves += [("a", at(3), "00003", 1.0, 80), ("b", at(36), "00036x", 1.0, 81), (None, at(1), "x", 1.0, 82), ("a", None, "x", 1.0, 83), ("b", at(50), None, 1.0, 84)]
    df = spark.createDataFrame(moves, "track string, t timestamp, frame string, distance double, arrival long")
    cols = ["track", "t", "frame", "status", "from", "to", "started"]
    want = rows_of(temporal.classification(df, ["track"], POLICY, temporal.BY_ARRIVAL), cols)
    assert rows_of(run(spark, tmp_path, df, lambda s: stateful.stream_classification(s, "track", POLICY)), cols) == want
    assert [r[3] for r in want].count("invalid_input") == 3 and {"late", "reordered", "applied"} <= {r[3] for r in want}

    steps = [("a", at(i), f"{i:05d}", "enter_confirmed" if i % 19 == 0 else "exit_confirmed" if i % 19 == 18 else "stay", "moving" if i % 11 == 10 else "stationary", "desk" if i % 23 else None, i) for i in range(60)]
    df = spark.createDataFrame(steps, "track string, t timestamp, frame string, presence string, movement string, context string, arrival long")
    cols = ["track", "t", "frame", "status", "from", "to", "reason", "interval_start", "interval_end"]
    want = rows_of(temporal.waiting(df, ["track"], POLICY, temporal.BY_ARRIVAL), cols)
    assert rows_of(run(spark, tmp_path, df, lambda s: stateful.stream_waiting(s, "track", POLICY), name="wait"), cols) == want
    assert any(r[-1] for r in want)


def changes(spark):
    rows = [(s, at(i), f"{i:05d}", f"t{(i * 5 + s) % 7}", ["enter", "stay", "exit", "enter"][i * 3 // 2 % 4], 2 * i + s) for i in range(50) for s in range(2)]
    rows += [(0, at(49), "00049", "t0", "enter", 100), (0, at(10), "00010", "t3", "exit", 101), (1, at(47), "00047", "t4", "stay", 102), (None, at(60), "z", "t1", "enter", 103), (0, at(61), "z", None, "enter", 104), (0, None, "z", "t1", "enter", 105)]
    return spark.createDataFrame(rows, "scope int, t timestamp, frame string, track string, change string, arrival long")


OCC = ["scope", "t", "frame", "status", "previous_count", "delta", "occupancy_count"]


def test_occupancy_goes_on_from_its_own_state(spark, tmp_path):
    df = changes(spark)
    want = rows_of(temporal.occupancy_fold(df, ["scope"], POLICY, temporal.BY_ARRIVAL), OCC)
    assert {"applied", "illegal", "late", "reordered", "invalid_input"} <= {r[3] for r in want}
    first = run(spark, tmp_path, df.where("arrival < 40"), lambda s: stateful.stream_occupancy(s, "scope", POLICY), 2, "first")
    stored = stateful.occupancy_state(spark, str(tmp_path / "first-cp"), "scope")
    stored.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert temporal.restorable(stored.select("key_track", F.expr("transform(filter(tracks, x -> x.occupied), x -> x.track)").alias("occupied"), F.expr("transform(tracks, x -> x.track)").alias("positions"), "occupancy_count"), stateful.SCOPE_TRACK).where("restore_error is not null").isEmpty()
    rest = df.where("arrival >= 40").withColumn("arrival", F.col("arrival") - 40)
    second = run(spark, tmp_path, rest, lambda s: stateful.stream_occupancy(s, "scope", POLICY, stored), 2, "second")
    assert rows_of(first.unionByName(second), OCC) == want


@pytest.mark.parametrize("change", [{"revision": "another"}, {"version": "0"}, {"key_track": "t1"}, {"occupancy_count": 5}])
def test_foreign_state_is_refused(spark, tmp_path, change):
    good = spark.createDataFrame([(0, stateful.SCOPE_TRACK, stateful.STATE_VERSION, repr(POLICY), T0, "0", 1, [("t1", T0, "0", True)])], f"scope int, {stateful.OCCUPANCY_INITIAL}")
    bad = good.withColumns({k: F.lit(v) for k, v in change.items()})
    with pytest.raises(Exception, match="WrongState"):
        run(spark, tmp_path, changes(spark).where("arrival < 6"), lambda s: stateful.stream_occupancy(s, "scope", POLICY, bad), 1)


def test_restart_under_another_policy_fails(spark, tmp_path):
    df = changes(spark)
    run(spark, tmp_path, df.where("arrival < 20"), lambda s: stateful.stream_occupancy(s, "scope", POLICY), 1, "x")
    df.where("arrival >= 20 and arrival < 40").coalesce(1).write.parquet(str(tmp_path / "x-in/later"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "x-in/*"))
    other = stateful.stream_occupancy(stream, "scope", Policy())
    with pytest.raises(Exception, match="WrongState"):
        pump(other, lambda b, _: b.count(), str(tmp_path / "x-cp")).awaitTermination()


def test_fold_keeps_the_state_of_numeric_keys_beside_null_ones(spark):
    rows = [(1, at(0), "0", "present"), (None, at(0), "0", "present"), (None, at(1), "1", "present"), (1, at(1), "1", "present"), (1, at(1), None, "present"), (1, None, "2", "absent")]
    df = spark.createDataFrame(rows, "track int, t timestamp, frame string, kind string").coalesce(1)
    got = temporal.presence(df, ["track"], POLICY).collect()
    assert sorted((str(r["track"]), r["status"], str(r["to"])) for r in got) == [("1", "applied", "entering"), ("1", "applied", "present"), ("1", "invalid_input", "None"), ("1", "invalid_input", "None"), ("None", "invalid_input", "None"), ("None", "invalid_input", "None")]


def test_rows_that_arrive_at_once_are_taken_by_their_place(spark, tmp_path):
    rows = [(k, at(i), f"{i:05d}", "present" if i % 3 else "absent", i // 4) for i in range(40) for k in "ab"]
    df = spark.createDataFrame(rows[::-1], "track string, t timestamp, frame string, kind string, arrival long").coalesce(1)
    got = run(spark, tmp_path, df, lambda s: stateful.stream_presence(s, "track", POLICY), 1)
    assert {r["status"] for r in got.collect()} == {"applied"}
