"""The frame source in batch and stream, and live counts of streams."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import counters as batch_counters
from vigilspark.sources import recorded
from vigilspark.sources.recorded import RecordedFrames, Segment, frames_of
from vigilspark.streaming.counters import Counters, counting
from vigilspark.streaming.presence import pump


def line(i, **more):
    return json.dumps({"frame_id": f"f{i}", "event_time": f"2026-01-01T00:00:{i:02d}+02:00", "width": 4, "height": 3, "source_ref": "cam"} | more)


def segment(folder, session, name, lines):
    (folder / session).mkdir(parents=True, exist_ok=True)
    (folder / session / name).write_text("\n".join(lines) + "\n")


def rows(df):
    return sorted((r.session_id, r.frame_index, r.segment, r.frame_id, str(r.event_time), r.width, r.error) for r in df.collect())


def test_batch_and_restarted_stream_give_equal_frames(spark, tmp_path):
    spark.dataSource.register(RecordedFrames)
    folder = tmp_path / "rec"
    segment(folder, "a", "001.json", [line(1), "{broken", "", line(2)])
    segment(folder, "a", "002.json", [line(3), "x", "y", "z", line(4)])
    segment(folder, "b", "001.json", [line(5)])
    segment(folder, "a", "_hidden", [line(9)])

    def stream():
        df = spark.readStream.format("recorded_frames").option("path", str(folder)).load()
        pump(df, lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()

    stream()
    first = rows(spark.read.parquet(str(tmp_path / "out")))
    assert [(r[0], r[1] // recorded.SPAN, r[1] % recorded.SPAN, r[3], r[6]) for r in first] == [("a", 0, 0, "f1", None), ("a", 0, 3, "f2", None), ("a", 1, 0, "f3", None), ("a", 1, 3, None, "decode_budget_exhausted"), ("b", 0, 0, "f5", None)]
    assert first[0][4] == "2025-12-31 22:00:01"
    segment(folder, "a", "003.json", [line(6)])
    segment(folder, "c", "001.json", ["[]", line(7)])
    stream()
    batch = rows(spark.read.format("recorded_frames").option("path", str(folder)).load())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == batch and len(batch) == 7
    segment(folder, "a", "000.json", [line(8)])
    with pytest.raises(Exception, match="not the 3. any more"):
        segment(folder, "b", "002.json", [line(8)])
        stream()


def test_a_connection_that_fails_goes_on_behind_its_last_line():
    calls, pauses = [], []

    def lines(path, top):
        calls.append(path)
        for i in range(6):
            if len(calls) in (1, 2) and i == 2 * len(calls):
                raise OSError("gone")
            yield line(i).encode()

    got = list(frames_of(Segment("s", 1, "x/seg"), {"path": "/x", "attempts": 2}, lines, pauses.append))
    assert [r[3] for r in got] == [f"f{i}" for i in range(6)] and [r[2] for r in got] == [recorded.SPAN + i for i in range(6)] and pauses == [0.5, 0.5]

    def never(path, top):
        raise OSError("gone")
        yield

    pauses.clear()
    got = list(frames_of(Segment("s", 0, "x/seg"), {"path": "/x", "attempts": 4, "most": 1}, never, pauses.append))
    assert [r[-1] for r in got] == ["unreachable"] and pauses == [0.5, 1.0, 1.0]


def test_counts_of_a_stream_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "event" if i % 3 else "frame", i % 5) for i in range(200)], "id long, kind string, n int")
    for i in range(3):
        df.where(f"id % 3 = {i}").write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    live = Counters().attach(spark)
    try:
        counted = counting(stream, "stages", frames=F.col("kind") == "frame", events=F.col("kind") == "event", detections=F.col("n"))
        pump(counted, lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
        want = {"frames": 67, "events": 133, "detections": 400}
        until = time.time() + 30
        while time.time() < until and ({k: v for (_, k), v in live.snapshot().items()} != want or live.ended()[0] < 1):
            time.sleep(0.2)
        assert {k: v for (_, k), v in live.snapshot().items()} == want and live.ended() == (1, 0)
        totals = {r["name"]: r["total"] for r in batch_counters.stage_counts(live.records(spark, "stages")).collect()}
        assert {k: totals[k] for k in want} == want and totals["outbox"] == 0
    finally:
        spark.streams.removeListener(live)


def test_event_time_without_a_zone_is_utc():
    assert recorded.decoded(b'{"frame_id": 1, "event_time": "2026-01-01T00:00:00"}')[1] == datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    assert [recorded.decoded(x) for x in (b"", b"7", b"{}", b'{"frame_id": 1, "event_time": "soon"}')] == [None] * 4
