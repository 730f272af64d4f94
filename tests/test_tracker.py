"""The tracker over frames: planted tracks, refused frames, and a plain rewrite of its rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import detection
from vigilspark.plans.tracker import Tracker, TrackPolicy, overlap

T0 = datetime.datetime(2026, 1, 1)
FRAMES = "session_id string, arrival int, frame_id string, frame_index int, event_time timestamp, source_ref string"
DETECTIONS = "session_id string, frame_id string, detection_id string, class_name string, confidence double, box struct<x_min:double,y_min:double,x_max:double,y_max:double>"


def plain_track(frames, detections, p):
    """One session at a time, all pairs of a frame in a table."""
    rows, refused = [], []
    for s in sorted({f[0] for f in frames}):
        live, ended, n, last = {}, set(), 0, None
        for _, arrival, frame, index, at, source in sorted((f for f in frames if f[0] == s), key=lambda f: f[1]):
            if last and (source != last[3] or frame == last[0] or index <= last[1] or at < last[2]):
                refused.append((s, arrival, frame))
                continue
            last = (frame, index, at, source if last is None else last[3])
            own = sorted(d for d in detections if d[:2] == (s, frame))
            free = {d[2] for d in own}
            by = {d[2]: d for d in own}
            for t in sorted(live, key=lambda t: (-live[t]["d"][4], t)):
                fit = [(overlap(live[t]["d"][5], by[i][5]), i) for i in free if p.allow_class_switch or by[i][3] == live[t]["d"][3]]
                fit = [x for x in fit if x[0] > p.floor]
                if fit:
                    best = min(fit, key=lambda x: (-x[0], x[1]))[1]
                    free.discard(best)
                    live[t] = {"d": by[best], "miss": 0}
                    rows.append((s, frame, t, best, "active", True))
                else:
                    live[t]["miss"] += 1
                    rows.append((s, frame, t, live[t]["d"][2], "lost" if live[t]["miss"] <= p.buffer else "terminated", False))
            ended |= {t for t in live if live[t]["miss"] > p.buffer}
            live = {t: x for t, x in live.items() if x["miss"] <= p.buffer}
            for i in sorted(free):
                if by[i][4] >= p.start:
                    n += 1
                    live[n] = {"d": by[i], "miss": 0}
                    rows.append((s, frame, n, i, "active", True))
    return sorted(rows), sorted(refused)


@pytest.mark.parametrize("policy", [TrackPolicy(), TrackPolicy(floor=0.3, buffer=0, start=0.4), TrackPolicy(buffer=4, allow_class_switch=True)])
def test_tracker_equals_plain_rules(spark, policy):
    rng = random.Random(4)
    frames, found = [], []
    for s in ("a", "b", "c"):
        spots = [[rng.random() * 8, rng.random() * 8] for _ in range(6)]
        for i in range(60):
            index = i - 5 if rng.random() < 0.05 else i
            frame = f"{s}{i - 1 if rng.random() < 0.05 else i}"
            frames.append((s, i, frame, index, T0 + datetime.timedelta(seconds=i - 3 * (rng.random() < 0.05)), "other" if rng.random() < 0.03 else "cam"))
            for k, spot in enumerate(spots):
                spot[0] += rng.uniform(-0.3, 0.3)
                spot[1] += rng.uniform(-0.3, 0.3)
                if rng.random() < 0.8:
                    found.append((s, f"{s}{i}", f"{s}-{i:02d}-{k}", "xy"[rng.random() < 0.1], rng.random(), (spot[0], spot[1], spot[0] + 1, spot[1] + 1)))
    want, refused = plain_track(frames, found, policy)
    good, bad = detection.track(spark.createDataFrame(frames, FRAMES).repartition(5), spark.createDataFrame(found, DETECTIONS).repartition(5), policy)
    got = sorted((r.session_id, r.frame_id, r.local_track_id, r.detection_id, r.track_state, r.matched) for r in good.collect())
    assert got == want and refused and len({r[4] for r in want}) == (2 if policy.buffer == 0 else 3)
    assert sorted((r.session_id, r.arrival, r.frame_id) for r in bad.collect()) == refused
    ends = [r[:1] + r[2:3] for r in want if r[4] == "terminated"]
    assert len(ends) == len(set(ends))
    assert good.select(F.count_distinct("session_id", "local_track_id")).first()[0] == good.select("track_id").distinct().count()


def test_tracker_odd_input(spark):
    frames = spark.createDataFrame([("s", 0, "f0", 0, T0, None), ("s", 1, "f1", 1, None, None), ("s", 2, "f2", None, T0, None), ("s", 3, None, 3, T0, None), ("s", 4, "f4", 4, T0, None), (None, 5, "f5", 5, T0, None)], FRAMES)
    found = spark.createDataFrame([("s", "f0", "d0", "x", 0.9, (0.0, 0.0, 1.0, 1.0)), ("s", "f0", "d1", "x", None, (0.0, 0.0, 1.0, 1.0)), ("s", "f0", "d2", "x", 0.5, None), ("s", "gone", "d3", "x", 0.5, (0.0, 0.0, 1.0, 1.0)), ("s", "f4", "d4", None, 0.5, (0.0, 0.0, 1.0, 1.0))], DETECTIONS)
    good, bad = detection.track(frames, found, TrackPolicy())
    assert sorted((r.frame_id, r.local_track_id, r.detection_id, r.track_state) for r in good.collect()) == [("f0", 1, "d0", "active"), ("f4", 1, "d0", "lost"), ("f4", 2, "d4", "active")]
    assert sorted(r.arrival for r in bad.collect() if r.error_code == "incomplete_frame") == [1, 2, 3, 5]
    assert detection.track(frames.limit(0), found, TrackPolicy())[0].count() == 0


def test_one_class_a_track():
    t = Tracker(TrackPolicy())
    box = (0.0, 0.0, 1.0, 1.0)
    assert t.step([{"detection_id": 1, "class_name": "a", "score": 1.0, "box": box}]) == [(1, 1, "active", True)]
    assert t.step([{"detection_id": 2, "class_name": "b", "score": 1.0, "box": box}]) == [(1, 1, "lost", False), (2, 2, "active", True)]
