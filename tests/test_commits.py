"""The atomic sink: replays, runs that die between any two writes, races, and how much of the index a batch reads."""

import datetime

import pytest
from pyspark.sql import functions as F

from vigilspark.sources import commits
from vigilspark.sources.commits import Conflict, Store

T0 = datetime.datetime(2026, 1, 1, 12)
TABLES = ("facts", "events", "audit", "outbox")


def batch(spark, ids, day=0):
    events = spark.createDataFrame([(f"e{i}", "t", T0 + datetime.timedelta(days=day), "{}") for i in ids], "event_id string, event_type string, event_time timestamp, payload string")
    return events.select("event_id", F.lit(1).alias("occupancy_count"), "event_time"), events


def persist(spark, folder, ids, name=None, day=0):
    return commits.persist_operational(*batch(spark, ids, day), folder, "me", name)


def seen(spark, folder):
    store = Store(spark, folder)
    return {t: sorted(r[0] for r in store.read(t).select("event_id").collect()) for t in TABLES}


def test_replays_and_overlaps_write_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert persist(spark, folder, range(5), "b1")["outbox"] == 5
    assert persist(spark, folder, range(5), "b1") == dict.fromkeys(TABLES, 0)  # the batch is known
    assert persist(spark, folder, range(5)) == dict.fromkeys(TABLES, 0)  # its keys are
    assert persist(spark, folder, [3, 4, 5, 5])["events"] == 1
    assert seen(spark, folder) == dict.fromkeys(TABLES, [f"e{i}" for i in range(6)])
    assert persist(spark, folder, []) == dict.fromkeys(TABLES, 0)


def test_a_run_killed_between_any_two_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    whole = Store._write
    calls = []
    monkeypatch.setattr(Store, "_write", lambda self, df, path, by=(): (calls.append(path), whole(self, df, path, by))[1])
    folder = str(tmp_path / "log")
    persist(spark, folder, range(3), "b0")
    steps = len(calls)
    assert steps >= 8
    for dies in range(steps + 1):  # the last one dies when all is written but the manifest
        left = iter(range(dies))

        def write(self, df, path, by=(), left=left):
            if next(left, None) is None:
                raise RuntimeError("killed")
            whole(self, df, path, by)

        with monkeypatch.context() as m:
            m.setattr(Store, "_write", write)
            if dies == steps:
                m.setattr(commits.Folder, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                persist(spark, folder, [2, 3], "b1")
        assert [x["batch"] for x in Store(spark, folder).manifests()] == ["b0"]
    assert seen(spark, folder) == dict.fromkeys(TABLES, ["e0", "e1", "e2"])
    assert persist(spark, folder, [2, 3], "b1")["facts"] == 1
    assert bool(Store(spark, folder).vacuum(0)) and Store(spark, folder).vacuum(0) == []
    assert seen(spark, folder) == dict.fromkeys(TABLES, ["e0", "e1", "e2", "e3"])


def test_a_batch_reads_few_index_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEYS_PER_FILTER", 50)
    store = Store(spark, str(tmp_path / "log"))
    rows = lambda a, b, day: batch(spark, range(a, b), day)[1]
    for day in range(3):
        store.commit(f"b{day}", {"events": (rows(400 * day, 400 * day + 400, day), "event_id", "event_time")})
    assert store.commit("new", {"events": (rows(5000, 5020, 1), "event_id", "event_time")}) == {"events": 20}
    assert store.index_files == 24 and len(store.probed) <= 4  # other days are never asked, and filters answer for most of the rest
    assert store.commit("again", {"events": (rows(410, 412, 1), "event_id", "event_time")}) == {"events": 0}
    assert store.index_files > 24 and 1 <= len(store.probed) <= 4 and all("_day=2026-01-02" in p for p in store.probed)


def test_the_second_of_two_writers_sees_the_first(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    publish, raced = commits.Folder.publish, []

    def slow(self, name, text):
        if not raced:
            raced.append(1)
            persist(spark, folder, [1, 2], "other")
        publish(self, name, text)

    monkeypatch.setattr(commits.Folder, "publish", slow)
    assert persist(spark, folder, [2, 3], "mine")["events"] == 1
    assert seen(spark, folder) == dict.fromkeys(TABLES, ["e1", "e2", "e3"])
    with pytest.raises(Conflict):
        Store(spark, folder).folder.publish("_commits/00000000000000000001.json", "{}")


def test_snapshot_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT", 2)
    store = Store(spark, str(tmp_path / "log"))
    for i in range(5):
        store.commit(f"b{i}", {"events": (batch(spark, [i])[1], "event_id", None)})
    assert [m["batch"] for m in store.manifests()] == [f"b{i}" for i in range(5)]
    assert store.read("events").count() == 5
    with pytest.raises(KeyError):
        store.read("facts")


def test_index_files_follow_days_not_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEYS_PER_FILTER", 10)
    monkeypatch.setattr(commits, "FILES_PER_DAY", 4)
    store = Store(spark, str(tmp_path / "log"))
    rows = batch(spark, range(400), 0)[1].unionByName(batch(spark, range(400, 800), 1)[1])
    assert store.commit("b0", {"events": (rows, "event_id", "event_time")}) == {"events": 800}
    (m,) = store.manifests()
    assert m["buckets"] == 64 and m["files"] == 8  # 400 keys a day; two days of 4 files
    files = list((tmp_path / "log" / "index").rglob("*.parquet"))
    assert len(files) == 8
    more = rows.unionByName(batch(spark, range(800, 803), 1)[1])
    assert store.commit("b1", {"events": (more, "event_id", "event_time")}) == {"events": 3}
