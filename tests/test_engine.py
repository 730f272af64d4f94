"""Streams against batch, rules at their thresholds, sources and sinks, configuration rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.functions import geometry as G
from vigilspark.operators import queues, rules, spatial, temporal
from vigilspark.plans.machines import Policy
from vigilspark.sources import commits, frames
from vigilspark.streaming.presence import pump
from vigilspark.streaming.stateful import stream_presence, use_rocksdb

T0 = datetime.datetime(2026, 8, 1, 10)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, T0 + datetime.timedelta(seconds=i), f"{i:05d}", ["present", "present", "absent", "not_observed"][i * 7 // 3 % 4], i) for k in ("a", "b") for i in range(60)]
    rows += [("a", T0 + datetime.timedelta(seconds=3), "00003", "present", 100), ("b", T0 + datetime.timedelta(seconds=1), "00001", "present", 101)]
    schema = "track string, t timestamp, frame string, kind string, arrival long"
    policy = Policy(reorder_window=5, minimum_dwell=2, exit_grace=1, occlusion_tolerance=3)
    df = spark.createDataFrame(rows, schema)
    for n, part in enumerate((df.where("arrival < 30"), df.where("arrival >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    use_rocksdb(spark)
    query = pump(stream_presence(stream, "track", policy), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination()
    cols = ["track", "frame", "status", "from", "to", "reason"]
    batch = temporal.presence(df, ["track"], policy, temporal.BY_ARRIVAL).select(*cols)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_append_new_replays_nothing(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("event_id"))
    path = str(tmp_path / "facts")
    assert [frames.append_new(df, path, "event_id", "event_id") for _ in range(2)] == [10, 0]
    assert spark.read.parquet(path).count() == 10


def test_contract_is_strict(spark):
    df = spark.createDataFrame([("t", "d", "f", "s", "1.0", T0, "active", {"a": "b"})], schemas.CONTRACTS["track_observation"])
    assert schemas.assert_contract(df, "track_observation").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        schemas.assert_contract(df.withColumn("more", F.lit(1)), "track_observation")


@pytest.mark.parametrize("seconds,status", [(59.0, "no_match"), (60.0, "match"), (61.0, "match"), (None, "invalid"), (-1.0, "invalid"), (float("nan"), "invalid")])
def test_dwell_threshold_edges(spark, seconds, status):
    r = rules.default_registry()
    row = spark.createDataFrame([("t", "v", "s", "c", "k", "x", "g", T0, T0, T0, seconds)], "tenant string, venue string, session string, camera string, track string, context string, config string, event_time timestamp, last_seen timestamp, interval_start timestamp, duration_seconds double")
    got = r.evaluate("dwell_threshold", "v1", row, {"dwell_threshold_seconds": 60}).first()
    assert got["status"] == status and (got["event_id"] is not None) == (status == "match")


def test_registry_refuses():
    r = rules.default_registry()
    with pytest.raises(ValueError):
        r.register(rules.Rule("dwell_threshold", "v1", rules.dwell_threshold, "dwell_interval"))
    with pytest.raises(ValueError):
        r.evaluate("dwell_threshold", "v1", None, {})
    with pytest.raises(KeyError):
        r.evaluate("nothing", "v1", None, {})


def test_uuid5(spark):
    import uuid

    from vigilspark.functions import ids

    names = ["", "a", "grüße|x", "rule_event|t"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_rings(spark):
    ell = [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)]
    pts = {(0.25, 0.75): "inside", (0.75, 0.75): "outside", (0.5, 0.75): "boundary", (0, 0): "boundary", (0.75, 0.5 + 5e-10): "boundary", (-0.1, 0.5): "outside"}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double").select("x", "y", G.classify_point(F.struct("x", "y"), G.ring_of(ell)).alias("l"))
    assert {(r.x, r.y): r.l for r in df.collect()} == pts


def test_clip_depends_on_winding(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    a = spark.range(1).select(G.clip_area(G.ring_of(square), G.ring_of(square)).alias("a"), G.clip_area(G.ring_of(square), G.ring_of(square[::-1])).alias("b")).first()
    assert (a.a, a.b) == (1.0, 0.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "track string, t timestamp, frame string, kind string, x double, y double, point_id string, version int")
    assert temporal.presence(none, ["track"], Policy()).count() == 0
    zones = spark.createDataFrame([], "version int, profile_id string, ring array<struct<x:double,y:double>>")
    one = spark.createDataFrame([("p", 0.1, 0.1, 1)], "point_id string, x double, y double, version int")
    assert spatial.membership(one, zones, ["version"]).first()["status"] == "outside"


def test_line_crossing_directions(spark):
    rows = [("a", T0 + datetime.timedelta(seconds=i), str(i), x, y) for i, (x, y) in enumerate([(0.5, 0.9), (0.5, 0.1), (0.5, 0.9), (0.9, 0.9), (0.9, 0.1)])]
    df = spark.createDataFrame(rows, "track string, t timestamp, frame string, x double, y double")
    out = spatial.line_crossings(df, ["track"], ((0.2, 0.5), (0.8, 0.5))).orderBy("frame").collect()
    assert [r["direction"] for r in out] == ["forward", "reverse", None, None]


def test_idempotent_outcomes(spark):
    q = spark.createDataFrame([("t", "o", "k1", "h"), ("t", "o", "k2", "h"), ("t", "o", "k3", "h")], "tenant_id string, operation string, key string, request_hash string")
    d = spark.createDataFrame([("t", "o", "k1", "h"), ("t", "o", "k2", "other")], q.schema)
    assert {r["key"]: r["outcome"] for r in queues.idempotent(q, d).collect()} == {"k1": "replay", "k2": "conflict", "k3": "new"}


def test_times_do_not_depend_on_the_session_zone(spark):
    from vigilspark.functions import ids

    micros = [0, 1, -1, 1_700_000_000_250_000, -62_135_596_800_000_000, 4_102_444_799_999_999]
    df = spark.createDataFrame([(m,) for m in micros], "m long").select("m", F.timestamp_micros("m").alias("t"))
    kept = spark.conf.get("spark.sql.session.timeZone")
    epoch = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/St_Johns", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for r in df.select("m", ids.iso(F.col("t")).alias("iso"), ids.lease_time(F.col("t")).alias("lease"), ids.utc_date(F.col("t")).cast("string").alias("day"), ids.utc_second_text(F.col("t")).alias("text")).collect():
                at = epoch + datetime.timedelta(microseconds=r.m)
                assert (r.iso, r.lease) == (at.isoformat(), at.isoformat(timespec="microseconds"))
                assert (r.day, r.text) == (at.date().isoformat(), at.replace(microsecond=0, tzinfo=None).isoformat(" "))
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_append_new_with_null_keys_and_a_defined_winner(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "x"), (None, 2, "x"), ("a", 5, "late"), ("a", 3, "first"), ("a", 3, "second")], "event_id string, at int, v string")
    path = str(tmp_path / "facts")
    assert [frames.append_new(d, path, "event_id", "at") for d in (df, df.repartition(3))] == [3, 0]
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([(None, 1, "x"), (None, 2, "x"), ("a", 3, "first")], key=str)


def test_persist_operational_writes_once(spark, tmp_path):
    events = spark.createDataFrame([("e1", "t", T0, "{}"), ("e2", "t", T0, "{}")], "event_id string, event_type string, event_time timestamp, payload string")
    facts = spark.createDataFrame([("e1", 3), (None, 4), (None, 5)], "event_id string, occupancy_count int").withColumn("event_time", F.lit(T0))
    got = [commits.persist_operational(facts, events, str(tmp_path / "log"), "me") for _ in range(2)]
    assert got == [{"facts": 3, "events": 2, "audit": 2, "outbox": 2}, {"facts": 0, "events": 0, "audit": 0, "outbox": 0}]


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"frame_id":"f1","session_id":"s","frame_index":1}\n\n{broken\n{"frame_id":"f2"}\n')
    good, bad = frames.read_contract(spark, str(tmp_path / "in.json"), "frame_packet", "json")
    assert sorted(r.frame_id for r in good.collect()) == ["f1", "f2"] and bad.count() == 1 and bad.first()["_corrupt"] == "{broken"


def test_supervisor_counts_failures_in_a_row():
    from vigilspark.streaming.presence import supervised

    class Query:
        def __init__(self, rows, fails):
            self.recentProgress, self.fails = [{"numInputRows": rows}], fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("gone")

    def run(plan, attempts):
        queries, pauses = iter(Query(*p) for p in plan), []
        return supervised(lambda: next(queries), attempts, 1.0, 8.0, pauses.append), pauses

    assert run([(0, True), (0, True), (5, True), (0, True), (0, False)], 2) == (4, [1.0, 2.0, 1.0, 2.0])
    with pytest.raises(RuntimeError):
        run([(0, True), (0, True), (0, True)], 2)


def test_spatial_join_of_large_and_small_polygons(spark):
    box = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    polygons = spark.createDataFrame([(1, "venue", box(-500.0, -500.0, 500.0, 500.0)), (1, "spot", box(10.0, 10.0, 10.01, 10.01)), (2, "other", box(0.0, 0.0, 1.0, 1.0))], "version int, profile_id string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([("a", 10.005, 10.005, 1), ("a", 10.005, 10.005, 1), ("a", 0.5, 0.5, 2), ("b", 499.0, -499.0, 1), ("c", 501.0, 0.0, 1), ("d", None, 0.0, 1), ("e", 0.5, 0.5, 3)], "point_id string, x double, y double, version int")
    got = sorted((r.point_id, r.version, r.status, tuple(r.matched)) for r in spatial.membership(points, polygons, ["version"]).collect())
    assert got == [("a", 1, "ambiguous", ("spot", "venue")), ("a", 1, "ambiguous", ("spot", "venue")), ("a", 2, "inside", ("other",)), ("b", 1, "inside", ("venue",)), ("c", 1, "outside", ()), ("d", 1, "outside", ()), ("e", 3, "outside", ())]
    none = polygons.limit(0)
    seen, bad = spatial.evaluate(points, none, none, polygons, none, ["version"])
    assert seen.count() == 7 and bad.count() == 0


def test_marks_leave_other_rows_alone(spark):
    rows = [(1, "processing", "w1", "e0"), (2, "processing", "w2", "e0"), (3, "pending", None, "old")]
    work = spark.createDataFrame([(i, s, T0, T0, c, 1, e) for i, s, c, e in rows], "id long, status string, available_at timestamp, lease_until timestamp, claimed_by string, attempts int, last_error string")
    errors = spark.createDataFrame([(i, "boom", True) for i in (1, 2, 3)], "id long, error string, retryable boolean")
    out = {r.id: r for r in queues.failed(work, "w1", errors, F.lit(T0), 3, 1.0, 10.0).collect()}
    assert (out[1].status, out[1].claimed_by, out[1].last_error, out[1].lease_until) == ("failed", None, "boom", None) and out[1].available_at > T0
    assert [(out[i].status, out[i].claimed_by, out[i].last_error, out[i].lease_until) for i in (2, 3)] == [("processing", "w2", "e0", T0), ("pending", None, "old", T0)]


def test_registry_allow_lists():
    r = rules.Registry(evaluators=("dwell_threshold",))
    r.register(rules.Rule("dwell_threshold", "v1", rules.dwell_threshold, "dwell_interval"))
    for bad in (rules.Rule("queue_candidate", "v1", rules.queue_candidate, "x"), rules.Rule("dwell_threshold", "v2", rules.dwell_threshold, "x", engine_version="9"), rules.Rule("dwell_threshold", "v3", rules.dwell_threshold, "x", evidence="perhaps")):
        with pytest.raises(ValueError):
            r.register(bad)


def test_observed_counts(spark):
    from vigilspark.operators import counters

    df, seen = counters.observed(spark.range(10), "numbers", even=F.col("id") % 2 == 0, large=F.col("id") > 7)
    assert df.count() == 10 and seen.get == {"even": 5, "large": 2}


def engine_facts(spark):
    t = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(1, "dwell_interval", "t", "cfg", t(0), 50.0, "a"), (2, "waiting_interval", "t", "cfg", t(1), 50.0, "a"), (3, "dwell_interval", None, "cfg", t(2), 50.0, "a"), (4, "other", "t", "cfg", t(3), 50.0, "a"), (5, None, "t", "cfg", t(4), 50.0, "a"), (6, "dwell_interval", "t", "cfg", t(5), -1.0, None)]
    df = spark.createDataFrame(rows, "n int, fact_type string, tenant string, config string, event_time timestamp, duration_seconds double, context string")
    return df.withColumns({"venue": F.lit("v"), "session": F.lit("s"), "camera": F.lit("c"), "track": F.lit("k"), "last_seen": F.col("event_time"), "interval_end": F.lit(None).cast("timestamp"), "first_occupancy": F.lit(1)})


def test_rules_of_a_fact_in_one_pass(spark):
    r = rules.default_registry()
    chosen = [("dwell_threshold", "v1", {"dwell_threshold_seconds": 10}), ("turnover_delay", "v1", {"turnover_delay_seconds": 1, "service_window_seconds": 2}), ("service_gap_candidate", "v1", {"service_gap_grace_seconds": 3, "service_area_ids": ["a"]})]
    out = r.evaluate_all(engine_facts(spark), chosen, ("n",))
    got = sorted((x.n, str(x.rule_id), str(x.status), str(x.reason), str(x.result_error), x.event_id is not None, x.evidence_ref_id is not None) for x in out.collect())
    assert got == sorted([
        (1, "dwell_threshold", "match", "None", "None", True, True), (1, "turnover_delay", "match", "None", "None", True, True), (2, "service_gap_candidate", "match", "None", "None", True, True),
        (3, "dwell_threshold", "invalid", "missing_scope", "None", False, False), (3, "turnover_delay", "invalid", "missing_scope", "None", False, False), (4, "None", "None", "None", "unknown_fact_type", False, False), (5, "None", "None", "None", "unknown_fact_type", False, False),
        (6, "dwell_threshold", "invalid", "negative_duration", "None", False, False), (6, "turnover_delay", "invalid", "negative_duration", "None", False, False),
    ])
    one = {x.n: x.event_id for x in r.evaluate("dwell_threshold", "v1", engine_facts(spark), {"dwell_threshold_seconds": 10}).collect()}
    many = {x.n: x.event_id for x in out.where("rule_id = 'dwell_threshold'").collect()}
    assert set(one) == {1, 3, 6} and one[1] == many[1]


def test_rules_pass_their_facts_once(spark, tmp_path):
    engine_facts(spark).write.parquet(str(tmp_path / "facts"))
    chosen = [("dwell_threshold", "v1", {"dwell_threshold_seconds": 10}), ("turnover_delay", "v1", {"turnover_delay_seconds": 1, "service_window_seconds": 2}), ("queue_candidate", "v1", {"waiting_qualification_seconds": 1, "queue_area_ids": ["a"]})]
    out = rules.default_registry().evaluate_all(spark.read.parquet(str(tmp_path / "facts")), chosen, ("n",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Exchange" not in plan


def test_wrong_results_carry_an_error_and_no_event(spark):
    ok = lambda **claims: lambda config: rules.Result(F.lit("match"), F.lit(None).cast("string"), F.lit("x"), {}, claims)
    wrong = {
        "foreign_rule": ok(rule_id=F.lit("another")), "mixed_configuration": ok(config=F.lit("other")), "event_time_changed": ok(event_time=F.col("event_time") + F.expr("INTERVAL 1 SECOND")), "match_without_event": ok(event_id=F.lit(None).cast("string")), "event_id_differs": ok(event_id=F.lit("made up")),
        "event_without_match": lambda c: rules.Result(F.lit("no_match"), F.lit(None).cast("string"), F.lit("x"), {}, {"event_id": F.lit("e")}), "invalid_without_reason": lambda c: rules.Result(F.lit("invalid"), F.lit(""), F.lit("x")), "unknown_status": lambda c: rules.Result(F.lit("maybe"), F.lit("r"), F.lit("x")),
    }
    r = rules.Registry()
    for name, result in wrong.items():
        r.register(rules.Rule(name, "v1", lambda df, c: df, "dwell_interval", result=result))
    out = r.evaluate_all(engine_facts(spark).where("n = 1"), [(n, "v1", {}) for n in wrong], ()).collect()
    assert {x.rule_id: x.result_error for x in out} == {n: n for n in wrong} and all(x.event_id is None and x.evidence_ref_id is None for x in out)
    bad = rules.Registry()
    bad.register(rules.Rule("r", "v1", lambda df, c: rules.dwell_threshold(df, c).withColumn("config", F.lit("other")), "dwell_interval"))
    assert bad.evaluate("r", "v1", engine_facts(spark).where("n = 1"), {"dwell_threshold_seconds": 10}).first()["result_error"] == "mixed_configuration"


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_arrive_at_once_are_taken_by_their_place(spark, turned):
    """One order whatever the order of the input: the earlier of two is applied, then the later."""
    rows = [("a", T0, "1", "present", 1), ("a", T0 + datetime.timedelta(seconds=5), "2", "present", 2), ("a", T0 + datetime.timedelta(seconds=9), "3", "absent", 2), ("a", T0 + datetime.timedelta(seconds=9), "4", "absent", 2)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "track string, t timestamp, frame string, kind string, arrival long").coalesce(1)
    told = temporal.arrival_status(df, ["track"], 1.0).orderBy("frame").collect()
    folded = temporal.presence(df, ["track"], Policy(), temporal.BY_ARRIVAL).orderBy("frame").collect()
    assert [r.status for r in told] == [r.status for r in folded] == ["applied"] * 4
