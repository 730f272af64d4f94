"""Queries: detection filters, suppression, association, frame guards, queues of frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.functions import geometry as G
from vigilspark.operators import detection
from vigilspark.plans.tracker import TrackPolicy
from vigilspark.sources import frames


def boxes(spark, d):
    """Line items as boxes of a frame (the order)."""
    li = table(spark, d, "lineitem").withColumn("ord", F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000)
    x, y = F.col("l_discount") * 5, F.col("l_tax") * 5
    box = F.struct(x.alias("x_min"), y.alias("y_min"), (x + F.col("l_quantity") / 100).alias("x_max"), (y + F.col("l_quantity") / 100).alias("y_max"))
    keys = li.select(F.col("l_orderkey").alias("frame_id"), F.lit("s").alias("session_id"), (F.col("l_linenumber") % 2).alias("class_id"), F.col("l_linenumber").alias("line"), "ord", "l_extendedprice", (F.col("l_extendedprice") / 110000).alias("confidence"), box.alias("box"))
    w = Window.partitionBy("frame_id", "ord").orderBy("line", "l_extendedprice")
    return keys.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "line")


_BOXES = """raw AS (SELECT *, l_partkey * 1000 + l_suppkey % 1000 AS ord FROM lineitem), boxes AS (SELECT l_orderkey AS frame_id, l_linenumber % 2 AS class_id, ord, l_extendedprice / 110000 AS confidence,
l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 5 + l_quantity / 100 AS y1 FROM raw QUALIFY row_number() OVER (PARTITION BY l_orderkey, ord ORDER BY l_linenumber, l_extendedprice) = 1)"""


@query(f"WITH {_BOXES} SELECT frame_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY ord) AS n FROM boxes WHERE confidence >= 0.3) WHERE n <= 3")
def track_confident_limited(spark, d):
    return detection.limited(detection.confident(boxes(spark, d), 0.3), 3).select("frame_id", "ord")


@query(f"""WITH RECURSIVE {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY confidence DESC, ord) AS n FROM boxes),
w AS (SELECT frame_id, class_id, 1::BIGINT AS n, [{{'o': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM r WHERE n = 1
UNION ALL SELECT r.frame_id, r.class_id, r.n, CASE WHEN len(list_filter(w.kept, lambda k: greatest(0, least(k.x1, r.x1) - greatest(k.x0, r.x0)) * greatest(0, least(k.y1, r.y1) - greatest(k.y0, r.y0)) / ((k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - greatest(0, least(k.x1, r.x1) - greatest(k.x0, r.x0)) * greatest(0, least(k.y1, r.y1) - greatest(k.y0, r.y0))) > 0.2)) > 0 THEN w.kept
 ELSE list_append(w.kept, {{'o': r.ord, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) END FROM w JOIN r ON r.frame_id = w.frame_id AND r.class_id = w.class_id AND r.n = w.n + 1),
l AS (SELECT frame_id, class_id, max_by(kept, n) AS kept FROM w GROUP BY ALL) SELECT frame_id, class_id, k.o AS ord FROM (SELECT frame_id, class_id, unnest(kept) AS k FROM l)""")
def track_suppressed(spark, d):
    return detection.suppressed(boxes(spark, d), 0.2).select("frame_id", "class_id", "ord")


@query(f"""WITH RECURSIVE {_BOXES}, i AS (SELECT a.frame_id, a.ord AS t, b.ord AS d, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas
  FROM boxes a JOIN boxes b ON a.frame_id = b.frame_id AND a.class_id = 0 AND b.class_id = 1), p AS (SELECT frame_id, t, d, s / (areas - s) AS iou, row_number() OVER (PARTITION BY frame_id ORDER BY s / (areas - s) DESC, t, d) AS n FROM i WHERE s / (areas - s) > 0.05),
w AS (SELECT frame_id, n, [t] AS ts, [d] AS ds, true AS free FROM p WHERE n = 1 UNION ALL SELECT p.frame_id, p.n, CASE WHEN ok THEN list_append(ts, p.t) ELSE ts END, CASE WHEN ok THEN list_append(ds, p.d) ELSE ds END, ok
  FROM (SELECT w.*, p.t, p.d, p.n AS m, NOT list_contains(ts, p.t) AND NOT list_contains(ds, p.d) AS ok FROM w JOIN p ON p.frame_id = w.frame_id AND p.n = w.n + 1) w JOIN p ON p.frame_id = w.frame_id AND p.n = w.m)
SELECT frame_id, t AS target_id, d AS detection_id, round(iou, 6) AS iou FROM w JOIN p USING (frame_id, n) WHERE free""")
def track_associated(spark, d):
    """Boxes of odd lines as detections, of even ones as targets."""
    b = boxes(spark, d)
    t = b.where("class_id = 0").select("session_id", "frame_id", F.col("ord").alias("target_id"), "box")
    e = b.where("class_id = 1").select("session_id", "frame_id", F.col("ord").alias("detection_id"), "box")
    return detection.associate(t, e, 0.05).select("frame_id", "target_id", "detection_id", F.round("iou", 6).alias("iou"))


@query(f"""WITH {_BOXES} SELECT frame_id, a, b, round(i / u, 6) AS iou FROM (SELECT a.frame_id AS frame_id, a.ord AS a, b.ord AS b, i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i AS u FROM (
SELECT a, b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM boxes a JOIN boxes b ON a.frame_id = b.frame_id AND a.ord < b.ord AND a.class_id = b.class_id) z)""")
def track_iou(spark, d):
    b = boxes(spark, d)
    o = b.select("frame_id", "class_id", F.col("ord").alias("b"), F.col("box").alias("other"))
    return b.join(o, ["frame_id", "class_id"]).where("ord < b").select("frame_id", F.col("ord").alias("a"), "b", F.round(G.box_iou(F.col("box"), F.col("other")), 6).alias("iou"))


def stream_of_frames(spark, d):
    """Events as frames of a session (the user): index with jumps back, some ids twice, some not decoded."""
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("session_id"), k.alias("arrival"), F.when(k % 29 == 0, F.lit(0).cast("long")).otherwise(k).alias("frame_index"), F.when(k % 31 == 0, F.lit(-1).cast("long")).otherwise(k).alias("frame_id"), F.col("ts").alias("event_time"), (k * 7 % 5 != 0).alias("decoded"))


_FRAMES = "f AS (SELECT user_id AS session_id, event_id AS arrival, CASE WHEN event_id % 29 = 0 THEN 0 ELSE event_id END AS frame_index, CASE WHEN event_id % 31 = 0 THEN -1 ELSE event_id END AS frame_id, ts AS event_time, event_id * 7 % 5 <> 0 AS decoded FROM events)"


@query(f"""WITH {_FRAMES}, c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, frame_id ORDER BY arrival) > 1 THEN 'duplicate_frame' WHEN frame_index <= lag(frame_index) OVER w THEN 'index_not_advancing' WHEN event_time < lag(event_time) OVER w THEN 'time_regression' END AS error_code FROM f WINDOW w AS (PARTITION BY session_id ORDER BY arrival))
SELECT session_id, arrival, error_code FROM c WHERE error_code IS NOT NULL""")
def frame_guard(spark, d):
    return detection.guard_frames(stream_of_frames(spark, d))[1].select("session_id", "arrival", "error_code")


@query(f"WITH {_FRAMES} SELECT session_id, arrival, row_number() OVER (PARTITION BY session_id ORDER BY arrival) - 1 AS frame_index FROM f WHERE decoded")
def frame_numbers(spark, d):
    return detection.numbered(stream_of_frames(spark, d)).select("session_id", "arrival", F.col("frame_index").cast("long").alias("frame_index"))


@query(f"""WITH {_FRAMES}, r AS (SELECT *, count(*) FILTER (decoded) OVER (PARTITION BY session_id ORDER BY arrival) AS g FROM f), e AS (SELECT *, count(*) FILTER (NOT decoded) OVER (PARTITION BY session_id, g ORDER BY arrival) AS errors FROM r),
m AS (SELECT *, bool_or(errors >= 2) OVER (PARTITION BY session_id ORDER BY arrival) AS ended FROM e) SELECT session_id, arrival FROM m WHERE decoded AND NOT ended""")
def frame_error_budget(spark, d):
    return detection.within_error_budget(stream_of_frames(spark, d), 2).select("session_id", "arrival")


@query(f"WITH {_FRAMES} SELECT session_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival DESC) AS n FROM f) WHERE n <= 8")
def frame_newest(spark, d):
    return frames.newest(stream_of_frames(spark, d), 8)[0].select("session_id", "arrival")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_microseconds(((o_orderkey % 100) * 40000)::BIGINT) WHEN o_orderkey % 3 = 1 THEN o_orderdate END AS event_time FROM orders WHERE o_orderkey % 3 <> 2""")
def frame_event_time(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, t).alias("capture_time"), ((k % 100) * 0.04).alias("pts_seconds"), F.when(k % 3 == 1, t).alias("container_time"))
    return frames.resolved_times(o)[0].select("o_orderkey", "event_time")


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 20 AS track, l_linenumber AS i FROM lineitem WHERE (l_suppkey % 20) * 7 % 11 + l_linenumber <> 9 AND (l_suppkey + l_linenumber) % 3 <> 0), n AS (SELECT *, lead(i) OVER (PARTITION BY track ORDER BY i) AS nxt FROM s),
r AS (SELECT track, i, unnest(range(i, least(coalesce(nxt - 1, 7), 7, i + 2) + 1)) AS pos FROM n) SELECT track AS track_id, pos::INTEGER AS frame_index, CASE WHEN pos = i THEN 'active' WHEN pos - i <= 1 THEN 'lost' ELSE 'terminated' END AS track_state FROM r""")
def track_lifecycle(spark, d):
    li = table(spark, d, "lineitem").select(F.lit("s").alias("session_id"), (F.col("l_suppkey") % 20).alias("track_id"), F.col("l_linenumber").alias("frame_index"), "l_suppkey")
    seen = li.where("track_id * 7 % 11 + frame_index <> 9 and (l_suppkey + frame_index) % 3 <> 0").drop("l_suppkey")
    return detection.lifecycle(seen, li.select("session_id", "frame_index"), 1).select("track_id", "frame_index", "track_state")


@query("WITH f AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events) SELECT event_id, first AS first_class, event_type AS class_name FROM f WHERE event_type <> first")
def track_class_switches(spark, d):
    e = table(spark, d, "events").select(F.lit("s").alias("session_id"), F.col("user_id").alias("track_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("class_name"))
    return detection.class_switches(e).select(F.col("frame_id").alias("event_id"), "first_class", "class_name")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def track_foreign_detections(spark, d):
    f = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame_id"), F.lit("s").alias("session_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.lit("s").alias("session_id"), "l_partkey")
    return detection.foreign_detections(li, f).select(F.col("frame_id").alias("l_orderkey"), "l_partkey")


def _tracked(spark, d):
    """Orders of a customer as frames of a session in order of time, some late or twice, and their line items as detections."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    frame = o.select(
        (F.col("o_custkey") % 40).alias("session_id"), F.col("o_orderdate").alias("day"), k.alias("frame_id"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.when(k % 97 == 0, "other").otherwise("cam").alias("source_ref"),
    ).withColumn("arrival", F.row_number().over(Window.partitionBy("session_id").orderBy("day", "frame_id")))
    frame = frame.withColumn("frame_index", F.when(F.col("frame_id") % 31 == 0, F.col("arrival") - 3).otherwise(F.col("arrival"))).drop("day")
    sessions = o.select(k.alias("frame_id"), (F.col("o_custkey") % 40).alias("session_id"))
    found = boxes(spark, d).drop("session_id").join(sessions, "frame_id").select("session_id", "frame_id", F.col("ord").alias("detection_id"), F.concat(F.lit("k"), (F.col("ord") % 2).cast("string")).alias("class_name"), "confidence", "box")
    return detection.track(frame, found, TrackPolicy(floor=0.05, buffer=2, start=0.2))


@query()
def track_observations(spark, d):
    """A tracker over all sessions; its association and ends depend on their past, so tests compare with brute force."""
    return _tracked(spark, d)[0].select("session_id", "frame_id", "local_track_id", "detection_id", "track_state", "matched")


@query("""WITH f AS (SELECT o_custkey % 40 AS session_id, o_orderkey AS frame_id, o_orderkey % 97 = 0 AS other, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate, o_orderkey) AS arrival FROM orders),
i AS (SELECT *, CASE WHEN frame_id % 31 = 0 THEN arrival - 3 ELSE arrival END AS idx FROM f), s AS (SELECT *, first_value(other) OVER (PARTITION BY session_id ORDER BY arrival) AS own FROM i)
SELECT session_id, arrival::INTEGER AS arrival, frame_id, CASE WHEN other <> own THEN 'foreign_source' ELSE 'index_not_advancing' END AS error_code FROM s
WHERE other <> own OR idx <= (SELECT max(x.idx) FROM s x WHERE x.session_id = s.session_id AND x.arrival < s.arrival AND x.other = x.own)""")
def track_refused(spark, d):
    return _tracked(spark, d)[1]


@query("""WITH b AS (SELECT l_orderkey AS frame_id, l_partkey * 10 + l_linenumber AS id, l_discount * 6400 / 640 AS a, l_tax * 4800 / 480 AS b, l_quantity / 60 AS w FROM lineitem), n AS (SELECT *, a + w <= 1 + 1e-6 AND b + w <= 1 + 1e-6 AND w > 0 AS ok FROM b),
f AS (SELECT *, bool_or(NOT ok) OVER (PARTITION BY frame_id) AS bad FROM n) SELECT frame_id, id, CASE WHEN NOT bad THEN 'ok' WHEN ok THEN 'frame_refused' ELSE 'malformed_box' END AS outcome FROM f""")
def track_normalized(spark, d):
    """Boxes of an order's lines in pixels; one that leaves the frame has the whole frame refused."""
    x, y, w = F.col("l_discount") * 6400, F.col("l_tax") * 4800, F.col("l_quantity") / 60
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x1"), y.alias("y1"), (x + w * 640).alias("x2"), (y + w * 480).alias("y2"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    good, bad = detection.normalized(li)
    return good.select("frame_id", "id", F.lit("ok").alias("outcome")).unionByName(bad.select("frame_id", "id", F.col("error_code").alias("outcome")))


@query("""WITH b AS (SELECT o_orderkey AS frame_id, o_custkey AS batch_id, o_orderkey % 17 = 3 AS lost, o_orderkey % 19 = 4 AS twice, o_orderkey % 23 = 5 AS swapped FROM orders)
SELECT batch_id, frame_id, CASE WHEN twice THEN 'duplicate_result' ELSE 'foreign_result' END AS error_code FROM b WHERE NOT lost AND (twice OR swapped)
UNION ALL SELECT batch_id, NULL, 'count_differs' FROM b GROUP BY batch_id HAVING count(*) FILTER (lost) <> count(*) FILTER (twice AND NOT lost)""")
def track_batch_errors(spark, d):
    """A customer's orders as a micro-batch; some answers are lost, doubled or of another frame."""
    k = F.col("frame_id")
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("position"), F.lit("s").alias("session_id"))
    r = b.where("frame_id % 17 <> 3").withColumn("frame_id", F.when(k % 23 == 5, -k).otherwise(k))
    return detection.batch_errors(b, r.unionByName(r.where("abs(frame_id) % 19 = 4")))
