"""Operators on detections and tracks: filters, limits, suppression, association, guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import geometry as G
from vigilspark.functions import ids
from vigilspark.plans.tracker import Tracker, TrackPolicy


def confident(detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    return detections.where((F.col("confidence") >= threshold) & ~F.isnan("confidence"))


def normalized(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections with pixel corners x1, y1, x2, y2 as boxes; a frame with one malformed box is refused whole."""
    boxed = detections.withColumn("box", G.normalize_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height"))))
    bad = F.bool_or(F.col("box").isNull()).over(Window.partitionBy("frame_id"))
    marked = boxed.withColumn("_bad", bad)
    return marked.where(~F.col("_bad")).drop("_bad"), marked.where("_bad").drop("_bad").withColumn("error_code", F.when(F.col("box").isNull(), "malformed_box").otherwise("frame_refused"))


def batch_errors(batches: DataFrame, results: DataFrame) -> DataFrame:
    """What is wrong with a detector's answer to micro-batches, a row for each batch and frame: batch_id, frame_id, error_code.

    batches: batch_id, position, frame_id, session_id of the frames that were sent; results: batch_id, position, frame_id,
    session_id of the answers, one a frame. A batch whose number of answers differs is refused whole (count_differs), an
    answer at another frame's or session's place is foreign_result, one that came twice is duplicate_result.
    """
    sent = batches.groupBy("batch_id").agg(F.count("*").alias("_sent"))
    got = results.groupBy("batch_id").agg(F.count("*").alias("_got"))
    counts = sent.join(got, "batch_id", "left").where(F.coalesce("_got", F.lit(0)) != F.col("_sent")).select("batch_id", F.lit(None).cast(batches.schema["frame_id"].dataType).alias("frame_id"), F.lit("count_differs").alias("error_code"))
    once = results.groupBy("batch_id", "position").agg(F.count("*").alias("_n"), F.min("frame_id").alias("_frame"), F.max("frame_id").alias("_other"), F.min("session_id").alias("_session"))
    both = batches.join(once, ["batch_id", "position"])
    error = F.when(F.col("_n") > 1, "duplicate_result").when(~F.col("_frame").eqNullSafe(F.col("frame_id")) | ~F.col("_session").eqNullSafe(F.col("session_id")), "foreign_result")
    return both.withColumn("error_code", error).where("error_code is not null").select("batch_id", "frame_id", "error_code").unionByName(counts)


def limited(detections: DataFrame, most: int) -> DataFrame:
    """The first `most` detections of each frame in their order (column ord)."""
    return detections.withColumn("_n", F.row_number().over(Window.partitionBy("frame_id").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")


def suppressed(detections: DataFrame, iou: float = 0.45) -> DataFrame:
    """Greedy suppression in each frame and class: a box that overlaps a kept, more confident one by more than iou goes.

    Frames are small (detectors return a few hundred boxes), so a frame is one fold in the JVM.
    """
    boxes = detections.groupBy("frame_id", "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), F.col("ord"), F.col("box")))).alias("found"))
    empty = F.slice(F.col("found"), 1, 0)
    kept = F.aggregate("found", empty, lambda acc, d: F.when(F.exists(acc, lambda k: G.box_iou(k["box"], d["box"]) > iou), acc).otherwise(F.concat(acc, F.array(d))))
    return boxes.select("frame_id", "class_id", F.explode(kept).alias("d")).select("frame_id", "class_id", (-F.col("d.rank")).alias("confidence"), "d.ord", "d.box")


def guard_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames whose index advances, whose time does not regress and whose id is new in their session; and the rest."""
    w = Window.partitionBy("session_id").orderBy("arrival")
    index, time = F.lag("frame_index").over(w), F.lag("event_time").over(w)
    code = (
        F.when(F.row_number().over(Window.partitionBy("session_id", "frame_id").orderBy("arrival")) > 1, "duplicate_frame")
        .when(F.col("frame_index") <= index, "index_not_advancing")
        .when(F.col("event_time") < time, "time_regression")
    )
    marked = frames.withColumn("error_code", code)
    return marked.where("error_code is null").drop("error_code"), marked.where("error_code is not null")


def numbered(frames: DataFrame) -> DataFrame:
    """frame_index from 0 for the frames that decoded, by session."""
    good = frames.where("decoded")
    return good.withColumn("frame_index", F.row_number().over(Window.partitionBy("session_id").orderBy("arrival")) - 1)


def within_error_budget(frames: DataFrame, budget: int) -> DataFrame:
    """Frames of a session before `budget` decode errors in a row end it; failed frames are left out."""
    w = Window.partitionBy("session_id").orderBy("arrival")
    run = frames.withColumn("_good", F.count(F.when(F.col("decoded"), 1)).over(w))
    errors = run.withColumn("_errors", F.count(F.when(~F.col("decoded"), 1)).over(Window.partitionBy("session_id", "_good").orderBy("arrival")))
    ended = F.max((F.col("_errors") >= budget).cast("int")).over(w)
    return errors.withColumn("_ended", ended).where("_ended = 0 and decoded").drop("_good", "_errors", "_ended")


def class_switches(tracks: DataFrame) -> DataFrame:
    """Rows of a track whose class is not that of its first row."""
    w = Window.partitionBy("session_id", "track_id").orderBy("event_time", "frame_id")
    return tracks.withColumn("first_class", F.first("class_name").over(w)).where("class_name <> first_class")


def lifecycle(observed: DataFrame, frames: DataFrame, keep: int) -> DataFrame:
    """active where a track was observed in a frame, lost up to `keep` frames after, then terminated once."""
    seen = observed.select("session_id", "track_id", "frame_index").distinct()
    w = Window.partitionBy("session_id", "track_id").orderBy("frame_index")
    spans = seen.withColumn("next", F.lead("frame_index").over(w))
    last = frames.groupBy("session_id").agg(F.max("frame_index").alias("last_index"))
    ended = spans.join(last, "session_id").withColumn("stop", F.least(F.coalesce(F.col("next") - 1, F.col("last_index")), F.col("frame_index") + keep + 1))
    rows = ended.withColumn("at", F.explode(F.sequence("frame_index", "stop")))
    state = F.when(F.col("at") == F.col("frame_index"), "active").when(F.col("at") - F.col("frame_index") <= keep, "lost").otherwise("terminated")
    return rows.select("session_id", "track_id", F.col("at").alias("frame_index"), state.alias("track_state"))


def foreign_detections(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections whose frame and session are none of frames."""
    return detections.join(frames.select("frame_id", "session_id"), ["frame_id", "session_id"], "left_anti")


def associate(targets: DataFrame, detections: DataFrame, floor: float = 0.0) -> DataFrame:
    """Greedy one-to-one match of targets and detections in each frame, best overlap first, above the floor.

    Pairs overlap within one frame only; ties go to the smaller target, then the smaller detection. A frame's pairs are one row.
    """
    pairs = targets.withColumnRenamed("box", "target_box").join(detections.withColumnRenamed("box", "detection_box"), ["session_id", "frame_id"])
    scored = pairs.withColumn("iou", G.box_iou(F.col("target_box"), F.col("detection_box"))).where(F.col("iou") > floor)
    pair = F.struct((-F.col("iou")).alias("order"), "target_id", "detection_id")
    frames = scored.groupBy("session_id", "frame_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    none = F.filter("pairs", lambda p: F.lit(False))

    def take(kept: Column, p: Column) -> Column:
        busy = F.exists(kept, lambda k: (k["target_id"] == p["target_id"]) | (k["detection_id"] == p["detection_id"]))
        return F.when(busy, kept).otherwise(F.concat(kept, F.array(p)))

    kept = frames.select("session_id", "frame_id", F.explode(F.aggregate("pairs", none, take)).alias("p"))
    return kept.select("session_id", "frame_id", (-F.col("p.order")).alias("iou"), "p.target_id", "p.detection_id")


def track(frames: DataFrame, detections: DataFrame, policy: TrackPolicy) -> tuple[DataFrame, DataFrame]:
    """Track observations, and frames that the order guard refused with error_code.

    frames: session_id, arrival, frame_id, frame_index, event_time, source_ref. detections: session_id, frame_id,
    detection_id, class_name, confidence, box. Rows are observations (session_id, frame_id, event_time, track_id,
    local_track_id, detection_id, track_state, matched). A session's frames pass one task in order of arrival, one frame at a
    time; detections without box or score are left out, those of frames that don't come are nobody's.
    """
    box = F.col("box")
    own = F.struct("detection_id", "class_name", F.col("confidence").cast("double").alias("score"), F.array(*(box[c].cast("double") for c in ("x_min", "y_min", "x_max", "y_max"))).alias("box"))
    seen = detections.where(F.col("confidence").isNotNull() & box.isNotNull()).groupBy("session_id", "frame_id").agg(F.array_sort(F.collect_list(own)).alias("found"))  # one frame's
    rows = frames.select("session_id", "arrival", "frame_id", "frame_index", "event_time", "source_ref").join(seen, ["session_id", "frame_id"], "left")
    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("session_id", "arrival", "frame_id")}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", event_time timestamp, local_track_id int, detection_id {detections.schema['detection_id'].dataType.simpleString()}, track_state string, matched boolean, error_code string"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, tracker = None, None
        for f in batches:
            out = []
            for s, arrival, frame, index, at, source, found in zip(*(f[c] for c in ("session_id", "arrival", "frame_id", "frame_index", "event_time", "source_ref", "found")), strict=True):
                if tracker is None or s != session:
                    session, tracker = s, Tracker(policy)
                missing = pd.isna(at)
                plain = lambda v: None if pd.isna(v) else v
                error = tracker.guard(plain(frame), plain(index), None if missing else at.value, plain(source)) if plain(s) is not None else "incomplete_frame"
                if error:
                    out.append((s, arrival, frame, at, None, None, None, None, error))
                    continue
                own = [] if found is None else [dict(d, box=tuple(d["box"])) for d in found]
                out += [(s, arrival, frame, at, *x, None) for x in tracker.step(own)]
            yield pd.DataFrame(out, columns=names).astype({"local_track_id": "Int32"})

    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "arrival")
    got = dealt.mapInPandas(run, schema)
    good = got.where("error_code is null").withColumn("track_id", ids.track_uuid(F.col("session_id"), F.col("local_track_id")))
    return good.drop("error_code", "arrival"), got.where("error_code is not null").select("session_id", "arrival", "frame_id", "error_code")
