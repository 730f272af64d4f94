"""Evidence: source coverage of requests, gaps, packages and their provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import ids

#: Lengths of intervals are sorted into levels: a cell of a level is 2**level microseconds long, at least a second's.
LEVELS = (20, 62)
_RECORDING = {"start_time": "rec_start", "end_time": "rec_end", "camera_id": "rec_camera", "session_id": "rec_session", "venue_id": "rec_venue"}
#: Identities of a source, and a recording's column for each.
IDENTITIES = {"video_asset_id": "asset_id", "camera_id": "rec_camera", "session_id": "rec_session"}


def _level(start: str, end: str) -> Column:
    length = F.greatest(F.unix_micros(end) - F.unix_micros(start), F.lit(1)).cast("double")
    return F.greatest(F.least(F.ceil(F.log2(length)), F.lit(LEVELS[1])), F.lit(LEVELS[0])).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(F.unix_micros(at) / F.pow(F.lit(2.0), level)).cast("bigint")


def overlapping(requests: DataFrame, recordings: DataFrame, on: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Requests with the recordings of equal `on` that overlap their window, touching ends included.

    A pair meets at the level of its longer interval. Each side is listed there under the one or two cells that it covers:
    at its own level, and, to meet longer intervals of the other side, at the levels that those have. So neither long
    windows nor short recordings fill many cells, and a busy tenant is spread over its cells. A pair counts in its first
    common cell. An interval that ends before it starts, or without an end, overlaps nothing.
    """
    keys = list(on)
    r = requests.where("start_time <= end_time").withColumn("_own", _level("start_time", "end_time"))
    names = {k: v for k, v in _RECORDING.items() if k not in keys}
    c = recordings.withColumnsRenamed(names).where("rec_start <= rec_end").withColumn("_own", _level("rec_start", "rec_end"))
    # at most one row for each level of a key
    levels = lambda df: df.select(*keys, F.col("_own").alias("_level")).distinct()

    def listed(df: DataFrame, start: str, end: str, other: DataFrame) -> DataFrame:
        at = df.join(other.groupBy(*keys).agg(F.collect_set("_level").alias("_levels")), keys)  # at most LEVELS values
        level = F.explode(F.array_distinct(F.concat(F.filter("_levels", lambda x: x > F.col("_own")), F.array("_own"))))
        at = at.withColumn("_level", level).drop("_levels")
        return at.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level")))))

    left = listed(r, "start_time", "end_time", levels(c)).withColumnRenamed("_own", "_left")
    right = listed(c, "rec_start", "rec_end", levels(r)).withColumnRenamed("_own", "_right")
    both = left.join(right, [*keys, "_level", "_cell"]).where("_level = greatest(_left, _right) and rec_start <= end_time and rec_end >= start_time")
    first = _cell(F.greatest("start_time", "rec_start"), F.col("_level"))
    return both.where(F.col("_cell") == first).drop("_level", "_cell", "_left", "_right")


def with_window(requests: DataFrame) -> DataFrame:
    """Requests whose window is that of their event where they name none."""
    return requests.withColumns({"start_time": F.coalesce("start_time", "event_time"), "end_time": F.coalesce("end_time", "event_time")})


def resolve(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """ref_id, resolution, reason, covered_seconds and gap_text of each request, from its candidates.

    requests: ref_id, tenant_id, venue_id, video_asset_id, camera_id, session_id, start_time, end_time. candidates: ref_id
    with rec_tenant, rec_venue, asset_id, rec_camera, rec_session, rec_start, rec_end, available, which the caller scoped.

    auth_failure: the request has no tenant or venue, or any candidate is of another one. not_found: the request names no
    source, no candidate equals every identity that it names, none of those is available, or none covers any of the window
    (of an instant: all of it). Else resolved, or partial with its gaps.
    """
    asked = requests.select("ref_id", "tenant_id", "venue_id", *IDENTITIES, "start_time", "end_time")
    foreign = F.when(~F.col("rec_tenant").eqNullSafe(F.col("tenant_id")), "foreign_tenant").when(~F.col("rec_venue").eqNullSafe(F.col("venue_id")), "foreign_venue")
    same = reduce(lambda a, b: a & b, (F.col(a).isNull() | F.col(a).eqNullSafe(F.col(b)) for a, b in IDENTITIES.items()))
    own = candidates.select("ref_id", "rec_tenant", "rec_venue", "asset_id", "rec_camera", "rec_session", "rec_start", "rec_end", "available")
    near = own.join(asked, "ref_id").withColumns({"_foreign": foreign, "_same": same})
    near = near.withColumns({"_ok": F.col("_same") & F.coalesce("available", F.lit(False)), "_from": F.greatest("rec_start", "start_time"), "_to": F.least("rec_end", "end_time")})
    seen = near.groupBy("ref_id").agg(F.min("_foreign").alias("_foreign"), F.bool_or("_same").alias("_match"), F.bool_or("_ok").alias("_free"))
    w = Window.partitionBy("ref_id").orderBy("_from", F.col("asset_id").cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    reached = near.where("_ok and _from <= _to").withColumn("_reach", F.coalesce(F.max("_to").over(w), F.col("start_time")))
    gap = F.when(F.col("_from") > F.col("_reach"), F.struct(F.col("_reach").alias("a"), F.col("_from").alias("b")))
    swept = reached.groupBy("ref_id").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("_to").alias("top"), F.count("*").alias("n"))
    out = asked.join(swept, "ref_id", "left").join(seen, "ref_id", "left")
    tail = F.when(F.col("top") < F.col("end_time"), F.array(F.struct(F.col("top").alias("a"), F.col("end_time").alias("b")))).otherwise(F.slice("gaps", 1, 0))
    gaps = F.concat("gaps", tail)
    missing = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + F.unix_micros(g["b"]) - F.unix_micros(g["a"]))
    whole = F.unix_micros("end_time") - F.unix_micros("start_time")
    reason = (
        F.when(F.col("tenant_id").isNull() | F.col("venue_id").isNull(), "no_scope").when(F.col("_foreign").isNotNull(), F.col("_foreign"))
        .when(reduce(lambda a, b: a & b, (F.col(c).isNull() for c in IDENTITIES)), "no_identity").when(~F.coalesce("_match", F.lit(False)), "no_match").when(~F.col("_free"), "unavailable")
        .when(F.col("n").isNull(), "no_coverage").when((F.size(gaps) > 0) & (F.col("start_time") == F.col("end_time")), "no_coverage").when(F.size(gaps) > 0, "gaps")
    )
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "resolved").when(F.col("reason") == "gaps", "partial").when(F.col("reason").isin("no_scope", "foreign_tenant", "foreign_venue"), "auth_failure").otherwise("not_found")
    text = F.array_join(F.transform(gaps, lambda g: F.concat(ids.utc_second_text(g["a"]), F.lit("/"), ids.utc_second_text(g["b"]))), "; ")
    covered = F.col("reason").isNull() | (F.col("reason") == "gaps")
    return out.select("ref_id", status.alias("resolution"), "reason", F.when(covered, (whole - missing) / 1e6).otherwise(0.0).alias("covered_seconds"), F.when(covered, text).alias("gap_text"))


#: The hops of a package's provenance, in order.
HOPS = ("event", "rule", "fact", "transition", "observation", "track", "detection", "frame", "session", "camera", "recording", "object")


def provenance_chain(packages: DataFrame) -> DataFrame:
    """ref_id, position, hop and id of every hop of each package (a column per hop)."""
    hops = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(h).alias("hop"), F.col(h).cast("string").alias("id")) for i, h in enumerate(HOPS)))
    return packages.select("ref_id", F.explode(hops).alias("h")).select("ref_id", "h.*")


def verify(packages: DataFrame, checks: dict) -> DataFrame:
    """Per package and check (name -> (left, right) Columns) pass, fail, or not_applicable where the left is null; and the verdict."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.when(a.isNull(), "not_applicable").when(a.eqNullSafe(b), "pass").otherwise("fail").alias("outcome")) for n, (a, b) in checks.items()))
    out = packages.withColumn("checks", each)
    return out.withColumn("verdict", F.when(F.exists("checks", lambda c: c["outcome"] == "fail"), "failed").otherwise("verified"))


def agree(ref: DataFrame, resolved: DataFrame, extraction: DataFrame, columns: list[str]) -> DataFrame:
    """Whether request, resolution and extraction name the same values: ref_id, agrees."""
    names = {"a": ref, "b": resolved, "c": extraction}
    joined = reduce(lambda x, y: x.join(y, "ref_id", "inner"), [d.select("ref_id", *(F.col(c).alias(f"{c}_{n}") for c in columns)) for n, d in names.items()])
    ok = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_c")) for c in columns])
    return joined.select("ref_id", ok.alias("agrees"))


def extraction_status(covered_partial, want_start, want_end, got_start, got_end):
    """partial where coverage is, or where the extracted window is narrower than the one asked for."""
    return F.when(covered_partial | (got_start > want_start) | (got_end < want_end), "partial").otherwise("complete")
