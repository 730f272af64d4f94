"""Queries: one cycle of the evidence worker, with all of its outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.catalog.queues import NOW, _now
from vigilspark.operators import evidence_worker

_STATES = ("requested", "queued", "extracting", "uploading", "retryable_failure", "finalized")
SETTINGS = evidence_worker.Settings(batch=400, lease_seconds=60, request_timeout_seconds=400 * 86400.0, most_attempts=4)
_KINDS = ("success", "partial", "success", "cancelled", "success", "source_not_found", "failed", "success", "corrupt_source", "success")


def _cycle(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    shift = lambda seconds: F.timestamp_micros(F.unix_micros(t) + seconds * 1_000_000)
    o = table(spark, d, "orders")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    text, sha = k.cast("string"), F.sha2(k.cast("string"), 256)
    work = o.select(
        k.alias("id"), F.when(k % 41 != 0, of(_STATES, F.floor(k / 3))).alias("state"), t.alias("created_at"), F.when(k % 4 != 0, F.timestamp_micros(F.unix_micros(_now()) + (k % 9 - 4) * 3600000000)).alias("retry_at"),
        F.when(k % 5 != 0, F.timestamp_micros(F.unix_micros(_now()) + (k % 7 - 5) * 60000000)).alias("lease_until"), F.lit("w0").alias("claimed_by"), (k % 6).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"),
        (k % 31 != 0).alias("has_request"), (k * 10).alias("event_id"), F.lit("t").alias("tenant_id"), F.lit("v").alias("venue_id"), F.lit(None).cast("string").alias("video_asset_id"), F.when(k % 17 != 3, "c").alias("camera_id"),
        F.lit(None).cast("string").alias("session_id"), t.alias("start_time"), shift(100).alias("end_time"), F.when(k % 8 != 1, F.concat(F.lit("kept/"), text)).alias("media_path"), F.when(k % 8 != 1, F.when(k % 8 == 2, "zz").otherwise(sha)).alias("checksum"),
    )
    candidates = o.where("o_orderkey % 13 <> 5").select(
        k.alias("ref_id"), F.lit("t").alias("rec_tenant"), F.when(k % 23 == 4, "x").otherwise("v").alias("rec_venue"), F.lit("a").alias("asset_id"), F.lit("c").alias("rec_camera"), F.lit("s").alias("rec_session"), shift(F.when(k % 3 == 0, 10).otherwise(-10)).alias("rec_start"),
        shift(200).alias("rec_end"), (k % 29 != 6).alias("available"),
    )
    errors = o.where("o_orderkey % 19 = 7").select(k.alias("ref_id"), F.lit("gone").alias("error"))
    extractions = o.where("o_orderkey % 37 <> 8").select(
        k.alias("ref_id"), F.when(k % 43 == 9, 0).otherwise(k * 10).cast("long").alias("event_id"), of(_KINDS, F.floor(k / 2)).alias("status"), F.when(k % 47 != 10, F.concat(F.lit("new/"), text)).alias("media_path"), F.when(k % 53 == 11, F.upper(sha)).otherwise(sha).alias("checksum"),
        F.when(k % 2 == 0, "the reason").alias("reason"),
    )
    return evidence_worker.cycle(work, candidates, errors, extractions, "w9", _now(), SETTINGS)


# Each step numbers the rows that it applies to by (created, id) and takes the first 400.
_STEPS = f"""n AS (SELECT TIMESTAMP '{NOW}' AS now), w0 AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS c, CASE WHEN o_orderkey % 41 <> 0 THEN ['requested','queued','extracting','uploading','retryable_failure','finalized'][o_orderkey // 3 % 6 + 1] ELSE 'requested' END AS st,
  CASE WHEN o_orderkey % 4 <> 0 THEN now + to_microseconds(((o_orderkey % 9 - 4) * 3600000000)::BIGINT) END AS retry, CASE WHEN o_orderkey % 5 <> 0 THEN now + to_microseconds(((o_orderkey % 7 - 5) * 60000000)::BIGINT) END AS lease, 'w0' AS who, (o_orderkey % 6)::INTEGER AS tries, NULL::VARCHAR AS err, NULL::VARCHAR AS step, now FROM orders, n),
w1 AS (SELECT * REPLACE (CASE WHEN st = 'requested' AND row_number() OVER (PARTITION BY st = 'requested' ORDER BY c, id) <= 400 THEN 'queued' ELSE st END AS st) FROM w0),
w2 AS (SELECT * EXCLUDE (g) REPLACE (CASE WHEN g THEN 'expired' ELSE st END AS st, CASE WHEN g THEN 'abandoned evidence request expired' END AS err, CASE WHEN g THEN 'expired' END AS step) FROM
  (SELECT *, old AND row_number() OVER (PARTITION BY old ORDER BY c, id) <= 400 AS g FROM (SELECT *, st IN ('requested', 'queued') AND c <= now - INTERVAL 400 DAY AS old FROM w1)) x),
w3 AS (SELECT * EXCLUDE (g, old, stale) REPLACE (CASE WHEN g AND st = 'extracting' THEN 'retryable_failure' ELSE st END AS st, CASE WHEN g AND st = 'extracting' THEN now ELSE retry END AS retry, CASE WHEN g THEN CASE WHEN st = 'uploading' THEN now + INTERVAL 60 SECOND END ELSE lease END AS lease, CASE WHEN g THEN 'w9' ELSE who END AS who,
  CASE WHEN g AND st = 'extracting' THEN 'lease expired - crashed claim recovered' ELSE err END AS err, CASE WHEN g THEN CASE st WHEN 'uploading' THEN 'resumed' ELSE 'recovered' END ELSE step END AS step) FROM
  (SELECT *, stale AND row_number() OVER (PARTITION BY stale ORDER BY c, id) <= 400 AS g FROM (SELECT *, coalesce(st IN ('extracting', 'uploading') AND lease <= now, false) AS stale FROM w2)) x),
w4 AS (SELECT * EXCLUDE (g, due) REPLACE (CASE WHEN g THEN 'queued' ELSE st END AS st, CASE WHEN NOT g THEN retry END AS retry, CASE WHEN g THEN 'promoted' ELSE step END AS step) FROM
  (SELECT *, due AND row_number() OVER (PARTITION BY due ORDER BY c, id) <= 400 AS g FROM (SELECT *, st = 'retryable_failure' AND (retry IS NULL OR retry <= now) AS due FROM w3)) x),
w5 AS (SELECT * EXCLUDE (g, free) REPLACE (CASE WHEN g THEN 'extracting' ELSE st END AS st, CASE WHEN g THEN now + INTERVAL 60 SECOND ELSE lease END AS lease, CASE WHEN g THEN 'w9' ELSE who END AS who, CASE WHEN g THEN tries + 1 ELSE tries END AS tries, CASE WHEN g THEN 'claimed' ELSE step END AS step) FROM
  (SELECT *, free AND row_number() OVER (PARTITION BY free ORDER BY c, id) <= 400 AS g FROM (SELECT *, st = 'queued' AND (lease IS NULL OR lease <= now) AS free FROM w4)) x),
x AS (SELECT *, ['success','partial','success','cancelled','success','source_not_found','failed','success','corrupt_source','success'][id // 2 % 10 + 1] AS kind, CASE WHEN id % 2 = 0 THEN 'the reason' END AS said FROM w5),
o AS (SELECT *, CASE WHEN step = 'resumed' THEN CASE WHEN id % 8 = 1 THEN 'T:upload checkpoint missing' WHEN id % 31 = 0 THEN 'T:request contract missing' WHEN id % 8 = 2 THEN 'T:checkpoint artifact failed integrity verification' ELSE 'F:' END
  WHEN step = 'claimed' THEN CASE WHEN id % 31 = 0 THEN 'T:request contract missing' WHEN id % 19 = 7 THEN 'R:source candidate lookup failed: gone' WHEN id % 13 <> 5 AND id % 23 = 4 THEN 'T:foreign_venue' WHEN id % 17 = 3 THEN 'T:no_identity' WHEN id % 13 = 5 THEN 'T:no_match' WHEN id % 29 = 6 THEN 'T:unavailable'
    WHEN id % 37 = 8 OR kind = 'cancelled' THEN 'W:' WHEN kind IN ('source_not_found', 'corrupt_source') THEN 'T:' || coalesce(said, kind) WHEN kind = 'failed' THEN 'R:' || coalesce(said, 'extraction failed') WHEN id % 47 = 10 OR id % 53 = 11 AND sha256(id::VARCHAR) <> upper(sha256(id::VARCHAR)) THEN 'R:artifact integrity verification failed'
    WHEN id % 43 = 9 THEN 'P:package of another event' ELSE 'F:' END END AS oc FROM x),
e AS (SELECT *, CASE WHEN oc[1] = 'R' AND tries >= 4 THEN 'T:retry budget exhausted: ' || oc[3:] ELSE oc END AS out FROM o),
f AS (SELECT id, CASE WHEN out[1] = 'F' THEN 'finalized' WHEN out[1] IN ('T', 'P') THEN 'terminal_failure' WHEN out[1] = 'R' THEN 'retryable_failure' ELSE st END AS state, who, tries, lease, CASE WHEN out[1] = 'R' THEN now + to_microseconds((least(600, 5 * 2 ** (tries - 1)) * 1000000)::BIGINT) ELSE retry END AS retry,
  CASE WHEN out[1] IN ('T', 'P', 'R') THEN out[3:] ELSE err END AS err, CASE WHEN step = 'claimed' AND out[1] IN ('F', 'P') THEN 'new/' || id WHEN id % 8 <> 1 THEN 'kept/' || id END AS media, out, step FROM e)"""


@query(f"WITH {_STEPS} SELECT id, state, who AS claimed_by, tries AS attempts, lease AS lease_until, retry AS retry_at, err AS last_error, media AS media_path FROM f")
def evidence_worker_cycle(spark, d):
    """The requests after one cycle of at most 400 rows a step."""
    return _cycle(spark, d)[0].select("id", "state", "claimed_by", "attempts", "lease_until", "retry_at", "last_error", "media_path")


@query(f"WITH {_STEPS} SELECT id AS ref_id, CASE WHEN step = 'resumed' OR out[1] = 'P' THEN 'uploading' WHEN out IS NOT NULL THEN 'extracting' END AS previous, state AS status, CASE WHEN out[1] = 'F' THEN NULL WHEN out IS NULL THEN err ELSE out[3:] END AS reason FROM f WHERE out[1] <> 'W' OR step IN ('expired', 'recovered')")
def evidence_worker_log(spark, d):
    return _cycle(spark, d)[2]


@query(f"WITH {_STEPS} SELECT id AS ref_id, 't' AS tenant_id, 'v' AS venue_id, 'evidence for event ' || id * 10 AS description FROM f WHERE out[1] = 'F'")
def evidence_worker_packages(spark, d):
    return _cycle(spark, d)[1].drop("package_id")
