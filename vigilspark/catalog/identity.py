"""Queries: identities and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.catalog.rules import _uuid
from vigilspark.functions import ids, scalars


@query(f"SELECT o_orderkey, {_uuid('o_custkey || chr(58) || o_orderkey')} AS track_id, {_uuid('o_orderpriority || chr(233)')} AS other_id FROM orders")
def id_uuid5(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", ids.track_uuid(F.col("o_custkey"), F.col("o_orderkey")).alias("track_id"), ids.uuid5(F.concat("o_orderpriority", F.lit("é"))).alias("other_id"))


@query("""SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 = 0 THEN '' ELSE '.' || printf('%06d', epoch_us(t) % 1000000) END || '+00:00' AS iso,
  strftime(t, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS lease, 'presence|t|v|' || user_id || '|||' || event_type || '|' AS key FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS t FROM events)""")
def id_iso_and_key(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", F.col("ts").cast("timestamp"))).otherwise(F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("string")
    e = table(spark, d, "events").withColumn("t", t)
    return e.select("event_id", ids.iso(F.col("t")).alias("iso"), ids.lease_time(F.col("t")).alias("lease"), ids.key_canonical(F.lit("presence"), F.lit("t"), F.lit("v"), F.col("user_id"), none, none, F.col("event_type"), none).alias("key"))


@query("""SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS request_hash FROM orders""")
def id_content_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.content_hash(status=F.col("o_orderstatus"), key=F.col("o_orderkey")).alias("request_hash"))


@query("SELECT o_orderkey, least(300.0, 2.0 * pow(2, least(greatest(o_orderkey % 40, 1) - 1, 32))) AS delay, least(300.0, least(300.0, 2.0 * pow(2, least(greatest(o_orderkey % 40, 1) - 1, 32))) * 1.25) AS jittered FROM orders")
def fn_backoff(spark, d):
    n = F.col("o_orderkey") % 40
    return table(spark, d, "orders").select("o_orderkey", scalars.backoff(n, 2.0, 300.0).alias("delay"), scalars.backoff(n, 2.0, 300.0, F.lit(0.25)).alias("jittered"))


_CATEGORY = "CASE o_orderkey % 5 WHEN 0 THEN 'recordings' WHEN 1 THEN 'evidence' WHEN 2 THEN 'reports' WHEN 3 THEN 'analytics' ELSE 'temporary' END"
_CLASS = "CASE o_orderkey % 6 WHEN 0 THEN 'legal_hold' WHEN 1 THEN 'cctv_30_days' WHEN 2 THEN 'nonsense' WHEN 3 THEN 'report_730_days' END"


@query(f"""WITH a AS (SELECT *, {_CATEGORY} AS category, {_CLASS} AS wanted FROM orders),
b AS (SELECT *, CASE WHEN wanted IN ('legal_hold','cctv_30_days','report_730_days') THEN wanted ELSE CASE category WHEN 'recordings' THEN 'cctv_30_days' WHEN 'evidence' THEN 'evidence_365_days' WHEN 'reports' THEN 'report_730_days' WHEN 'analytics' THEN 'analytics_90_days' ELSE 'standard_90_days' END END AS class FROM a),
c AS (SELECT *, o_orderdate + CASE class WHEN 'cctv_30_days' THEN INTERVAL 30 DAY WHEN 'evidence_365_days' THEN INTERVAL 365 DAY WHEN 'report_730_days' THEN INTERVAL 730 DAY WHEN 'analytics_90_days' THEN INTERVAL 90 DAY WHEN 'standard_90_days' THEN INTERVAL 90 DAY END AS deadline FROM b)
SELECT o_orderkey, class, deadline, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN class = 'legal_hold' OR o_orderkey % 7 = 0 THEN 'preserved' WHEN TIMESTAMP '1999-01-01' >= deadline THEN 'expired' WHEN o_orderkey % 5 = 0 THEN 'deletion_pending' ELSE 'active' END AS state FROM c""")
def fn_retention(spark, d):
    k = F.col("o_orderkey")
    names = list(scalars.CATEGORY_CLASS)
    o = table(spark, d, "orders").withColumn("created", F.col("o_orderdate").cast("timestamp"))
    o = o.withColumn("category", F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int"))).withColumn("wanted", F.when(k % 6 == 0, "legal_hold").when(k % 6 == 1, "cctv_30_days").when(k % 6 == 2, "nonsense").when(k % 6 == 3, "report_730_days"))
    o = o.withColumn("class", scalars.retention_class(F.col("category"), F.col("wanted")))
    state = scalars.retention_state(F.col("class"), F.col("created"), F.lit("1999-01-01").cast("timestamp"), k % 7 == 0, k % 11 == 0, k % 5 == 0)
    return o.select("o_orderkey", "class", scalars.retention_deadline(F.col("class"), F.col("created")).cast("timestamp_ntz").alias("deadline"), state.alias("state"))


@query(f"""WITH k AS (SELECT o_orderkey, 'tenants/' || {_uuid('chr(116) || o_custkey')} || '/venues/' || {_uuid('chr(118) || o_custkey')} || '/' || CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE 'evidence' END || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || {_uuid('chr(97) || o_orderkey')} || '.jpg' AS key, strftime(o_orderdate, '%m') AS m FROM orders)
SELECT o_orderkey, key, CASE WHEN o_orderkey % 9 <> 0 THEN m END AS month, CASE WHEN o_orderkey % 9 <> 0 THEN 'jpg' END AS extension FROM k""")
def fn_object_keys(spark, d):
    u = lambda p, c: ids.uuid5(F.concat(F.lit(p), F.col(c).cast("string")))
    cat = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise("evidence")
    o = table(spark, d, "orders").withColumn("key", scalars.object_key(u("t", "o_custkey"), u("v", "o_custkey"), cat, u("a", "o_orderkey"), F.lit(".JPG"), F.col("o_orderdate").cast("timestamp")))
    p = scalars.parse_key(F.col("key"))
    return o.select("o_orderkey", "key", p["month"].alias("month"), p["extension"].alias("extension"))


_HEADS = ("89504E470D0A1A0A00", "FFD8FFE000", "255044462D312E37", "1F8B0800", "00000018667479706D703432", "EFBBBF207B2261223A317D", "FFFFFFFF", "")
_FORMATS = ("png", "jpeg", "pdf", "gzip-json", "mp4", "json", "unknown", "unknown")


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 8 AS h, CASE (o_orderkey // 8) % 3 WHEN 0 THEN 'evidence' WHEN 1 THEN 'temporary' ELSE 'analytics' END AS category, CASE WHEN (o_orderkey // 24) % 2 = 0 THEN 'image/png' ELSE 'application/octet-stream' END AS type, o_totalprice * 4000 AS size FROM orders),
b AS (SELECT *, ['png','jpeg','pdf','gzip-json','mp4','json','unknown','unknown'][h + 1] AS format FROM a)
SELECT o_orderkey, format, CASE WHEN h = 7 THEN 'empty' WHEN format = 'unknown' THEN 'unknown_format' WHEN (category = 'evidence' AND format NOT IN ('png','jpeg')) OR (category = 'analytics' AND format NOT IN ('json','gzip-json')) THEN 'format_not_allowed'
  WHEN type = 'image/png' AND format <> 'png' THEN 'type_mismatch' WHEN size > CASE category WHEN 'evidence' THEN 536870912 ELSE 4294967296 END THEN 'too_large' END AS reason FROM b""")
def fn_media_verdict(spark, d):
    k = F.col("o_orderkey")
    head = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in _HEADS)), (k % 8 + 1).cast("int"))
    category = F.when(F.floor(k / 8) % 3 == 0, "evidence").when(F.floor(k / 8) % 3 == 1, "temporary").otherwise("analytics")
    kind = F.when(F.floor(k / 24) % 2 == 0, "Image/PNG; q=1").otherwise("application/octet-stream")
    o = table(spark, d, "orders").withColumn("head", head)
    return o.select("o_orderkey", scalars.media_format(F.col("head")).alias("format"), scalars.media_verdict(category, kind, F.col("head"), F.col("o_totalprice") * 4000).alias("reason"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS sha_ok, o_orderkey % 3 <> 1 AS version_ok, o_orderkey % 5 <> 2 AS key_ok, 'rtsp://cam' || o_orderkey || '.example.org/live' AS url, left(repeat(o_orderpriority, 900), 2000) AS error, o_orderkey % 4 = 1 AS secret FROM orders""")
def fn_validators(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        scalars.is_sha256(F.when(k % 2 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.upper(F.sha2(F.concat(k.cast("string"), F.lit("A")), 256)))).alias("sha_ok"),
        scalars.is_rule_version(F.when(k % 3 == 0, "v1").when(k % 3 == 1, "latest").otherwise("v1.2.10")).alias("version_ok"),
        scalars.is_idempotency_key(F.when(k % 5 == 2, F.concat(F.lit("a b"), k.cast("string"))).otherwise(F.concat(F.lit("key-"), k.cast("string")))).alias("key_ok"),
        scalars.redact_url(F.concat(F.lit("rtsp://user:pa%40ss"), k.cast("string"), F.lit("@cam"), k.cast("string"), F.lit(".example.org/live"))).alias("url"),
        scalars.truncate_error(F.repeat("o_orderpriority", 900)).alias("error"),
        scalars.has_secret_key(F.create_map(F.when(k % 4 == 1, "Api_Key").otherwise("colour"), F.lit("x"))).alias("secret"),
    )
