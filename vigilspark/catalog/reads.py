"""Queries: scoped reads, top-1 and top-k, joins of versions and sessions, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.operators import reads


def _scoped_orders(spark, d):
    return table(spark, d, "orders").withColumn("tenant_id", F.col("o_custkey") % 4).withColumn("venue_id", F.col("o_custkey") % 10)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 4 = 1 AND o_custkey % 10 IN (1, 3, 5)")
def read_scoped(spark, d):
    return reads.scoped(_scoped_orders(spark, d), reads.Actor(1, (1, 3, 5))).select("o_orderkey", "o_orderstatus")


@query("SELECT count(DISTINCT o_custkey % 10) AS venues, count(*) FILTER (o_custkey % 10 IN (1, 3)) AS n FROM orders WHERE o_custkey % 4 = 1")
def read_count_for_actor(spark, d):
    return reads.scoped(_scoped_orders(spark, d), reads.Actor(1)).agg(F.count_distinct("venue_id").alias("venues"), F.count_if(F.col("venue_id").isin(1, 3)).alias("n"))


@query("SELECT DISTINCT o_custkey % 4 AS tenant_id, o_custkey % 10 AS venue_id FROM orders ORDER BY 1, 2 LIMIT 15")
def read_tenant_venues(spark, d):
    return _scoped_orders(spark, d).select("tenant_id", "venue_id").distinct().orderBy("tenant_id", "venue_id").limit(15)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def read_count_by_status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def _versions(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("superseded")
    return o.select(F.lit("t").alias("tenant_id"), F.col("o_custkey").alias("configuration_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("number"), status.alias("status"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_revision"))


@query("SELECT o_custkey AS configuration_id, max(o_orderkey) AS version_id, max_by(o_orderstatus, o_orderkey) = 'F' AS published FROM orders GROUP BY 1")
def read_latest_version(spark, d):
    return reads.latest(_versions(spark, d), ["configuration_id"], "number").select("configuration_id", "version_id", (F.col("status") == "published").alias("published"))


@query("SELECT o_custkey AS configuration_id, max(o_orderkey) AS version_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def read_latest_published(spark, d):
    return reads.latest(_versions(spark, d).where("status = 'published'"), ["configuration_id"], "number").select("configuration_id", "version_id")


@query("WITH c AS (SELECT o_custkey, max(o_orderkey) AS current FROM orders GROUP BY 1) SELECT o.o_custkey AS configuration_id, o.o_orderkey AS version_id FROM orders o JOIN c ON c.o_custkey = o.o_custkey AND c.current = o.o_orderkey WHERE o.o_orderstatus = 'F'")
def read_current_published(spark, d):
    v = _versions(spark, d)
    c = v.groupBy("tenant_id", "configuration_id").agg(F.max("version_id").alias("current_version_id"))
    return reads.current_published(v, c).select("configuration_id", "version_id")


@query("SELECT event_id AS session_id, o_orderkey AS version_id FROM events LEFT JOIN orders ON o_orderkey = event_id AND o_orderstatus = 'F' AND event_id % 3 <> 0")
def read_pinned_version(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("pinned_version_id"))
    return reads.pinned(s, _versions(spark, d))


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))


@query("SELECT c_custkey AS session_id, max_by(event_type, event_id) AS last_status, max(ts) AS last_at FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def read_last_transition(spark, d):
    return reads.last_transition(table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), _log(spark, d))


@query("SELECT ts AS at, event_id AS seq, event_type AS status FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def read_history(spark, d):
    return reads.history(_log(spark, d), 7).select("at", "seq", "status")


@query("SELECT event_id, event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS evidence_available FROM events")
def read_evidence_availability(spark, d):
    ev = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "available").otherwise("queued").alias("state"))
    return reads.with_availability(table(spark, d, "events").select("event_id"), ev)


@query("SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def read_due(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return reads.due(o, "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"), 20)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def read_top_per_group(spark, d):
    return reads.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, v[least(n - 1, floor(0.5::DOUBLE * n))::BIGINT + 1] AS p50, v[least(n - 1, floor(0.95::DOUBLE * n))::BIGINT + 1] AS p95, v[least(n - 1, floor(0.99::DOUBLE * n))::BIGINT + 1] AS p99, v[1] AS min, v[n] AS max FROM s""")
def agg_latency_stats(spark, d):
    s = reads.latency_stats(table(spark, d, "events"), ["event_type"], "value")
    return s.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("""SELECT 'sessions' AS name, o_orderkey AS id FROM orders WHERE o_custkey % 4 = 2 UNION ALL SELECT 'venues', c_custkey FROM customer WHERE c_nationkey = 2""")
def read_secured(spark, d):
    """Two tables under their own policies, one by another column; a session without a tenant sees nothing."""
    tables = {"sessions": _scoped_orders(spark, d), "venues": table(spark, d, "customer")}
    policies = {"sessions": "tenant_id", "venues": "c_nationkey"}
    own, none = reads.secured(tables, 2, policies), reads.secured(tables, None, policies)
    pick = lambda t: t["sessions"].select(F.lit("sessions").alias("name"), F.col("o_orderkey").alias("id")).unionByName(t["venues"].select(F.lit("venues").alias("name"), F.col("c_custkey").alias("id")))
    return pick(own).unionByName(pick(none))
