"""Queries: source coverage, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.operators import evidence


def _inputs(spark, d):
    """Customers' orders as recordings of 1 hour, 20 or 400 days, and a request for each customer: an instant, some minutes, or 90 days.

    Some requests name no tenant, venue or source, others a camera or session that nothing has.
    """
    o, n = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    day = F.lit(86400000000)
    length = F.when(n % 10 == 1, F.lit(3600000000)).when(n % 50 == 2, 400 * day).otherwise(20 * day)
    recordings = o.select(
        n.alias("asset_id"), F.col("o_custkey").alias("tenant_id"), (n % 2).alias("venue_id"), F.lit("c").alias("camera_id"), F.when(n % 9 == 0, "s2").otherwise("s").alias("session_id"), F.col("t").alias("start_time"),
        F.timestamp_micros(F.unix_micros("t") + length).alias("end_time"), (F.col("o_orderstatus") != "P").alias("available"),
    )
    k = F.col("c_custkey")
    start = F.timestamp_micros(F.lit(852076800000000) + (k % 900) * day)
    asked = F.when(k % 6 == 1, F.lit(0)).when(k % 6 == 2, F.lit(600000000)).otherwise(90 * day)
    requests = table(spark, d, "customer").select(
        k.alias("ref_id"), F.when(k % 19 != 0, k).alias("tenant_id"), F.when(k % 7 != 3, k % 2).alias("venue_id"), F.when(k % 13 == 2, 4 * k).alias("video_asset_id"), F.when(k % 11 != 1, F.when(k % 17 == 5, "d").otherwise("c")).alias("camera_id"),
        F.when(k % 4 == 0, "s").alias("session_id"), start.alias("start_time"), F.timestamp_micros(F.unix_micros(start) + asked).alias("end_time"),
    )
    return requests, recordings


def _candidates(spark, d):
    """Recordings of the request's venue; those of a fifth of the requests were not scoped."""
    requests, recordings = _inputs(spark, d)
    near = evidence.overlapping(requests, recordings).where("ref_id % 5 = 0 or venue_id = rec_venue")
    return requests, near.withColumn("rec_tenant", F.col("tenant_id"))


_PAIRS = """q AS (SELECT c_custkey AS ref, CASE WHEN c_custkey % 19 <> 0 THEN c_custkey END AS tenant, CASE WHEN c_custkey % 7 <> 3 THEN c_custkey % 2 END AS venue, CASE WHEN c_custkey % 13 = 2 THEN 4 * c_custkey END AS asset,
CASE WHEN c_custkey % 11 <> 1 THEN CASE WHEN c_custkey % 17 = 5 THEN 'd' ELSE 'c' END END AS cam, CASE WHEN c_custkey % 4 = 0 THEN 's' END AS ses, make_timestamp((852076800000000 + (c_custkey % 900) * 86400000000)::BIGINT) AS a,
a + to_microseconds((CASE c_custkey % 6 WHEN 1 THEN 0 WHEN 2 THEN 600000000 ELSE 7776000000000 END)::BIGINT) AS b FROM customer),
o AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderkey % 2 AS v, CASE WHEN o_orderkey % 9 = 0 THEN 's2' ELSE 's' END AS sess, o_orderdate::TIMESTAMP AS s, s + to_microseconds((CASE WHEN o_orderkey % 10 = 1 THEN 3600000000 WHEN o_orderkey % 50 = 2 THEN 34560000000000 ELSE 1728000000000 END)::BIGINT) AS e, o_orderstatus <> 'P' AS free FROM orders),
p AS (SELECT q.*, o.* FROM q JOIN o ON owner = tenant AND s <= b AND e >= a)"""
_COVER = f"""{_PAIRS}, m AS (SELECT *, venue IS NULL OR v <> venue AS alien, (asset IS NULL OR asset = id) AND (cam IS NULL OR cam = 'c') AND (ses IS NULL OR ses = sess) AS fits FROM p WHERE ref % 5 = 0 OR v = venue),
h AS (SELECT ref, bool_or(alien) AS alien, bool_or(fits) AS fits, bool_or(fits AND free) AS free FROM m GROUP BY ref),
u AS (SELECT ref, greatest(s, a) AS f, least(e, b) AS t, a, b FROM m WHERE fits AND free),
w AS (SELECT *, coalesce(max(t) OVER (PARTITION BY ref ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS reach FROM u),
holes AS (SELECT ref, reach AS x, f AS y FROM w WHERE f > reach UNION ALL SELECT ref, max(t), max(b) FROM u GROUP BY ref HAVING max(t) < max(b)),
g AS (SELECT ref, sum(epoch_us(y) - epoch_us(x)) AS missing, string_agg(strftime(x, '%Y-%m-%d %H:%M:%S') || '/' || strftime(y, '%Y-%m-%d %H:%M:%S'), '; ' ORDER BY x) AS text FROM holes GROUP BY ref),
r AS (SELECT q.*, missing, text, CASE WHEN tenant IS NULL OR venue IS NULL THEN 'no_scope' WHEN alien THEN 'foreign_venue' WHEN asset IS NULL AND cam IS NULL AND ses IS NULL THEN 'no_identity' WHEN fits IS NOT TRUE THEN 'no_match'
  WHEN NOT free THEN 'unavailable' WHEN missing IS NOT NULL THEN 'gaps' END AS reason FROM q LEFT JOIN h USING (ref) LEFT JOIN g USING (ref))"""


@query(f"""WITH {_COVER} SELECT ref AS ref_id, CASE WHEN reason IS NULL THEN 'resolved' WHEN reason = 'gaps' THEN 'partial' WHEN reason IN ('no_scope', 'foreign_venue') THEN 'auth_failure' ELSE 'not_found' END AS resolution, reason,
CASE WHEN reason IS NULL OR reason = 'gaps' THEN (epoch_us(b) - epoch_us(a) - coalesce(missing, 0)) / 1e6 ELSE 0 END::DOUBLE AS covered_seconds, CASE WHEN reason IS NULL THEN '' WHEN reason = 'gaps' THEN text END AS gap_text FROM r""")
def evidence_coverage(spark, d):
    """Requests that name no scope, or whose candidates are foreign, fail; gaps are told in order."""
    return evidence.resolve(*_candidates(spark, d))


@query(f"WITH {_PAIRS} SELECT ref AS ref_id, id AS asset_id FROM p")
def evidence_overlaps(spark, d):
    """Windows of no length to 90 days with recordings of an hour to 400 days."""
    return evidence.overlapping(*_inputs(spark, d)).select("ref_id", "asset_id")


_HOPS = "['event','rule','fact','transition','observation','track','detection','frame','session','camera','recording','object']"


@query(f"SELECT o_orderkey AS ref_id, i::INTEGER AS position, {_HOPS}[i + 1] AS hop, CASE WHEN i <> 6 THEN {_HOPS}[i + 1] || '-' || o_orderkey END AS id FROM orders, range(12) r(i)")
def evidence_provenance_chain(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), *(F.when(F.lit(h != "detection"), F.concat(F.lit(f"{h}-"), F.col("o_orderkey").cast("string"))).alias(h) for h in evidence.HOPS))
    return evidence.provenance_chain(o)


@query("SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 10 = 3 OR (o_orderkey % 4 <> 0 AND o_orderkey % 7 = 1) THEN 'failed' ELSE 'verified' END AS verdict, CASE WHEN o_orderkey % 4 = 0 THEN 'not_applicable' WHEN o_orderkey % 7 = 1 THEN 'fail' ELSE 'pass' END AS track_check FROM orders")
def evidence_provenance_verdict(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("ref_id", k)
    out = evidence.verify(o, {"session": (k, F.when(k % 10 == 3, k + 1).otherwise(k)), "track": (F.when(k % 4 != 0, k), F.when(k % 7 == 1, -k).otherwise(k))})
    return out.select("ref_id", "verdict", F.filter("checks", lambda c: c["name"] == "track")[0]["outcome"].alias("track_check"))


@query("SELECT o_orderkey AS ref_id, o_orderkey % 6 NOT IN (2, 3) AS agrees FROM orders WHERE o_orderkey % 5 <> 0")
def evidence_three_way(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("ref_id"))
    r = F.col("ref_id")
    return evidence.agree(o.withColumn("v", r), o.withColumn("v", F.when(r % 6 != 2, r)), o.where("ref_id % 5 <> 0").withColumn("v", F.when(r % 6 == 3, -r).otherwise(r)), ["v"])
