"""Queries: work queues, deduplicating inserts, lifecycle logs, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.catalog.common import query, table
from vigilspark.operators import queues

NOW = "1999-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _of(names, index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def work(spark, d):
    """Orders as rows of work; some leases end exactly now."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    lease = F.when(k % 97 == 0, _now()).when(k % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).when(k % 89 == 0, F.lit("1999-06-01 00:00:01").cast("timestamp"))
    return o.select(
        k.alias("id"), _of(("pending", "failed", "processing", "published", "dead_letter"), k % 5).alias("status"), F.col("o_orderdate").alias("available_at"), lease.alias("lease_until"),
        F.when(k % 5 == 2, F.when(k % 2 == 0, "w1").otherwise("w2")).alias("claimed_by"), (k % 7).cast("int").alias("attempts"), F.when(k % 5 == 1, F.concat(F.lit("old"), k.cast("string"))).alias("last_error"),
    )


_WORK = f"""work AS (SELECT o_orderkey AS id, ['pending','failed','processing','published','dead_letter'][o_orderkey % 5 + 1] AS status, o_orderdate AS available_at,
CASE WHEN o_orderkey % 97 = 0 THEN TIMESTAMP '{NOW}' WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY WHEN o_orderkey % 89 = 0 THEN TIMESTAMP '1999-06-01 00:00:01' END AS lease_until,
CASE WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'w1' ELSE 'w2' END END AS claimed_by, (o_orderkey % 7)::INTEGER AS attempts, CASE WHEN o_orderkey % 5 = 1 THEN 'old' || o_orderkey END AS last_error FROM orders)"""
#: A row whose lease ends now can be claimed.
_DUE = f"status IN ('pending','failed','processing') AND available_at <= TIMESTAMP '{NOW}' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}')"
_RETRY = f"TIMESTAMP '{NOW}' + to_microseconds((least(600.0, 5.0 * pow(2, greatest(attempts, 1) - 1)) * 1000000)::BIGINT)"


@query(f"WITH {_WORK} SELECT id, available_at, 'processing' AS status, 'w9' AS claimed_by, TIMESTAMP '{NOW}' + INTERVAL 60 SECOND AS lease_until, (attempts + 1)::INTEGER AS attempts FROM work WHERE {_DUE} ORDER BY available_at, id LIMIT 50")
def queue_claim(spark, d):
    return queues.claim(work(spark, d), "w9", 50, 60, _now()).select("id", "available_at", "status", "claimed_by", "lease_until", "attempts")


@query(f"WITH {_WORK} SELECT id, lease_until = TIMESTAMP '{NOW}' AS ends_now FROM work WHERE {_DUE}")
def queue_claimable(spark, d):
    return queues.claimable(work(spark, d), _now()).select("id", (F.col("lease_until") == _now()).alias("ends_now"))


@query(f"WITH {_WORK}, c AS (SELECT id FROM work WHERE {_DUE} ORDER BY available_at, id LIMIT 50) SELECT CASE WHEN c.id IS NOT NULL THEN 'processing' ELSE status END AS status, count(*) AS n, sum(attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS attempts FROM work LEFT JOIN c USING (id) GROUP BY 1")
def queue_after_claim(spark, d):
    w = work(spark, d)
    return queues.apply_claim(w, queues.claim(w, "w9", 50, 60, _now())).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(f"""WITH {_WORK}, h AS (SELECT *, claimed_by IS NOT DISTINCT FROM 'w1' AND status = 'processing' AND id % 4 = 0 AS hit FROM work)
SELECT id, CASE WHEN hit THEN 'published' ELSE status END AS status, CASE WHEN NOT hit THEN claimed_by END AS claimed_by, CASE WHEN NOT hit THEN lease_until END AS lease_until, last_error FROM h""")
def queue_mark_published(spark, d):
    w = work(spark, d)
    return queues.marked(w, "w1", w.where("id % 4 = 0").select("id")).select("id", "status", "claimed_by", "lease_until", "last_error")


@query(f"""WITH {_WORK}, h AS (SELECT *, claimed_by IS NOT DISTINCT FROM 'w1' AND status = 'processing' AND id % 3 <> 0 AS hit, id % 4 = 0 OR attempts >= 5 AS final FROM work)
SELECT id, CASE WHEN hit AND final THEN 'dead_letter' WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit AND NOT final THEN {_RETRY} ELSE available_at END AS available_at,
CASE WHEN hit THEN 'boom' || id ELSE last_error END AS last_error, CASE WHEN NOT hit THEN claimed_by END AS claimed_by, CASE WHEN NOT hit THEN lease_until END AS lease_until FROM h""")
def queue_mark_failed(spark, d):
    """Errors of all rows but those of w1 are ignored; a multiple of 4 is not retryable."""
    w = work(spark, d)
    e = w.where("id % 3 <> 0").select("id", F.concat(F.lit("boom"), F.col("id").cast("string")).alias("error"), (F.col("id") % 4 != 0).alias("retryable"))
    return queues.failed(w, "w1", e, _now(), 5, 5.0, 600.0).select("id", "status", "available_at", "last_error", "claimed_by", "lease_until")


@query(f"""WITH {_WORK}, c AS (SELECT id FROM work WHERE {_DUE} ORDER BY available_at, id LIMIT 50),
n AS (SELECT w.* REPLACE (w.attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS attempts), c.id IS NOT NULL AS mine, w.id % 3 = 0 AS bad, w.id % 2 = 0 AS retryable, w.id % 11 = 0 AS silent FROM work w LEFT JOIN c USING (id))
SELECT id, CASE WHEN NOT mine THEN status WHEN silent THEN 'processing' WHEN NOT bad THEN 'published' WHEN NOT retryable OR attempts >= 5 THEN 'dead_letter' ELSE 'failed' END AS status,
CASE WHEN mine AND NOT silent AND bad AND retryable AND attempts < 5 THEN {_RETRY} ELSE available_at END AS available_at, CASE WHEN NOT mine THEN claimed_by WHEN silent THEN 'w9' END AS claimed_by, attempts::INTEGER AS attempts FROM n""")
def queue_cycle(spark, d):
    """Claim, publish and mark; a multiple of 11 has no result and keeps its lease."""
    w = work(spark, d)
    results = w.where("id % 11 <> 0").select("id", F.when(F.col("id") % 3 == 0, "timeout").alias("error"), (F.col("id") % 2 == 0).alias("retryable"))
    return queues.cycle(w, "w9", 50, 60, _now(), results, 5, 5.0, 600.0).select("id", "status", "available_at", "claimed_by", "attempts")


@query("""WITH i AS (SELECT event_id AS id, event_id // 2 AS event, event_type FROM events WHERE event_id % 5 <> 0), e AS (SELECT *, CASE event_type WHEN 'click' THEN 'count' WHEN 'purchase' THEN 'bill' END AS effect FROM i)
SELECT id, event AS event_id, effect, effect IS NOT NULL AND event % 7 <> 0 AND row_number() OVER (PARTITION BY event ORDER BY id) = 1 AS applies, CASE WHEN effect IS NULL THEN 'dead_letter' ELSE 'processed' END AS status FROM e""")
def queue_inbox(spark, d):
    e = table(spark, d, "events")
    inbox = e.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 2).alias("event_id"), "event_type", F.when(F.col("event_id") % 5 == 0, "processed").otherwise("pending").alias("status"))
    done = inbox.select("event_id").where("event_id % 7 = 0")
    return queues.consumed(inbox, {"click": "count", "purchase": "bill"}, done).select("id", "event_id", "effect", "applies", "status")


def _records(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 4 <> 0").select(
        F.lit("t").alias("tenant_id"), F.lit("op").alias("operation"), k.cast("string").alias("key"), k.cast("string").alias("request_hash"), F.when(k % 3 == 0, "completed").otherwise("in_progress").alias("status"),
        F.when(k % 5 == 0, _now()).when(k % 5 < 3, F.lit("1999-06-02").cast("timestamp")).when(k % 5 == 4, F.lit("1999-05-31").cast("timestamp")).alias("lease_until"), F.when(k % 11 == 0, "v2").when(k % 11 > 5, "v1").alias("venue_id"), F.when(k % 2 == 0, "w1").otherwise("w2").alias("claimed_by"), F.lit(None).cast("string").alias("response"),
    )


# Leases: c % 5 = 0 ends now, 1 and 2 later, 3 has none, 4 ended before. Venues: c % 11 = 0 v2, above 5 v1, else none; requests name v1 above 5 only.
@query("""WITH q AS (SELECT o_orderkey AS request_id, o_custkey AS c, o_orderkey % 5 = 0 AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders)
SELECT request_id, CASE WHEN c % 4 = 0 OR c NOT IN (SELECT c_custkey FROM customer) THEN CASE WHEN first THEN 'claimed' ELSE 'busy' END WHEN c % 11 = 0 THEN 'conflict'
WHEN c % 3 = 0 THEN CASE WHEN other THEN 'conflict' ELSE 'replay' END WHEN c % 5 = 4 AND first THEN 'reclaimed' ELSE 'busy' END AS outcome FROM q""")
def queue_idempotency_claims(spark, d):
    c = F.col("o_custkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("t").alias("tenant_id"), F.lit("op").alias("operation"), c.cast("string").alias("key"), F.concat(c.cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")).alias("request_hash"), F.when(c % 11 > 5, "v1").alias("venue_id"))
    return queues.idempotency_claims(o, _records(spark, d), _now()).select("request_id", "outcome")


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 7 = 1 AS hit FROM customer WHERE c_custkey % 4 <> 0)
SELECT k::VARCHAR AS key, CASE WHEN hit OR k % 3 = 0 THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN hit THEN 'r' || k END AS response, CASE WHEN NOT hit THEN CASE WHEN k % 2 = 0 THEN 'w1' ELSE 'w2' END END AS claimed_by FROM r""")
def queue_idempotency_completed(spark, d):
    r = _records(spark, d)
    done = r.where("cast(key as long) % 7 = 1").select("tenant_id", "operation", "key", F.concat(F.lit("r"), "key").alias("response"))
    return queues.completed(r, "w1", done).select("key", "status", "response", "claimed_by")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 97 = 0) GROUP BY user_id, event_type")
def queue_insert_new(spark, d):
    e = table(spark, d, "events")
    return queues.insert_new(e.where("event_id % 97 = 0"), e, ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'new' WHEN c.c_mktsegment = o.o_orderpriority THEN 'replay' WHEN o.o_orderkey % 2 = 0 THEN 'replay' ELSE 'conflict' END AS outcome FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_custkey % 3 = 0""")
def queue_idempotency(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit("t").alias("tenant_id"), F.lit("op").alias("operation"), F.col("o_custkey").cast("string").alias("key"), F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("x")).alias("request_hash"))
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.lit("t").alias("tenant_id"), F.lit("op").alias("operation"), F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("request_hash"))
    return queues.idempotent(o, c).select("o_orderkey", "outcome")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'count' WHEN 'purchase' THEN 'bill' END AS effect, CASE WHEN event_type IN ('click','purchase') THEN 'handled' ELSE 'dead_letter' END AS outcome FROM events")
def queue_dispatch(spark, d):
    return queues.dispatch(table(spark, d, "events"), {"click": "count", "purchase": "bill"}).select("event_id", "effect", "outcome")


_STATES = ("connecting", "active", "degraded", "reconnecting", "stopped", "failed")
_OPERATIONS = ("connected", "connection_failed", "stop_requested", "stale_detected", "fatal_error", "reconnecting", "reconnected", "reconnect_failed")
#: The lifecycle of a live session as rows, written from its description.
_LIVE_GRAPH = """g(a, o, b) AS (VALUES ('connecting','connected','active'), ('connecting','connection_failed','failed'), ('connecting','stop_requested','stopped'),
('active','stale_detected','degraded'), ('active','stop_requested','stopped'), ('active','fatal_error','failed'), ('degraded','reconnecting','reconnecting'), ('degraded','stop_requested','stopped'), ('degraded','fatal_error','failed'),
('reconnecting','reconnected','active'), ('reconnecting','reconnect_failed','degraded'), ('reconnecting','fatal_error','failed'), ('reconnecting','stop_requested','stopped'))"""
_STATE_SQL = "['connecting','active','degraded','reconnecting','stopped','failed']"


@query(f"""WITH {_LIVE_GRAPH}, s AS (SELECT event_id, user_id, {_STATE_SQL}[(event_id * 31 // 7) % 6 + 1] AS status, lag({_STATE_SQL}[(event_id * 31 // 7) % 6 + 1]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, user_id, previous, status FROM s WHERE previous IS NOT NULL AND (previous, status) NOT IN (SELECT (a, b) FROM g)""")
def queue_illegal_transitions(spark, d):
    e = table(spark, d, "events")
    log = e.select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), _of(_STATES, F.floor(F.col("event_id") * 31 / 7) % 6).alias("status"))
    return queues.illegal_transitions(log, "live_session").select("event_id", F.col("entity_id").alias("user_id"), "previous", "status")


_TRANSITIONS = f"""{_LIVE_GRAPH}, r AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 10 <> 9 THEN {_STATE_SQL}[c_custkey % 6 + 1] END AS previous,
['connected','connection_failed','stop_requested','stale_detected','fatal_error','reconnecting','reconnected','reconnect_failed'][c_custkey % 8 + 1] AS operation FROM customer),
t AS (SELECT r.*, g.b FROM r LEFT JOIN g ON g.a = r.previous AND g.o = r.operation)"""


def _transitions(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    entities = c.where("c_custkey % 10 <> 9").select(k.alias("entity_id"), _of(_STATES, k % 6).alias("status"))
    requests = c.select(k.alias("entity_id"), _of(_OPERATIONS, k % 8).alias("operation"))
    return entities, queues.transitions(entities, requests, "live_session")


@query(f"""WITH {_TRANSITIONS} SELECT entity_id, operation, previous, coalesce(b, previous) AS new_state, CASE WHEN previous IS NULL THEN 'unknown' WHEN b IS NOT NULL THEN 'applied'
WHEN operation = 'stop_requested' AND previous IN ('stopped', 'failed') THEN 'unchanged' WHEN previous IN ('stopped', 'failed') THEN 'terminal' ELSE 'illegal' END AS outcome FROM t""")
def queue_transitions(spark, d):
    return _transitions(spark, d)[1].select("entity_id", "operation", "previous", "new_state", "outcome")


@query(f"WITH {_TRANSITIONS} SELECT entity_id, coalesce(b, previous) AS status, CASE WHEN b IS NOT NULL OR operation = 'stop_requested' AND previous IN ('stopped', 'failed') THEN operation END AS reason FROM t WHERE previous IS NOT NULL")
def queue_apply_transitions(spark, d):
    """The entities after the transitions, with the reason in the log of those that moved or were stopped again."""
    entities, decided = _transitions(spark, d)
    after, log = queues.apply_transitions(entities, decided, _now())
    return after.join(log.select("entity_id", "reason"), "entity_id", "left").select("entity_id", "status", "reason")


_EVIDENCE = f"""w AS (SELECT o_orderkey AS id, ['requested','retryable_failure','queued','extracting','uploading','finalized'][o_orderkey % 6 + 1] AS state, o_orderdate AS created_at, o_orderdate + INTERVAL 900 DAY AS retry_at,
CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '{NOW}' WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '{NOW}' + INTERVAL 1 SECOND END AS lease_until, (o_orderkey % 3)::INTEGER AS attempts FROM orders)"""


def _evidence(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    lease = F.when(k % 4 == 0, _now()).when(k % 4 == 1, F.lit("1999-06-01 00:00:01").cast("timestamp"))
    state = _of(("requested", "retryable_failure", "queued", "extracting", "uploading", "finalized"), k % 6)
    return table(spark, d, "orders").select(k.alias("id"), state.alias("state"), t.alias("created_at"), (t + F.expr("INTERVAL 900 DAYS")).alias("retry_at"), lease.alias("lease_until"), F.lit(None).cast("string").alias("claimed_by"), (k % 3).cast("int").alias("attempts"))


_PROMOTED = f"""CASE WHEN state IN ('requested', 'queued') AND epoch_us(created_at) <= epoch_us(TIMESTAMP '{NOW}') - 86400000000 * 1500 THEN 'expired' WHEN state = 'requested' THEN 'queued' WHEN state = 'retryable_failure' AND retry_at <= TIMESTAMP '{NOW}' THEN 'queued' ELSE state END"""


@query(f"""WITH {_EVIDENCE} SELECT id, {_PROMOTED} AS new_state, CASE WHEN lease_until <= TIMESTAMP '{NOW}' AND state = 'extracting' THEN 'retry_now' WHEN lease_until <= TIMESTAMP '{NOW}' AND state = 'uploading' THEN 'resume_upload' ELSE 'none' END AS action FROM w""")
def queue_evidence_states(spark, d):
    return queues.recovered(queues.promoted(_evidence(spark, d), _now(), 1500 * 86400), _now()).select("id", "new_state", "action")


@query(f"""WITH {_EVIDENCE}, n AS (SELECT * REPLACE (CASE WHEN state = 'extracting' AND lease_until <= TIMESTAMP '{NOW}' THEN 'queued' ELSE {_PROMOTED} END AS state) FROM w),
c AS (SELECT id FROM n WHERE state = 'queued' AND (lease_until IS NULL OR lease_until <= TIMESTAMP '{NOW}') ORDER BY created_at, id LIMIT 40)
SELECT n.id, CASE WHEN c.id IS NOT NULL THEN 'extracting' ELSE state END AS state, CASE WHEN c.id IS NOT NULL THEN 'w9' END AS claimed_by, (attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS attempts FROM n LEFT JOIN c USING (id)""")
def queue_evidence_cycle(spark, d):
    return queues.evidence_cycle(_evidence(spark, d), "w9", _now(), 40, 1500 * 86400, 60).select("id", "state", "claimed_by", "attempts")


_MEDIA = """m AS (SELECT o_orderkey AS id, ['available','deletion_pending','uploading','uploaded','validating','expired','deleted'][o_orderkey % 7 + 1] AS state, o_orderdate AS created_at, o_orderdate AS updated_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS expires_at FROM orders)"""


def _media(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    state = _of(("available", "deletion_pending", "uploading", "uploaded", "validating", "expired", "deleted"), k % 7)
    return table(spark, d, "orders").select(k.alias("id"), state.alias("state"), t.alias("created_at"), t.alias("updated_at"), F.when(k % 5 != 0, t + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))


_CUT = "1996-01-01 00:00:00"


@query(f"WITH {_MEDIA} SELECT id, state, expires_at FROM m WHERE state IN ('available','deletion_pending') AND expires_at <= TIMESTAMP '{_CUT}' ORDER BY expires_at, id LIMIT 30")
def queue_expired_media(spark, d):
    return queues.expired(_media(spark, d), F.lit(_CUT).cast("timestamp"), 30).select("id", "state", "expires_at")


@query(f"WITH {_MEDIA} SELECT id, created_at FROM m WHERE state = 'uploading' AND created_at < TIMESTAMP '{_CUT}' ORDER BY created_at, id LIMIT 30")
def queue_stale_uploads(spark, d):
    return queues.stale_uploads(_media(spark, d), F.lit(_CUT).cast("timestamp"), 30).select("id", "created_at")


@query(f"WITH {_MEDIA} SELECT id, state FROM m WHERE state IN ('uploaded','validating','available','expired','deletion_pending') AND updated_at < TIMESTAMP '{_CUT}' ORDER BY updated_at, id LIMIT 30")
def queue_reconcilable_media(spark, d):
    return queues.reconcilable(_media(spark, d), F.lit(_CUT).cast("timestamp"), 30).select("id", "state")


@query(f"SELECT o_orderkey AS id, o_orderdate AS delivered_at FROM orders WHERE o_orderkey % 3 <> 0 AND epoch_us(TIMESTAMP '{_CUT}') - epoch_us(o_orderdate) >= 86400000000 ORDER BY o_orderdate, o_orderkey LIMIT 30")
def queue_reclaimable_messages(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("delivered_at"), (F.col("o_orderkey") % 3 == 0).alias("acknowledged"))
    return queues.reclaimable(m, F.lit(_CUT).cast("timestamp"), 86400.0, 30).select("id", "delivered_at")


@query("""SELECT id, CASE r WHEN 0 THEN 'continue' WHEN 1 THEN 'continue' WHEN 2 THEN CASE WHEN id % 7 < 4 THEN 'retry' ELSE 'failed' END ELSE 'failed' END AS route FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS r FROM orders)""")
def queue_routes(spark, d):
    k = F.col("o_orderkey")
    r = F.element_at(F.array(*map(F.lit, ("resolved", "partial", "not_found", "auth_failure"))), (k % 4 + 1).cast("int"))
    return queues.routed(table(spark, d, "orders").select(k.alias("id"), r.alias("resolution"), (k % 7).alias("attempts"), F.lit(4).alias("most_attempts"))).select("id", "route")


def _objects(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    objects = o.where(k % 3 != 0).select(F.concat(F.lit("obj"), k.cast("string")).alias("object_key"), F.col("o_orderdate").cast("timestamp").alias("modified_at"))
    rows = o.where(k % 4 != 0).select(F.concat(F.lit("obj"), k.cast("string")).alias("object_key"), F.element_at(F.array(*map(F.lit, ("available", "failed", "expired", "deletion_pending", "deleted"))), (k % 5 + 1).cast("int")).alias("state"))
    return queues.orphans(objects, rows, _now(), 86400.0)


_LIVE = "o_orderkey % 4 <> 0 AND o_orderkey % 5 NOT IN (1, 4)"


@query(f"SELECT 'obj' || o_orderkey AS object_key FROM orders WHERE o_orderkey % 3 <> 0 AND NOT ({_LIVE}) AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate) >= 86400000000")
def queue_orphan_objects(spark, d):
    return _objects(spark, d)[0].select("object_key")


@query(f"SELECT 'obj' || o_orderkey AS object_key, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'deleted' ELSE 'failed' END AS new_state FROM orders WHERE o_orderkey % 3 = 0 AND {_LIVE}")
def queue_missing_objects(spark, d):
    return _objects(spark, d)[1].select("object_key", "new_state")


_OUTBOX_STATES = ("pending", "processing", "published", "failed")
_GUARD = """o AS (SELECT o_orderkey AS id, ['pending','processing','published','failed'][o_custkey % 4 + 1] AS status, CASE WHEN o_custkey % 4 = 2 THEN o_orderdate::TIMESTAMP END AS published_at, o_orderdate::TIMESTAMP AS updated_at FROM orders),
c AS (SELECT o_orderkey + 3 AS id, CASE WHEN o_orderkey % 13 <> 0 THEN ['pending','processing','published','failed'][o_orderkey // 8 % 4 + 1] END AS s, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '1999-05-01' END AS told FROM orders WHERE o_orderkey % 3 <> 0),
legal(a, b) AS (VALUES ('pending','processing'), ('pending','failed'), ('processing','published'), ('processing','failed'), ('processing','pending'), ('failed','pending'), ('failed','processing'))"""


def _guarded(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders")
    rows = o.select(k.alias("id"), _of(_OUTBOX_STATES, F.col("o_custkey") % 4).alias("status"), F.when(F.col("o_custkey") % 4 == 2, t).alias("published_at"), t.alias("updated_at"))
    changes = o.where("o_orderkey % 3 <> 0").select((k + 3).alias("id"), F.when(k % 13 != 0, _of(_OUTBOX_STATES, F.floor(k / 8) % 4)).alias("status"), F.when(k % 5 == 0, F.lit("1999-05-01").cast("timestamp")).alias("published_at"))
    return queues.guarded_outbox(rows, changes, _now())


@query(f"""WITH {_GUARD} SELECT id, CASE WHEN legal.a IS NOT NULL THEN s ELSE status END AS status, CASE WHEN legal.a IS NOT NULL AND s = 'published' THEN coalesce(told, published_at, TIMESTAMP '{NOW}') ELSE published_at END AS published_at,
CASE WHEN legal.a IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM o LEFT JOIN c USING (id) LEFT JOIN legal ON legal.a = status AND legal.b = s""")
def queue_outbox_guarded(spark, d):
    """Changes of an outbox under its status graph; some are of unknown rows or without a status."""
    return _guarded(spark, d)[0]


@query(f"WITH {_GUARD} SELECT c.id, o.status AS previous, s AS status FROM c LEFT JOIN o USING (id) WHERE s IS NULL OR o.status IS NULL OR s <> o.status AND (o.status, s) NOT IN (SELECT (a, b) FROM legal)")
def queue_outbox_refused(spark, d):
    return _guarded(spark, d)[1]
