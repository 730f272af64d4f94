"""Work queues, deduplicating inserts and lifecycle logs as transitions of whole tables.

A table of work is a DataFrame with id, status, available_at, lease_until, claimed_by,
attempts and last_error; every operator returns the table's next state (or the changed
rows), which a single writer stores per micro-batch. Only the worker that holds a row may
end its processing; rows of others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.scalars import backoff, truncate_error


def claimable(work: DataFrame, now) -> DataFrame:
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return work.where(F.col("status").isin("pending", "failed", "processing") & (F.col("available_at") <= now) & free)


def claim(work: DataFrame, worker: str, batch: int, lease_seconds: int, now) -> DataFrame:
    """The first `batch` due rows as claimed by worker."""
    due = claimable(work, now).orderBy("available_at", "id").limit(batch)
    return due.withColumns({"status": F.lit("processing"), "claimed_by": F.lit(worker), "lease_until": F.timestamp_micros(F.unix_micros(now) + lease_seconds * 1_000_000), "attempts": F.col("attempts") + 1})


def apply_claim(work: DataFrame, claimed: DataFrame) -> DataFrame:
    return work.join(claimed.select("id"), "id", "left_anti").unionByName(claimed)


def _held(worker: str):
    return F.coalesce((F.col("claimed_by") == worker) & (F.col("status") == "processing"), F.lit(False))


def _released(work: DataFrame, hit) -> DataFrame:
    """Without claim and lease where hit."""
    return work.withColumns({"claimed_by": F.when(~hit, F.col("claimed_by")), "lease_until": F.when(~hit, F.col("lease_until"))})


def marked(work: DataFrame, worker: str, done: DataFrame) -> DataFrame:
    """Rows of done (id) become published and free where worker holds them; others stay."""
    both = work.join(done.select("id", F.lit(True).alias("_done")).distinct(), "id", "left").withColumn("_hit", _held(worker) & F.col("_done").isNotNull())
    return _released(both, F.col("_hit")).withColumn("status", F.when(F.col("_hit"), "published").otherwise(F.col("status"))).drop("_done", "_hit")


def failed(work: DataFrame, worker: str, errors: DataFrame, now, most_attempts: int, base: float, most: float) -> DataFrame:
    """Rows of errors (id, error, retryable) that worker holds wait for their next attempt; after most_attempts, or where not retryable, they are dead letters. An unknown retryable counts as yes."""
    last = errors.groupBy("id").agg(F.max("error").alias("error"), F.coalesce(F.min("retryable"), F.lit(True)).alias("retryable"))
    both = work.join(last, "id", "left").withColumn("_hit", _held(worker) & F.col("error").isNotNull())
    dead = F.col("_hit") & (~F.col("retryable") | (F.col("attempts") >= most_attempts))
    retry = F.timestamp_micros(F.unix_micros(now) + (backoff(F.col("attempts"), base, most) * 1e6).cast("long"))
    out = both.withColumns({
        "available_at": F.when(F.col("_hit") & ~dead, retry).otherwise(F.col("available_at")),
        "last_error": F.when(F.col("_hit"), truncate_error(F.col("error"))).otherwise(F.col("last_error")),
        "_status": F.when(dead, "dead_letter").when(F.col("_hit"), "failed").otherwise(F.col("status")),
    })
    return _released(out, F.col("_hit")).withColumn("status", F.col("_status")).drop("error", "retryable", "_hit", "_status")


def cycle(work: DataFrame, worker: str, batch: int, lease_seconds: int, now, results: DataFrame, most_attempts: int, base: float, most: float) -> DataFrame:
    """One publisher cycle: claim due rows, and mark them by results (id, error or null, retryable); claimed rows without a result keep their lease."""
    held = apply_claim(work, claim(work, worker, batch, lease_seconds, now))
    ok, bad = results.where("error is null").select("id"), results.where("error is not null")
    return failed(marked(held, worker, ok), worker, bad, now, most_attempts, base, most)


def consumed(inbox: DataFrame, effects: dict[str, str], done: DataFrame) -> DataFrame:
    """Pending rows of an inbox with their effect and next status: processed once (an event in done has no second effect), dead_letter without an effect."""
    pending = dispatch(inbox.where("status = 'pending'"), effects)
    known = done.select("event_id", F.lit(True).alias("_done")).distinct()
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("id")) == 1
    out = pending.join(known, "event_id", "left").withColumn("applies", F.col("effect").isNotNull() & F.col("_done").isNull() & first)
    return out.withColumn("status", F.when(F.col("effect").isNull(), "dead_letter").otherwise("processed")).drop("_done", "outcome")


def idempotency_claims(requests: DataFrame, records: DataFrame, now) -> DataFrame:
    """Outcome of requests (request_id, tenant_id, operation, key, request_hash, venue_id) against records with status and lease_until.

    claimed (no record), conflict (another venue, or completed with another hash), replay (completed), reclaimed (in progress
    with a lease that ended before now; the new request's hash counts from then on) or busy. A record in progress without a
    lease is never reclaimed. Of requests of one unit the first by request_id claims or reclaims.
    """
    unit = ["tenant_id", "operation", "key"]
    known = records.select(*unit, F.lit(True).alias("_known"), F.col("request_hash").alias("_hash"), F.col("status").alias("_status"), F.col("lease_until").alias("_lease"), F.col("venue_id").alias("_venue"))
    first = F.row_number().over(Window.partitionBy(*unit).orderBy("request_id")) == 1
    outcome = (
        F.when(F.col("_known").isNull(), F.when(first, "claimed").otherwise("busy")).when(~F.col("_venue").eqNullSafe(F.col("venue_id")), "conflict")
        .when(F.col("_status") == "completed", F.when(F.col("_hash").eqNullSafe(F.col("request_hash")), "replay").otherwise("conflict")).when((F.col("_lease") < now) & first, "reclaimed").otherwise("busy")
    )
    return requests.join(known, unit, "left").withColumn("outcome", outcome).drop("_known", "_hash", "_status", "_lease", "_venue")


def completed(records: DataFrame, worker: str, done: DataFrame) -> DataFrame:
    """Records of done (tenant_id, operation, key, response) are completed where worker holds them."""
    unit = ["tenant_id", "operation", "key"]
    hit = F.coalesce((F.col("status") == "in_progress") & (F.col("claimed_by") == worker) & F.col("_response").isNotNull(), F.lit(False))
    both = records.join(done.select(*unit, F.col("response").alias("_response")).dropDuplicates(unit), unit, "left").withColumn("_hit", hit)
    return _released(both.withColumns({"status": F.when(F.col("_hit"), "completed").otherwise(F.col("status")), "response": F.when(F.col("_hit"), F.col("_response")).otherwise(F.col("response"))}), F.col("_hit")).drop("_hit", "_response")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of batch whose keys are new to target, the first by order of equal ones."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(target.select(*keys), keys, "left_anti")


def idempotent(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Outcome of requests (tenant_id, operation, key, request_hash) against those done: new, replay or conflict."""
    known = done.select("tenant_id", "operation", "key", F.col("request_hash").alias("_hash"))
    return requests.join(known, ["tenant_id", "operation", "key"], "left").withColumn("outcome", F.when(F.col("_hash").isNull(), "new").when(F.col("_hash") == F.col("request_hash"), "replay").otherwise("conflict")).drop("_hash")


def dispatch(rows: DataFrame, effects: dict[str, str]) -> DataFrame:
    """The effect of each event type; one without any is a dead letter."""
    effect = F.lit(None).cast("string")
    for event_type, name in effects.items():
        effect = F.when(F.col("event_type") == event_type, name).otherwise(effect)
    return rows.withColumn("effect", effect).withColumn("outcome", F.when(F.col("effect").isNull(), "dead_letter").otherwise("handled"))


#: Legal transitions by lifecycle, state -> operation -> next state; a state without operations is final.
LIFECYCLES: dict[str, dict[str, dict[str, str]]] = {
    "live_session": {
        "connecting": {"connected": "active", "connection_failed": "failed", "stop_requested": "stopped"},
        "active": {"stale_detected": "degraded", "stop_requested": "stopped", "fatal_error": "failed"},
        "degraded": {"reconnecting": "reconnecting", "stop_requested": "stopped", "fatal_error": "failed"},
        "reconnecting": {"reconnected": "active", "reconnect_failed": "degraded", "fatal_error": "failed", "stop_requested": "stopped"},
        "stopped": {}, "failed": {},
    },
    "configuration": {
        "draft": {"edit": "draft", "start_validation": "validating"},
        "validating": {"validation_succeeded": "validated", "validation_failed": "draft"},
        "validated": {"publish": "published"},
        "published": {},
    },
    "evidence": {
        "requested": {"queue": "queued", "expire": "expired"},
        "queued": {"start_extracting": "extracting", "expire": "expired"},
        "extracting": {"extraction_complete": "uploading", "retryable_failure": "retryable_failure", "terminal_failure": "terminal_failure", "expire": "expired"},
        "uploading": {"finalize": "finalized", "retryable_failure": "retryable_failure", "terminal_failure": "terminal_failure", "expire": "expired"},
        "retryable_failure": {"retry": "queued"},
        "finalized": {}, "terminal_failure": {}, "expired": {},
    },
}
#: Operations that change nothing in a final state.
IDEMPOTENT = {"live_session": ("stop_requested",), "configuration": ("publish",), "evidence": ()}


def illegal_transitions(log: DataFrame, lifecycle: str, entity: str = "entity_id") -> DataFrame:
    """Rows of a log (entity, at, seq, status) that do not legally follow the entity's row before."""
    legal = [f"{a}>{b}" for a, operations in LIFECYCLES[lifecycle].items() for b in operations.values()]
    before = F.lag("status").over(Window.partitionBy(entity).orderBy("at", "seq"))
    out = log.withColumn("previous", before)
    return out.where(F.col("previous").isNotNull() & ~F.concat_ws(">", "previous", "status").isin(legal))


def transitions(entities: DataFrame, requests: DataFrame, lifecycle: str) -> DataFrame:
    """Requests (entity_id, operation, one for an entity) with previous state, new_state and outcome: applied, unchanged (idempotent), terminal, illegal or unknown entity."""
    steps = [(a, o, b) for a, operations in LIFECYCLES[lifecycle].items() for o, b in operations.items()]
    target = F.lit(None).cast("string")
    for a, o, b in steps:
        target = F.when((F.col("previous") == a) & (F.col("operation") == o), b).otherwise(target)
    final = [a for a, operations in LIFECYCLES[lifecycle].items() if not operations]
    again = F.col("operation").isin(list(IDEMPOTENT[lifecycle])) & F.col("previous").isin(final)
    out = requests.join(entities.select("entity_id", F.col("status").alias("previous")), "entity_id", "left").withColumn("_target", target)
    outcome = F.when(F.col("previous").isNull(), "unknown").when(F.col("_target").isNotNull(), "applied").when(again, "unchanged").when(F.col("previous").isin(final), "terminal").otherwise("illegal")
    return out.withColumn("outcome", outcome).withColumn("new_state", F.coalesce("_target", "previous")).drop("_target")


def apply_transitions(entities: DataFrame, decided: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Entities with the new states of transitions(), and the log's new rows: one for each that was applied or left a final state unchanged."""
    applied = decided.where("outcome in ('applied', 'unchanged')")
    after = entities.join(applied.select("entity_id", F.col("new_state").alias("_new")), "entity_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return after, applied.select("entity_id", "previous", F.col("new_state").alias("status"), F.col("operation").alias("reason"), now.alias("at"))


#: Statuses that an outbox row's status may change to.
OUTBOX = {"pending": ("processing", "failed"), "processing": ("published", "failed", "pending"), "failed": ("pending", "processing"), "published": ()}


def guarded_outbox(rows: DataFrame, changes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Outbox rows (id, status, published_at, updated_at) after changes (id, status, published_at), and the changes that are refused.

    A change to the status that a row has passes and leaves the row's times; a legal one sets updated_at, and published_at
    where it publishes and has none. Others, those of unknown rows and null statuses are refused, with the status before.
    """
    legal = [f"{a}>{b}" for a, after in OUTBOX.items() for b in after]
    asked = changes.select("id", F.col("status").alias("_to"), F.col("published_at").alias("_at"))
    both = asked.join(rows.select("id", F.col("status").alias("_from")), "id", "left")
    moves, stays = F.concat_ws(">", "_from", "_to").isin(legal), F.col("_from") == F.col("_to")
    marked = both.withColumns({"_moves": F.coalesce(moves & F.col("_to").isNotNull(), F.lit(False)), "_stays": F.coalesce(stays, F.lit(False))})
    ok = F.col("_moves")
    out = rows.join(marked.where(ok).select("id", "_to", "_at", "_moves"), "id", "left")
    published = F.when(ok & (F.col("_to") == "published"), F.coalesce("_at", "published_at", now)).otherwise(F.col("published_at"))
    after = out.withColumns({"published_at": published, "updated_at": F.when(ok, now).otherwise(F.col("updated_at")), "status": F.coalesce("_to", "status")}).drop("_to", "_at", "_moves")
    return after, marked.where(~F.col("_moves") & ~F.col("_stays")).select("id", F.col("_from").alias("previous"), F.col("_to").alias("status"))


def recovered(work: DataFrame, now) -> DataFrame:
    """Evidence with a lease that ended: extracting is a retryable failure due at once, uploading resumes at its checkpoint."""
    stale = F.col("lease_until") <= now
    action = F.when(stale & (F.col("state") == "extracting"), "retry_now").when(stale & (F.col("state") == "uploading"), "resume_upload").otherwise("none")
    return work.withColumn("action", action)


def promoted(work: DataFrame, now, abandon_seconds: float) -> DataFrame:
    """requested becomes queued, requested or queued for too long expires, a retryable failure whose retry is due becomes queued."""
    old = F.unix_micros("created_at") <= F.unix_micros(now) - round(abandon_seconds * 1e6)
    state = F.when(F.col("state").isin("requested", "queued") & old, "expired").when(F.col("state") == "requested", "queued").when((F.col("state") == "retryable_failure") & (F.col("retry_at") <= now), "queued").otherwise(F.col("state"))
    return work.withColumn("new_state", state)


def evidence_cycle(work: DataFrame, worker: str, now, batch: int, abandon_seconds: float, lease_seconds: int) -> DataFrame:
    """One worker cycle in its order: requests are queued, abandoned ones expire, stale extractions fail and retry, due retries are queued, and the first `batch` queued ones without a lease are claimed."""
    step = recovered(work, now)
    again = F.col("action") == "retry_now"
    step = step.withColumns({"state": F.when(again, "retryable_failure").otherwise(F.col("state")), "retry_at": F.when(again, now).otherwise(F.col("retry_at"))})
    step = promoted(step, now, abandon_seconds).withColumn("state", F.col("new_state")).drop("new_state")
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    ready = step.where((F.col("state") == "queued") & free).orderBy("created_at", "id").limit(batch).select("id", F.lit(True).alias("_claimed"))
    both, claimed = step.join(ready, "id", "left"), F.col("_claimed").isNotNull()
    until = F.timestamp_micros(F.unix_micros(now) + lease_seconds * 1_000_000)
    return both.withColumns({
        "state": F.when(claimed, "extracting").otherwise(F.col("state")), "claimed_by": F.when(claimed, worker).otherwise(F.col("claimed_by")),
        "lease_until": F.when(claimed, until).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + claimed.cast("int"),
    }).drop("_claimed")


def expired(media: DataFrame, now, limit: int) -> DataFrame:
    """Media whose retention is over; those already pending deletion are tried again."""
    return media.where(F.col("state").isin("available", "deletion_pending") & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(limit)


def stale_uploads(media: DataFrame, older_than, limit: int) -> DataFrame:
    return media.where((F.col("state") == "uploading") & (F.col("created_at") < older_than)).orderBy("created_at", "id").limit(limit)


#: States of media whose object should be there.
RECONCILED = ("uploaded", "validating", "available", "expired", "deletion_pending")


def reconcilable(media: DataFrame, older_than, limit: int, states: tuple[str, ...] = RECONCILED) -> DataFrame:
    """Media whose object should be looked for again."""
    return media.where(F.col("state").isin(*states) & (F.col("updated_at") < older_than)).orderBy("updated_at", "id").limit(limit)


def reclaimable(messages: DataFrame, now, idle_seconds: float, limit: int) -> DataFrame:
    """Delivered, unacknowledged messages that were idle for at least idle_seconds, oldest first."""
    idle = F.unix_micros(now) - F.unix_micros("delivered_at") >= round(idle_seconds * 1e6)
    return messages.where(~F.col("acknowledged") & idle).orderBy("delivered_at", "id").limit(limit)


def routed(rows: DataFrame) -> DataFrame:
    """What a resolution means for its work: continue, retry or a final state."""
    r = F.col("resolution")
    return rows.withColumn("route", F.when(r.isin("resolved", "partial"), "continue").when(r == "auth_failure", "failed").when((r == "not_found") & (F.col("attempts") < F.col("most_attempts")), "retry").otherwise("failed"))


def orphans(objects: DataFrame, rows: DataFrame, now, grace_seconds: float) -> tuple[DataFrame, DataFrame]:
    """Stored objects without a live row that are older than the grace, and rows whose object is missing with their next state."""
    live = rows.where(~F.col("state").isin("failed", "deleted")).select("object_key")
    old = F.unix_micros(now) - F.unix_micros("modified_at") >= round(grace_seconds * 1e6)
    lost = rows.where(~F.col("state").isin("failed", "deleted")).join(objects.select("object_key"), "object_key", "left_anti")
    return objects.join(live, "object_key", "left_anti").where(old), lost.withColumn("new_state", F.when(F.col("state").isin("deletion_pending", "expired"), "deleted").otherwise("failed"))
