"""Scoped reads: every query filters by tenant first, then by the actor's venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import ids


class Actor:
    def __init__(self, tenant_id, venues=()):
        self.tenant_id, self.venues = tenant_id, tuple(venues)


def scoped(df: DataFrame, actor: Actor) -> DataFrame:
    """Rows of the actor's tenant and venues (no venues: all of them); both filters reach the scan."""
    own = df.where(F.col("tenant_id") == actor.tenant_id)
    return own.where(F.col("venue_id").isin(*actor.venues)) if actor.venues else own


#: Tables under row-level security, and the column that holds each row's tenant.
ROW_POLICIES = {t: "tenant_id" for t in ("venues", "sessions", "configurations", "evidence_refs", "evidence_packages", "audit_events", "outbox_events", "inbox_messages")}


def secured(tables: dict[str, DataFrame], tenant_id, policies: dict[str, str] = ROW_POLICIES) -> dict[str, DataFrame]:
    """Each table's rows of a tenant under its policy. Without a tenant no row is seen; a table without a policy is an error, so nothing is open by oversight."""
    if missing := sorted(set(tables) - set(policies)):
        raise PermissionError(f"no row policy for {missing}")
    return {name: df.where(F.lit(False) if tenant_id is None else F.col(policies[name]) == tenant_id) for name, df in tables.items()}


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each group, in one aggregation."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def current_published(versions: DataFrame, configurations: DataFrame) -> DataFrame:
    """The version that each configuration points to, where it is published."""
    return versions.join(configurations.select("tenant_id", "configuration_id", "current_version_id"), ["tenant_id", "configuration_id"]).where("version_id = current_version_id and status = 'published'")


def pinned(sessions: DataFrame, versions: DataFrame) -> DataFrame:
    """Each session's pinned version where it is published, never the latest instead; an unpinned session has none."""
    v = versions.where("status = 'published'").select(F.col("version_id").alias("pinned_version_id"), "content_revision")
    return sessions.join(v, "pinned_version_id", "left").select("session_id", F.when(F.col("content_revision").isNotNull(), F.col("pinned_version_id")).alias("version_id"))


def history(log: DataFrame, entity, limit: int = 100) -> DataFrame:
    return log.where(F.col("entity_id") == entity).orderBy(F.desc("at"), F.desc("seq")).limit(limit)


def last_transition(sessions: DataFrame, log: DataFrame) -> DataFrame:
    newest = log.groupBy("entity_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "seq")).alias("last"))
    return sessions.join(newest, sessions["session_id"] == newest["entity_id"], "left").select("session_id", F.col("last.status").alias("last_status"), F.col("last.at").alias("last_at"))


def with_availability(events: DataFrame, evidence: DataFrame) -> DataFrame:
    have = evidence.where("state = 'available'").select("event_id").distinct().withColumn("_a", F.lit(True))
    return events.join(have, "event_id", "left").withColumn("evidence_available", F.coalesce("_a", F.lit(False))).drop("_a")


def due(df: DataFrame, time: str, now, limit: int, order: str = "id") -> DataFrame:
    """The first `limit` rows whose time has come."""
    return df.where(F.col(time) <= now).orderBy(time, order).limit(limit)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def latency_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median, p50, p95, p99, min, max; percentiles are elements at min(n - 1, int(p * n)).

    Ranks are taken per group over counts of equal values, so a group is never gathered in one row.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda i: F.min(F.when(F.col("_hi") > i, F.col(value)))
    pick = lambda p: at(F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))))
    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), middle.alias("median"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.min(value).alias("min"), F.max(value).alias("max"))


#: Statuses of a live session that runs.
RUNNING = ("connecting", "active", "degraded", "reconnecting")


def ordered_versions(versions: DataFrame, configuration) -> DataFrame:
    return versions.where(F.col("configuration_id") == configuration).orderBy("number")


def of_camera(sessions: DataFrame, camera, status: str | None = None) -> DataFrame:
    """A camera's sessions, newest first, of one status if given."""
    return listed(sessions, camera_id=camera, status=status).orderBy(F.desc("started_at"), "session_id")


def running(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status").isin(*RUNNING))


def listed(df: DataFrame, **wanted) -> DataFrame:
    """Rows with these values; None asks for nothing."""
    for column, value in wanted.items():
        df = df if value is None else df.where(F.col(column) == value)
    return df


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def distinct_pairs(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns).limit(limit)


def stale_leases(refs: DataFrame, now, limit: int) -> DataFrame:
    """Refs (id, created_at, metadata as JSON text) that are extracting or uploading and whose lease, fixed-width ISO text, has ended."""
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    ended = field("processing_lease_until") <= ids.lease_time(now)
    return refs.where(field("processing_state").isin("extracting", "uploading") & ended).orderBy("created_at", "id").limit(limit)


def linked(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests (ref_id, event_id) with the row that holds their ref_id: the existing one, else the first request of it."""
    known = existing.select("ref_id", F.col("event_id").alias("_known"))
    first = F.min("event_id").over(Window.partitionBy("ref_id"))
    out = requests.join(known, "ref_id", "left").withColumn("linked_event_id", F.coalesce("_known", first))
    return out.withColumn("created", F.col("_known").isNull() & (F.col("event_id") == F.col("linked_event_id"))).drop("_known")


def resolved_models(requests: DataFrame, registry: DataFrame, require_active: bool = True) -> DataFrame:
    """Requests (model_id, version or null) with resolved_version and outcome: ok, not_found, version_required (several and none named), version_not_found or unavailable (not active)."""
    models = registry.groupBy("model_id").agg(F.count("*").alias("_versions"), F.min("version").alias("_only"))
    wanted = requests.join(models, "model_id", "left").withColumn("_wanted", F.coalesce("version", F.when(F.col("_versions") == 1, F.col("_only"))))
    known = registry.select("model_id", F.col("version").alias("_wanted"), F.col("state").alias("_state"))
    out = wanted.join(known, ["model_id", "_wanted"], "left")
    usable = (F.col("_state") == "active") | F.lit(not require_active)
    outcome = F.when(F.col("_versions").isNull(), "not_found").when(F.col("_wanted").isNull(), "version_required").when(F.col("_state").isNull(), "version_not_found").when(usable, "ok").otherwise("unavailable")
    return out.withColumn("outcome", outcome).withColumn("resolved_version", F.when(F.col("outcome") == "ok", F.col("_wanted"))).drop("_versions", "_only", "_wanted", "_state")
