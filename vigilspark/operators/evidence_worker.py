"""One cycle of the evidence worker over a table of requests: queue, expire, recover, promote, claim, then resolve, check, package and finalize.

Every step takes the first `batch` rows by (created_at, id) that it applies to and sees what the
steps before it did. A step's selection is a bound on that order, found by one small top-k, so a
cycle adds no join per step. The table is written twice on its way, which keeps plans small and
cuts the lineage. Claimed rows pass the stages together; what fails leaves as a retry or
as a terminal row with its reason, and the rest ends finalized with a package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import ids
from vigilspark.functions.scalars import backoff, truncate_error
from vigilspark.operators import evidence
from vigilspark.sources.commits import stored

STALE, ABANDONED, EXHAUSTED = "lease expired - crashed claim recovered", "abandoned evidence request expired", "retry budget exhausted: "
_REQUEST = ("event_id", "tenant_id", "venue_id", "video_asset_id", "camera_id", "session_id", "start_time", "end_time")


@dataclass(frozen=True)
class Settings:
    batch: int = 100
    lease_seconds: int = 300
    request_timeout_seconds: float = 86400.0
    most_attempts: int = 5
    backoff_base: float = 5.0
    backoff_most: float = 600.0


def _first(work: DataFrame, hit: Column, batch: int) -> Column:
    """Condition of the first `batch` rows that hit."""
    place = F.struct("created_at", "id")
    top = work.where(hit).select(place.alias("p")).orderBy("p").limit(batch).agg(F.max("p").alias("p"), F.count("*").alias("n")).first()
    hit = F.coalesce(hit, F.lit(False))
    if top["n"] < batch:
        return hit
    at, last = top["p"]["created_at"], F.lit(top["p"]["id"])
    if at is None:
        return hit & F.col("created_at").isNull() & (F.col("id") <= last)
    at = F.lit(at)
    return hit & (F.col("created_at").isNull() | (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") <= last)))


def intact(media: Column, checksum: Column) -> Column:
    """Whether an artifact has a place and a lower-case SHA-256."""
    return F.coalesce((media != "") & checksum.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def claimed(work: DataFrame, worker: str, now: Column, s: Settings) -> DataFrame:
    """The table after the steps before processing, with step: what this cycle did last to a row (null: nothing)."""
    until, state, stamp = F.timestamp_micros(F.unix_micros(now) + s.lease_seconds * 1_000_000), F.col("state"), F.lit(None).cast("timestamp")
    cutoff = F.timestamp_micros(F.unix_micros(now) - round(s.request_timeout_seconds * 1e6))
    taken: list[str] = []

    def take(w: DataFrame, name: str, hit: Column, to: Column | str) -> DataFrame:
        """w with the flag of a step's rows, and their next state."""
        taken.append(name)
        return w.withColumn(name, _first(w, hit, s.batch)).withColumn("state", F.when(F.col(name), to).otherwise(state))

    w = work.withColumn("state", F.coalesce("state", F.lit("requested")))
    w = take(w, "_queued", state == "requested", "queued")
    w = take(w, "_expired", state.isin("requested", "queued") & (F.col("created_at") <= cutoff), "expired")
    w = take(w, "_stale", state.isin("extracting", "uploading") & (F.col("lease_until") <= now), F.when(state == "extracting", "retryable_failure").otherwise(state))
    fresh = F.col("_stale") & (state == "retryable_failure")  # recovered just now: due, and without a lease
    w = stored(w.withColumn("_recovered", fresh), "evidence-cycle")
    w = take(w, "_promoted", (state == "retryable_failure") & (F.col("_recovered") | F.col("retry_at").isNull() | (F.col("retry_at") <= now)), "queued")
    w = take(w, "_claimed", (state == "queued") & (F.col("_recovered") | F.col("lease_until").isNull() | (F.col("lease_until") <= now)), "extracting")
    resumed = F.col("_stale") & ~F.col("_recovered")
    values = {
        "retry_at": F.when(F.col("_promoted"), stamp).when(F.col("_recovered"), now).otherwise(F.col("retry_at")),
        "lease_until": F.when(F.col("_claimed") | resumed, until).when(F.col("_recovered"), stamp).otherwise(F.col("lease_until")),
        "claimed_by": F.when(F.col("_claimed") | F.col("_stale"), worker).otherwise(F.col("claimed_by")),
        "attempts": F.when(F.col("_claimed"), F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")),
        "last_error": F.when(F.col("_expired"), ABANDONED).when(F.col("_recovered"), STALE).otherwise(F.col("last_error")),
        "step": F.when(F.col("_claimed"), "claimed").when(F.col("_promoted"), "promoted").when(F.col("_recovered"), "recovered").when(resumed, "resumed").when(F.col("_expired"), "expired").when(F.col("_queued"), "queued"),
    }
    return stored(w.withColumns(values).drop(*taken, "_recovered"), "evidence-cycle")


def cycle(work: DataFrame, candidates: DataFrame, lookup_errors: DataFrame, extractions: DataFrame, worker: str, now: Column, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next table, the packages of what this cycle finalized, and its log (ref_id, previous, status, reason).

    work: id, state, created_at, retry_at, lease_until, claimed_by, attempts, last_error, has_request, the request's columns,
    and media_path, checksum of the upload checkpoint. candidates: as evidence.resolve() takes them. lookup_errors: ref_id,
    error of candidate lookups that failed. extractions: ref_id, event_id, status (success, partial, cancelled,
    source_not_found, corrupt_source, failed), media_path, checksum, reason of what the extractor gave, one row a request.

    Without an extraction, or with a cancelled one, a claimed row keeps its claim until the lease ends. A package is refused
    if the extraction is of another event. An uploading row whose worker died is finalized from its checkpoint.
    """
    after = claimed(work, worker, now, s)
    mine = F.col("step").isin("claimed", "resumed")
    claims = after.where(F.col("step") == "claimed")
    resolved = evidence.resolve(claims.select(F.col("id").alias("ref_id"), *_REQUEST), candidates).select(F.col("ref_id").alias("id"), F.col("resolution").alias("_resolution"), F.col("reason").alias("_why"))
    failed = lookup_errors.groupBy(F.col("ref_id").alias("id")).agg(F.min("error").alias("_lookup"))
    given = extractions.select(F.col("ref_id").alias("id"), F.col("event_id").alias("_event"), F.col("status").alias("_got"), F.col("media_path").alias("_media"), F.col("checksum").alias("_sum"), F.col("reason").alias("_said"))
    both = after.join(resolved, "id", "left").join(failed, "id", "left").join(given, "id", "left")

    resumed, got, request = F.col("step") == "resumed", F.col("_got"), F.coalesce("has_request", F.lit(False))
    fresh_ok, kept_ok = intact(F.col("_media"), F.col("_sum")), intact(F.col("media_path"), F.col("checksum"))
    done = F.col("_resolution").isin("resolved", "partial")
    other = got.isin("success", "partial") & ~F.col("_event").eqNullSafe(F.col("event_id"))
    outcome = (
        F.when(resumed & F.col("checksum").isNull() & F.col("media_path").isNull(), "terminal:upload checkpoint missing").when(~request, "terminal:request contract missing")
        .when(resumed & ~kept_ok, "terminal:checkpoint artifact failed integrity verification").when(resumed, "finalized:")
        .when(F.col("_lookup").isNotNull(), F.concat(F.lit("retry:source candidate lookup failed: "), "_lookup")).when(~done, F.concat(F.lit("terminal:"), "_why"))
        .when(got.isNull() | (got == "cancelled"), "waiting:").when(got.isin("source_not_found", "corrupt_source"), F.concat(F.lit("terminal:"), F.coalesce("_said", "_got")))
        .when(got == "failed", F.concat(F.lit("retry:"), F.coalesce("_said", F.lit("extraction failed")))).when(~fresh_ok, "retry:artifact integrity verification failed").when(other, "refused:package of another event").otherwise("finalized:")
    )
    both = both.withColumn("_all", F.when(mine, outcome)).withColumn("_kind", F.substring_index("_all", ":", 1)).withColumn("_reason", F.expr("substring(_all, length(_kind) + 2)"))
    spent = (F.col("_kind") == "retry") & (F.col("attempts") >= s.most_attempts)
    both = both.withColumns({"_reason": F.when(spent, F.concat(F.lit(EXHAUSTED), "_reason")).otherwise(F.col("_reason")), "_kind": F.when(spent, "terminal").otherwise(F.col("_kind"))})
    kind, retry_at = F.col("_kind"), F.timestamp_micros(F.unix_micros(now) + (backoff(F.col("attempts"), s.backoff_base, s.backoff_most) * 1e6).cast("long"))
    uploaded = kind.isin("finalized", "refused") & ~resumed  # the checkpoint is written before the package
    state = F.when(kind == "finalized", "finalized").when(kind.isin("terminal", "refused"), "terminal_failure").when(kind == "retry", "retryable_failure").otherwise(F.col("state"))
    ended = both.withColumns({
        "_previous": F.when(resumed | (kind == "refused"), "uploading").otherwise("extracting"),
        "media_path": F.when(uploaded, F.col("_media")).otherwise(F.col("media_path")), "checksum": F.when(uploaded, F.col("_sum")).otherwise(F.col("checksum")),
    }).withColumns({
        "state": state, "retry_at": F.when(kind == "retry", retry_at).otherwise(F.col("retry_at")),
        "last_error": F.when(kind.isin("retry", "terminal", "refused"), truncate_error(F.col("_reason"), 512)).otherwise(F.col("last_error")),
        "package_id": F.when(kind == "finalized", ids.package_id(F.col("id"), F.col("checksum"))),
    })
    packages = ended.where("package_id is not null").select("package_id", F.col("id").alias("ref_id"), "tenant_id", "venue_id", F.concat(F.lit("evidence for event "), F.col("event_id").cast("string")).alias("description"))
    own = ended.where(kind.isin("retry", "terminal", "refused", "finalized")).select(F.col("id").alias("ref_id"), F.col("_previous").alias("previous"), F.col("state").alias("status"), F.when(kind != "finalized", F.col("_reason")).alias("reason"))
    early = ended.where(F.col("step").isin("expired", "recovered")).select(F.col("id").alias("ref_id"), F.lit(None).cast("string").alias("previous"), "state", "last_error")
    return ended.select(*work.columns, "package_id"), packages, own.union(early)
