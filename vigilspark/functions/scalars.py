"""Scalar functions: checks, backoff, retention, object keys, media signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions import ids

#: Days of each retention class (None never expires) and each category's default.
RETENTION_DAYS = {"cctv_30_days": 30, "evidence_365_days": 365, "report_730_days": 730, "analytics_90_days": 90, "standard_90_days": 90, "legal_hold": None}
CATEGORY_CLASS = {"recordings": "cctv_30_days", "evidence": "evidence_365_days", "reports": "report_730_days", "analytics": "analytics_90_days", "temporary": "standard_90_days"}
#: Formats that a category accepts, and its largest size.
CATEGORY_FORMATS = {"recordings": ("mp4",), "evidence": ("jpeg", "png"), "reports": ("pdf",), "analytics": ("json", "gzip-json"), "temporary": ("mp4", "jpeg", "png", "pdf", "json", "gzip-json")}
MIME_FORMATS = {"video/mp4": "mp4", "video/quicktime": "mp4", "image/jpeg": "jpeg", "image/jpg": "jpeg", "image/png": "png", "application/pdf": "pdf", "application/json": "json", "application/gzip": "gzip-json", "application/x-gzip": "gzip-json"}
CATEGORY_BYTES = {"recordings": 50 << 30, "evidence": 512 << 20, "reports": 512 << 20, "analytics": 4 << 30, "temporary": 4 << 30}
SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "authorization", "private_key")


def lookup(value: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_rule_version(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^v[0-9]+(\.[0-9]+)*$"), F.lit(False))


def is_idempotency_key(x: Column, most: int = 128) -> Column:
    return F.coalesce(x.rlike(f"^[\\x21-\\x7e]{{1,{most}}}$"), F.lit(False))


def redact_url(x: Column) -> Column:
    """A url without user and password."""
    return F.regexp_replace(x, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def truncate_error(x: Column, most: int = 2000) -> Column:
    return F.left(x, F.lit(most))


def backoff(attempt: Column, base: float, most: float, jitter: Column | None = None) -> Column:
    """min(most, base * 2^(attempt-1)), plus a share of itself where jitter (0 to 1) is given, capped again."""
    delay = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(32)).cast("double")))
    return delay if jitter is None else F.least(F.lit(float(most)), delay * (1 + jitter))


def retention_class(category: Column, requested: Column) -> Column:
    """The requested class if it is known, else the category's default."""
    return F.when(requested.isin(*RETENTION_DAYS), requested).otherwise(lookup(category, CATEGORY_CLASS))


def retention_deadline(cls: Column, created: Column) -> Column:
    """Null for classes that never expire."""
    return F.timestamp_micros(F.unix_micros(created) + lookup(cls, {k: v * 86_400_000_000 for k, v in RETENTION_DAYS.items() if v}).cast("long"))


def is_protected(cls: Column, hold: Column) -> Column:
    return (cls == "legal_hold") | F.coalesce(hold, F.lit(False))


def retention_state(cls: Column, created: Column, now: Column, hold: Column, deleted: Column, pending: Column) -> Column:
    """deleted, preserved, expired, deletion_pending, active, in this order of precedence."""
    return (
        F.when(F.coalesce(deleted, F.lit(False)), "deleted")
        .when(is_protected(cls, hold), "preserved")
        .when(now >= retention_deadline(cls, created), "expired")
        .when(F.coalesce(pending, F.lit(False)), "deletion_pending")
        .otherwise("active")
    )


def object_key(tenant: Column, venue: Column, category: Column, artifact: Column, extension: Column, captured: Column) -> Column:
    return F.concat(F.lit("tenants/"), tenant, F.lit("/venues/"), venue, F.lit("/"), category, F.lit("/"), F.translate(ids.utc_date(captured).cast("string"), "-", "/"), F.lit("/"), artifact, F.lit("."), normal_extension(extension))


def normal_extension(x: Column) -> Column:
    """Lower-cased without leading dots; null where it has other characters."""
    e = F.lower(F.regexp_replace(x, r"^\.+", ""))
    return F.when(e.rlike(r"^[a-z0-9_]+(\.[a-z0-9_]+)*$"), e)


_UUID = "[0-9a-fA-F-]{36}"
KEY_PATTERN = rf"^tenants/({_UUID})/venues/({_UUID})/([a-z]+)/([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}})/({_UUID})\.([a-zA-Z0-9_.]+)$"


def parse_key(key: Column) -> Column:
    """Parts of an object key; null where it does not fit the grammar or names no known category."""
    part = lambda i: F.regexp_extract(key, KEY_PATTERN, i)
    fields = ("tenant_id", "venue_id", "category", "year", "month", "day", "artifact_id", "extension")
    return F.when(key.rlike(KEY_PATTERN) & part(3).isin(*CATEGORY_CLASS), F.struct(*(part(i).alias(n) for i, n in enumerate(fields, 1))))


def media_format(header: Column) -> Column:
    """Format by the first bytes."""
    begins = lambda n, text: F.substring(header, 1, n) == F.unhex(F.lit(text))
    text = F.regexp_replace(F.decode(F.substring(header, 1, 64), "ISO-8859-1"), "^[ï»¿ \\t\\r\\n]+", "")
    return (
        F.when(begins(8, "89504E470D0A1A0A"), "png").when(begins(3, "FFD8FF"), "jpeg").when(begins(5, "255044462D"), "pdf").when(begins(2, "1F8B"), "gzip-json")
        .when(F.substring(header, 5, 4) == F.unhex(F.lit("66747970")), "mp4").when(text.rlike(r"^[{\[]"), "json").otherwise("unknown")
    )


def media_verdict(category: Column, content_type: Column, header: Column, size: Column) -> Column:
    """Null where the content is valid, else the first reason why not."""
    found, declared = media_format(header), lookup(F.trim(F.substring_index(F.lower(content_type), ";", 1)), MIME_FORMATS)
    allowed = F.lit(False)
    for c, formats in CATEGORY_FORMATS.items():
        allowed = F.when(category == c, found.isin(*formats)).otherwise(allowed)
    return (
        F.when(header.isNull() | (F.length(header) == 0), "empty").when(found == "unknown", "unknown_format").when(~allowed, "format_not_allowed")
        .when(declared.isNotNull() & (declared != found), "type_mismatch").when(size > lookup(category, CATEGORY_BYTES), "too_large")
    )


def has_secret_key(metadata: Column) -> Column:
    """Whether a key of the map looks like that of a secret."""
    return F.exists(F.map_keys(metadata), lambda k: F.lower(k).rlike("|".join(SECRET_WORDS)))


def nth_percentile(values: Column, percent: float) -> Column:
    """Element at index min(n - 1, int(percent / 100 * n)) of the sorted array."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(F.lit(percent / 100) * n).cast("int")))
