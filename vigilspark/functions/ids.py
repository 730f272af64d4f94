"""Content-derived identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions.numbers import shortest

#: Fixed value: the URL namespace of name-based UUIDs.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


_DAY = 86_400_000_000


def _of_day(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(_DAY))


def utc_date(ts: Column) -> Column:
    """The day in UTC, whatever the session's zone."""
    days = (F.unix_micros(ts) - _of_day(ts)) / _DAY
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def _utc_text(ts: Column) -> Column:
    s = F.floor(_of_day(ts) / 1_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(utc_date(ts).cast("string"), F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def utc_second_text(ts: Column) -> Column:
    """Day and time in UTC to the second, with a blank between."""
    return F.translate(_utc_text(ts), "T", " ")


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC, whatever the session's zone; the fraction is left out where it is zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(_utc_text(ts), F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def lease_time(ts: Column) -> Column:
    """Fixed-width ISO text in UTC, which sorts as time does."""
    return F.concat(_utc_text(ts), F.lit("."), F.lpad(F.pmod(F.unix_micros(ts), F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("+00:00"))


def parsed_utc(text: Column) -> Column:
    """The time of ISO text with an offset or Z; text without one (a naive time) or of another form is null."""
    aware = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(aware, F.try_to_timestamp(text))


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def joined(*parts: Column | str) -> Column:
    """Parts in order between bars; null counts as empty."""
    return F.concat_ws("|", *(F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def key_canonical(kind, tenant, venue, session, camera, config, track, context) -> Column:
    return joined(kind, tenant, venue, session, camera, config, track, context)


def track_uuid(session: Column, local: Column) -> Column:
    return uuid5(F.concat(session.cast("string"), F.lit(":"), local.cast("string")))


def rule_event_id(tenant, venue, session, camera, track, context, rule, version, event_type, event_time, config) -> Column:
    return uuid5(joined("rule_event", tenant, venue, session, camera, track, context, rule, version, event_type, iso(event_time), config))


def evidence_ref_id(event_id: Column, session: Column) -> Column:
    return uuid5(joined("rule_evidence", event_id, session))


def interval_id(kind: str, key: Column, start: Column, end: Column, fsm_version: str, policy: str) -> Column:
    """Open intervals bind key and start, closed ones also the end."""
    return uuid5(F.when(end.isNull(), joined(kind, key, iso(start), fsm_version, policy)).otherwise(joined(kind, key, iso(start), iso(end), fsm_version, policy)))


def transition_id(key: Column, frame: Column, event_time: Column, from_state: Column, to_state: Column, kind: Column, reason: Column) -> Column:
    return uuid5(joined(key, frame, iso(event_time), from_state, to_state, kind, reason))


def snapshot_id(key: Column, event_time: Column, count: Column, source: Column) -> Column:
    return uuid5(joined("occupancy_snapshot", key, iso(event_time), count, source))


def measurement_id(key: Column, before: Column, now: Column, x0: Column, y0: Column, x1: Column, y1: Column, fsm_version: str, policy: str) -> Column:
    return uuid5(joined(key, iso(before), iso(now), *(shortest(c) for c in (x0, y0, x1, y1)), fsm_version, policy))


def extraction_id(ref: Column, start: Column, end: Column) -> Column:
    return uuid5(joined("evidence_extraction", ref, iso(start), iso(end)))


def package_id(ref: Column, sha256: Column) -> Column:
    return uuid5(joined("evidence_package", ref, sha256))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)
