"""Rules over facts as DataFrame functions, the rule registry, data-quality checks and evidence requests.

A rule adds status (match, no_match, invalid), reason and event_type to facts. Facts need
their columns named as in the contracts, plus tenant, venue, session, camera, track,
context, config for identities. Durations that are not numbers match nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import ids
from vigilspark.functions.scalars import is_rule_version

MATCH, NO_MATCH, INVALID = "match", "no_match", "invalid"
#: Evidence requirements of a rule.
EVIDENCE = ("required", "optional", "none")


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


@dataclass(frozen=True)
class Result:
    """What a rule says of a fact, as Columns over the fact. details: further named values, as text.

    claims: identities that an evaluator states itself (rule_id, rule_version, config, event_time, event_id); they are checked.
    """

    status: Column
    reason: Column
    event_type: Column
    details: dict[str, Column] = field(default_factory=dict)
    claims: dict[str, Column] = field(default_factory=dict)


def _result(invalid: list[tuple[Column, str]], matched: Column, event_type: Column | str, **details: Column) -> Result:
    reason = reduce(lambda acc, x: F.coalesce(acc, F.when(F.coalesce(x[0], F.lit(True)), F.lit(x[1]))), invalid, F.lit(None).cast("string"))
    status = F.when(reason.isNotNull(), INVALID).when(F.coalesce(matched, F.lit(False)), MATCH).otherwise(NO_MATCH)
    return Result(status, reason, F.when(status == MATCH, F.lit(event_type) if isinstance(event_type, str) else event_type), details)


def _applied(facts: DataFrame, result: Result) -> DataFrame:
    return facts.withColumns({"reason": result.reason, "status": result.status, "event_type": result.event_type} | result.details)


def _duration_checks() -> list[tuple[Column, str]]:
    d = F.col("duration_seconds")
    return [(F.col("event_time") != F.col("last_seen"), "event_time_mismatch"), (d.isNull() | F.isnan(d), "missing_duration"), (d < 0, "negative_duration")]


def occupancy_result(config: dict) -> Result:
    started = (F.col("previous_count") == 0) & (F.col("occupancy_count") > 0)
    ended = (F.col("previous_count") > 0) & (F.col("occupancy_count") == 0)
    wrong = (F.col("previous_count") < 0) | (F.col("occupancy_count") < 0)
    return _result([(wrong, "negative_count")], started | ended, "occupancy_session", phase=F.when(~wrong, F.when(started, "started").when(ended, "ended")))


def dwell_result(config: dict) -> Result:
    return _result(_duration_checks(), F.col("duration_seconds") >= float(config["dwell_threshold_seconds"]), "dwell_threshold_exceeded")


def queue_result(config: dict) -> Result:
    areas, limit = list(config["queue_area_ids"]), float(config["waiting_qualification_seconds"])
    return _result(_duration_checks(), F.col("context").isin(areas) & (F.col("duration_seconds") >= limit), "queue_candidate")


def queue_v2_result(config: dict) -> Result:
    if config["queue_max_length"] <= 0:
        raise ValueError("queue_max_length must be positive")
    return queue_result(config)


def service_gap_result(config: dict) -> Result:
    areas, grace = list(config["service_area_ids"]), float(config["service_gap_grace_seconds"])
    return _result(_duration_checks(), F.col("interval_end").isNull() & F.col("context").isin(areas) & (F.col("duration_seconds") >= grace), "service_gap_candidate")


def turnover_result(config: dict) -> Result:
    """Open dwell with a context; where first_occupancy is given it must be positive."""
    limit = float(config["service_window_seconds"]) + float(config["turnover_delay_seconds"])
    occupied = F.col("first_occupancy").isNull() | (F.col("first_occupancy") > 0)
    return _result(_duration_checks(), F.col("interval_end").isNull() & F.col("context").isNotNull() & occupied & (F.col("duration_seconds") >= limit), "turnover_delay")


def occupancy_session(snapshots: DataFrame, config: dict) -> DataFrame:
    return _applied(snapshots, occupancy_result(config))


def dwell_threshold(intervals: DataFrame, config: dict) -> DataFrame:
    return _applied(intervals, dwell_result(config))


def queue_candidate(intervals: DataFrame, config: dict) -> DataFrame:
    return _applied(intervals, queue_result(config))


def queue_candidate_v2(intervals: DataFrame, config: dict) -> DataFrame:
    return _applied(intervals, queue_v2_result(config))


def service_gap_candidate(intervals: DataFrame, config: dict) -> DataFrame:
    return _applied(intervals, service_gap_result(config))


def turnover_delay(intervals: DataFrame, config: dict) -> DataFrame:
    return _applied(intervals, turnover_result(config))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: str
    evaluate: Callable[[DataFrame, dict], DataFrame]
    fact_type: str
    requires: tuple[str, ...] = ()
    evidence: str = "required"
    positive: tuple[str, ...] = field(default=())
    engine_version: str = "1"
    #: the same as Columns, for many rules in one pass
    result: Callable[[dict], Result] | None = None


#: Parts of a fact's scope, which rules need (data quality tells of facts that lack them instead).
SCOPE = ("tenant", "venue", "session", "config")
_IDENTITY = ("tenant", "venue", "session", "camera", "track", "context", "rule_id", "rule_version", "event_type", "event_time", "config")


class Registry:
    """Rules by (id, version); a second registration of either is an error, as is an evaluator or engine version that is not allowed."""

    def __init__(self, evaluators: tuple[str, ...] | None = None, engine_versions: tuple[str, ...] = ("1",)):
        self._rules: dict[tuple[str, str], Rule] = {}
        self._evaluators, self._engine_versions = evaluators, engine_versions

    def register(self, rule: Rule) -> None:
        if (rule.rule_id, rule.version) in self._rules:
            raise ValueError(f"rule {rule.rule_id} {rule.version} is registered")
        if not rule.version.startswith("v") or not all(p.isdigit() for p in rule.version[1:].split(".")):
            raise ValueError(f"bad rule version {rule.version}")
        if self._evaluators is not None and rule.rule_id not in self._evaluators:
            raise ValueError(f"no evaluator {rule.rule_id}")
        if rule.engine_version not in self._engine_versions:
            raise ValueError(f"engine version {rule.engine_version} is not supported")
        if rule.evidence not in EVIDENCE:
            raise ValueError(f"bad evidence requirement {rule.evidence}")
        self._rules[rule.rule_id, rule.version] = rule

    def _rule(self, rule_id: str, version: str, config: dict) -> Rule:
        rule = self._rules.get((rule_id, version))
        if rule is None:
            raise KeyError(f"no rule {rule_id} {version}")
        if missing := sorted(set(rule.requires) - set(config)):
            raise ValueError(f"{rule_id}: configuration lacks {missing}")
        if wrong := [k for k in rule.positive if not config[k] > 0]:
            raise ValueError(f"{rule_id}: must be positive: {wrong}")
        return rule

    def evaluate(self, rule_id: str, version: str, facts: DataFrame, config: dict) -> DataFrame:
        """Facts with the rule's status, reason and event columns, and the event id of matches; results are checked (result_error) and the rule's evidence policy applied.

        Facts that name another fact_type than the rule's are left out.
        """
        rule = self._rule(rule_id, version, config)
        if "fact_type" in facts.columns and rule.fact_type != "any":
            facts = facts.where(F.col("fact_type") == rule.fact_type)
        given = facts.withColumns({"fact_config": F.col("config"), "fact_event_time": F.col("event_time")})
        out = rule.evaluate(given, config)
        out = out.withColumns({c: F.col(c) if c in out.columns and c not in facts.columns else F.lit(v) for c, v in (("rule_id", rule_id), ("rule_version", version))})
        made = F.when(F.col("status") == MATCH, ids.rule_event_id(*(F.col(c) for c in _IDENTITY)))
        out = out.withColumn("event_id", made) if "event_id" not in out.columns or "event_id" in facts.columns else out
        checked = result_errors(out, rule_id, version).withColumn("result_error", F.coalesce("result_error", F.when(F.col("event_id") != made, "event_id_differs")))
        return with_evidence(checked.drop("fact_config", "fact_event_time"), rule.evidence)

    def evaluate_all(self, facts: DataFrame, chosen: list[tuple[str, str, dict]], keep: tuple[str, ...]) -> DataFrame:
        """Results of many rules (id, version, configuration) over facts in one pass: one row for each fact and rule of its fact_type.

        facts: fact_type and the columns that the rules read. Rows are keep (columns of the fact), rule_id, rule_version,
        status, reason, event_type, event_id, evidence_ref_id, details and result_error. A fact without its scope is invalid
        (missing_scope) to all rules but data quality; a fact of a type that no chosen rule takes has one row with the
        result_error unknown_fact_type. Matches carry an event id made from the fact, never an evaluator's own.
        """
        each, taken, text = [], set(), F.lit(None).cast("string")
        lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in SCOPE))

        def result(rule_id, version, status, reason, event_type, details, evidence, claims, error=text) -> Column:
            own = {c: claims.get(c, v) for c, v in (("rule_id", rule_id), ("rule_version", version), ("config", F.col("config")), ("event_time", F.col("event_time")), ("event_id", text))}
            named = {"rule_id": rule_id, "rule_version": version, "status": status, "reason": reason, "event_type": event_type, "details": details, "evidence": evidence, "error": error, "claims_event": F.lit("event_id" in claims)}
            return F.struct(*(v.alias(k) for k, v in (named | {f"own_{k}": v for k, v in own.items()}).items()))

        for rule_id, version, config in chosen:
            rule = self._rule(rule_id, version, config)
            if rule.result is None:
                raise ValueError(f"{rule_id} {version} is no rule of columns")
            taken.add(rule.fact_type)
            r, free = rule.result(config), rule.fact_type == "any"
            status = r.status if free else F.when(lacking, INVALID).otherwise(r.status)
            reason = r.reason if free else F.when(lacking, "missing_scope").otherwise(r.reason)
            details = F.map_from_arrays(F.array(*map(F.lit, r.details)), F.array(*(v.cast("string") for v in r.details.values()))) if r.details else F.lit(None).cast("map<string,string>")
            made = result(F.lit(rule_id), F.lit(version), status, reason, r.event_type, details, F.lit(rule.evidence == "required"), r.claims)
            each.append(made if free else F.when(F.col("fact_type") == rule.fact_type, made))
        if "any" not in taken:
            unknown = result(text, text, text, text, text, F.lit(None).cast("map<string,string>"), F.lit(False), {}, F.lit("unknown_fact_type"))
            each.append(F.when(~F.coalesce(F.col("fact_type").isin(sorted(taken)), F.lit(False)), unknown))
        fact = [F.col(c).alias(f"_f_{c}") for c in ("tenant", "venue", "session", "camera", "track", "context", "event_time", "config")]
        rows = facts.select(*keep, *fact, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_r"))
        # from here on once for each result: the event's id from the fact, and what the evaluator said against it
        of = lambda c: F.col(f"_r.{c}")
        matched = F.coalesce(of("status") == MATCH, F.lit(False))
        identity = [F.col(f"_f_{c}") for c in ("tenant", "venue", "session", "camera", "track", "context")]
        rows = rows.withColumn("_event", F.when(matched, ids.rule_event_id(*identity, of("rule_id"), of("rule_version"), of("event_type"), F.col("_f_event_time"), F.col("_f_config"))))
        claimed = F.when(of("claims_event"), of("own_event_id")).otherwise(F.col("_event"))
        error = (
            F.when(of("error").isNotNull(), of("error")).when((of("own_rule_id") != of("rule_id")) | (of("own_rule_version") != of("rule_version")), "foreign_rule").when(~of("own_config").eqNullSafe(F.col("_f_config")), "mixed_configuration")
            .when(~of("own_event_time").eqNullSafe(F.col("_f_event_time")), "event_time_changed").when(~F.coalesce(of("status").isin(MATCH, NO_MATCH, INVALID), F.lit(False)), "unknown_status").when(~matched & claimed.isNotNull(), "event_without_match")
            .when(matched & claimed.isNull(), "match_without_event").when(matched & (claimed != F.col("_event")), "event_id_differs").when((of("status") == INVALID) & (F.coalesce(of("reason"), F.lit("")) == ""), "invalid_without_reason")
        )
        rows = rows.withColumn("_error", error)
        event = F.when(F.col("_error").isNull(), F.col("_event"))
        evidence = F.when(of("evidence"), F.when(event.isNotNull(), ids.evidence_ref_id(event, F.col("_f_session"))))
        return rows.select(
            *keep, of("rule_id").alias("rule_id"), of("rule_version").alias("rule_version"), of("status").alias("status"), of("reason").alias("reason"), F.when(matched, of("event_type")).alias("event_type"), event.alias("event_id"),
            evidence.alias("evidence_ref_id"), of("details").alias("details"), F.col("_error").alias("result_error"),
        )


def default_registry() -> Registry:
    r = Registry()
    for rule in (
        Rule("occupancy_session", "v1", occupancy_session, "occupancy_snapshot", result=occupancy_result),
        Rule("dwell_threshold", "v1", dwell_threshold, "dwell_interval", ("dwell_threshold_seconds",), positive=("dwell_threshold_seconds",), result=dwell_result),
        Rule("queue_candidate", "v1", queue_candidate, "waiting_interval", ("waiting_qualification_seconds", "queue_area_ids"), result=queue_result),
        Rule("queue_candidate", "v2", queue_candidate_v2, "waiting_interval", ("waiting_qualification_seconds", "queue_area_ids", "queue_max_length"), result=queue_v2_result),
        Rule("service_gap_candidate", "v1", service_gap_candidate, "waiting_interval", ("service_gap_grace_seconds", "service_area_ids"), result=service_gap_result),
        Rule("turnover_delay", "v1", turnover_delay, "dwell_interval", ("turnover_delay_seconds", "service_window_seconds"), positive=("turnover_delay_seconds",), result=turnover_result),
        Rule("data_quality", "v1", lambda df, c: data_quality(df, c), "any", ("known_spatial_contexts",), result=lambda c: quality_result(c)),
    ):
        r.register(rule)
    return r


def first_match_per_interval(matches: DataFrame, interval: list[str]) -> DataFrame:
    """Of an interval's repeated matches the earliest."""
    best = matches.where(F.col("status") == MATCH).groupBy(*interval).agg(F.min(F.struct("event_time", "event_id")).alias("_first"))
    return matches.join(best, interval).where(F.struct("event_time", "event_id") == F.col("_first")).drop("_first")


#: Data-quality checks: code -> (severity, condition over the columns of a fact).
def quality_checks(known_contexts: list[str]) -> dict[str, tuple[str, Column]]:
    c = F.col
    return {
        "DATA_MISSING_IDENTITY": ("error", c("camera").isNull() | c("track").isNull()),
        "DATA_INVALID_EVENT_TIME": ("error", c("event_time").isNull() & c("last_seen").isNull()),
        "DATA_NON_MONOTONIC_TIME": ("error", (c("interval_end") < c("interval_start")) | (c("last_seen") < c("interval_start")) | (c("event_time") < c("previous_event_time"))),
        "DATA_NEGATIVE_DURATION": ("error", (c("duration_seconds") < 0) | (c("time_delta_seconds") < 0)),
        "DATA_INCONSISTENT": ("error", (c("qualified") & (c("duration_seconds") < c("minimum_seconds"))) | (c("previous_count") + c("delta") != c("occupancy_count"))),
        "DATA_INVALID_PROVENANCE": ("warning", (F.trim(F.coalesce("fsm_version", F.lit(""))) == "") | (F.trim(F.coalesce("policy_revision", F.lit(""))) == "") | c("config").isNull()),
        "DATA_UNKNOWN_CONTEXT": ("warning", c("context").isNotNull() & (~c("context").isin(known_contexts) if known_contexts else F.lit(True))),
        "DATA_CONFIG_MISMATCH": ("critical", c("config") != c("evaluation_config")),
    }


_RANKS = {"critical": 0, "error": 1, "warning": 2}


def _findings(config: dict) -> tuple[Column, Column]:
    """The codes of a fact's findings, sorted, and the gravest (rank, code, severity)."""
    checks = quality_checks(list(config["known_spatial_contexts"]))
    each = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(_RANKS[sev]).alias("rank"), F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, (sev, cond) in checks.items()))
    found = F.filter(each, lambda x: x.isNotNull())
    return F.array_sort(F.transform(found, lambda x: x["code"])), F.array_min(found)


def quality_result(config: dict) -> Result:
    codes, headline = _findings(config)
    matched = F.size(codes) > 0
    return Result(F.when(matched, MATCH).otherwise(NO_MATCH), F.lit(None).cast("string"), F.when(matched, "data_quality"), {"findings": F.array_join(codes, ","), "headline": headline["code"], "severity": headline["severity"]})


def data_quality(facts: DataFrame, config: dict) -> DataFrame:
    """All findings of each fact, sorted by code, the gravest first as headline; a fact with a finding matches."""
    codes, headline = _findings(config)
    out = facts.withColumn("findings", codes).withColumn("headline", headline)
    out = out.withColumn("severity", F.col("headline.severity")).withColumn("headline", F.col("headline.code"))
    return out.withColumn("reason", F.lit(None).cast("string")).withColumn("status", F.when(F.size("findings") > 0, MATCH).otherwise(NO_MATCH)).withColumn("event_type", F.when(F.size("findings") > 0, "data_quality"))


def result_errors(results: DataFrame, rule_id: str, rule_version: str) -> DataFrame:
    """Results with result_error, the first of what they must not be: another rule's, of another configuration or time than their fact (config, event_time against fact_config, fact_event_time), an event without a match, a match without an event, or invalid without a reason."""
    c = F.col
    error = (
        F.when((c("rule_id") != rule_id) | (c("rule_version") != rule_version), "foreign_rule").when(~c("config").eqNullSafe(c("fact_config")), "mixed_configuration")
        .when(~c("event_time").eqNullSafe(c("fact_event_time")), "event_time_changed").when((c("status") != MATCH) & c("event_id").isNotNull(), "event_without_match")
        .when((c("status") == MATCH) & c("event_id").isNull(), "match_without_event").when((c("status") == INVALID) & (F.coalesce(c("reason"), F.lit("")) == ""), "invalid_without_reason")
    )
    return results.withColumn("result_error", error)


def scope_errors(facts: DataFrame, by: list[str], scope: tuple[str, ...] = ("tenant", "venue", "session", "camera", "config")) -> DataFrame:
    """Evaluations (by) whose facts are of more than one scope, with the number of scopes."""
    return facts.groupBy(*by).agg(F.count_distinct(F.struct(*scope)).alias("scopes")).where("scopes > 1")


def with_evidence(results: DataFrame, requirement: str) -> DataFrame:
    """Results with evidence_ref_id: required makes one for each match that brings none, optional passes on what the evaluator gave, none forbids it (evidence_error)."""
    own = F.col("evidence_ref_id") if "evidence_ref_id" in results.columns else F.lit(None).cast("string")
    match = F.col("status") == MATCH
    made = F.when(match, F.coalesce(own, ids.evidence_ref_id(F.col("event_id"), F.col("session")))) if requirement == "required" else F.when(match, own) if requirement == "optional" else F.lit(None).cast("string")
    error = F.when(match & own.isNotNull(), "evidence_forbidden") if requirement == "none" else F.lit(None).cast("string")
    return results.withColumns({"evidence_ref_id": made, "evidence_error": error})


def evidence_requests(events: DataFrame, policy: str = "required") -> DataFrame:
    """A request for each match from the first non-null start of its episode (else its time) to its time: for all by policy required, for those that bring an evidence_ref_id by optional, for none otherwise."""
    ok = with_evidence(events.where(F.col("status") == MATCH), policy).where("evidence_ref_id is not null")
    return ok.select("event_id", F.col("evidence_ref_id").alias("ref_id"), F.coalesce("interval_start", "event_time").alias("start_time"), F.col("event_time").alias("end_time"))


def valid_definitions(definitions: DataFrame) -> DataFrame:
    """Rule definitions with valid: version grammar, names, fact types, and a positive cooldown where one is enabled."""
    ok = is_rule_version(F.col("rule_version")) & (F.length("rule_name") > 0) & (F.size("input_fact_types") > 0) & (~F.col("cooldown_enabled") | (F.col("cooldown_seconds") > 0))
    return definitions.withColumn("valid", F.coalesce(ok, F.lit(False)))
