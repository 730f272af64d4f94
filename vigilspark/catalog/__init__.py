"""Registered queries of the event engine and their DuckDB SQL."""

from __future__ import annotations

from vigilspark.catalog import common


def _load() -> None:
    from vigilspark.catalog import evidence, geometry, identity, more, queues, reads, rules, streams, temporal, tracking, worker  # noqa: F401


def queries() -> dict:
    _load()
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(common.ORACLES)


def flagship(spark, sf_dir: str):
    """Occupancy sessions: presence of users, occupancy of their scopes, and where it starts and ends."""
    return queries()["rule_occupancy_session"](spark, sf_dir)
