"""Registered queries of the change-point engine, each with SQL for the comparison where SQL can say it."""

from __future__ import annotations

from . import costs, detectors, evaluation, profile, streams

_PARTS = (costs, detectors, evaluation, profile, streams)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, (fn, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
