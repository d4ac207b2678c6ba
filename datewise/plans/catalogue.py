"""All registered queries of the rule engine."""

from __future__ import annotations

from . import core, domains, reads, routes, state  # noqa: F401  the others register with core


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict:
    return dict(core.SQL)
