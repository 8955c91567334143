"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import casework, core, details, intake, layouts, matching, readers, risk, signals, story, upkeep

_PLANS = (core, risk, story, intake, readers, casework, layouts, matching, upkeep, details, signals)
QUERIES: dict = {name: run for plans in _PLANS for name, run in plans.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plans in _PLANS for name, sql in plans.ORACLE_SQL.items()}
