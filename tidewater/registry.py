"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from tidewater.plans import changes, forecasts, models, relational, scalars, types

_PLANS = [relational.PLANS, changes.PLANS, scalars.PLANS, types.PLANS, forecasts.PLANS, models.PLANS]

QUERIES = {name: run for p in _PLANS for name, run in p.queries.items()}
ORACLE_SQL = {name: sql for p in _PLANS for name, sql in p.sql.items()}
