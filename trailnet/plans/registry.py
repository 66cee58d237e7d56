"""Queries over the driver tables, by name, and the SQL that states the same result."""

from __future__ import annotations

from . import bridging, identities, joins, motion, profiles, records, routes, stateful

_MODULES = (motion, joins, routes, stateful, records, profiles, bridging, identities)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
