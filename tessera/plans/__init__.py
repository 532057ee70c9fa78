"""Queries over the driver's tables and the SQL that checks them."""

from tessera.plans import changes, code, index, metrics, pages, project, rules

_MODULES = (metrics, index, rules, pages, changes, project, code)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
