"""Every query of the library outside the optional subpackages, with its SQL."""

from __future__ import annotations

from .queries import contexts, measures, scans

_ALL = {**scans.QUERIES, **measures.QUERIES, **contexts.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
