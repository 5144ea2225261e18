"""Queries over the test tables, each with its SQL counterpart."""

from . import audit, duplicates, sections, sheets, streams

_MODULES = (audit, sheets, sections, duplicates, streams)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
