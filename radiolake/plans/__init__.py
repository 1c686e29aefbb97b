"""Registered queries of the core, each with its SQL where SQL can express it."""

from . import annotations, data_quality, evaluation, files, operations

_MODULES = (annotations, evaluation, operations, files, data_quality)
CORE_QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
CORE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
