"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is one that SQL can't express, which tests hold against brute force."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import evaluation, profiling, structure, validation, vectors  # noqa: E402, F401
