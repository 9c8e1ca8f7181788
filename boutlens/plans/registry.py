"""Where queries and their SQL counterparts are kept."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name; without SQL it is tested otherwise."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep
