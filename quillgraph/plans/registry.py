"""The named queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that DuckDB answers it by."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add

from quillgraph.plans import citations, graphs, matching, more, reading, relational, streams  # noqa: E402, F401  (they register their queries)
