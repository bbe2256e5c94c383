"""Where the query modules register: name -> (Spark callable, SQL for the same rows)."""

from __future__ import annotations

from photocat.plans import views

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a query. ``sql`` follows a WITH list holding the views named in ``uses``; it is a
    SELECT, or starts with a comma and more WITH entries."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = views.oracle(uses.split(), sql)
        return fn

    return add
