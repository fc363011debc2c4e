"""A module's registry of queries."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query
