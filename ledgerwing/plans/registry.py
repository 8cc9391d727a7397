"""A small registry: a query's function and its SQL side by side."""

from __future__ import annotations


def registry():
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query, queries, oracle
