"""A catalogue of queries and of the DuckDB SQL that they must equal."""

from __future__ import annotations


class Catalogue:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, sql: str | None = None):
        """Register a function as a query under its name, with the SQL that it must equal."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
