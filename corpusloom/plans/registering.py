"""A module's queries, each beside its SQL."""

from __future__ import annotations


class Registered:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Registers a query under its function's name."""

        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
