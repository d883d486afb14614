"""How a module registers its queries."""

from __future__ import annotations


def registry():
    """A dictionary of queries, one of their SQL, and a decorator that adds to both."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        """Registers a function under its name, with its SQL."""

        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
