"""How queries and their SQL are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Query = Callable[..., DataFrame]


class Plans:
    """Queries by name, each with the SQL that gives the same rows (if any)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(run: Query) -> Query:
            self.queries[run.__name__] = run
            if sql:
                self.sql[run.__name__] = sql
            return run

        return add
