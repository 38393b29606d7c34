"""A book of queries: each is registered with the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, dates: str = ""):
        """dates: columns given as ISO text on both sides, as engines differ in what they make of a date."""
        columns = dates.split()

        def keep(f: Callable) -> Callable:
            self.queries[name] = f if not columns else lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in columns})
            if sql:
                self.sql[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
            return f

        return keep


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Compared figures are rounded: sums of doubles depend on the order of rows in their last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
