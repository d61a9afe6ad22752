"""Table functions for SQL: called laterally, or over partitions of a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from textmill.config import DEFAULT
from textmill.operators.split import _sections
from textmill.shipping import ensure_importable


@udtf(returnType="section int, level int, heading string, text string")
class Sections:
    """Sections of a text by headings and length: ``sections(text, size)``."""

    def eval(self, text: str, size: int = DEFAULT.section_chars) -> Iterator[tuple]:
        """A row per section."""
        for i, (level, heading, body) in enumerate(_sections(text or "", size)):
            yield i, level, heading, body


@udtf(returnType="key long, seq long, cost double, admitted boolean, used double")
class BudgetGuard:
    """Calls admitted while they fit into a budget: ``budget_guard(TABLE(calls) PARTITION BY key ORDER BY seq, limit)``. The state is one running total."""

    def __init__(self) -> None:
        self.used = 0.0

    def eval(self, row: Row, limit: float) -> Iterator[tuple]:
        """The row with the verdict; a refused call adds nothing."""
        ok = self.used + row["cost"] <= limit
        if ok:
            self.used = round(self.used + row["cost"], 6)
        yield row["key"], row["seq"], row["cost"], ok, self.used


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL as ``sections`` and ``budget_guard``."""
    ensure_importable(spark)
    spark.udtf.register("sections", Sections)
    spark.udtf.register("budget_guard", BudgetGuard)
