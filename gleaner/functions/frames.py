"""Helpers over whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, in generated code, and then leave a one-element generator: the
    optimizer neither pushes filters through it nor copies expressions, so a later filter or score does not run the
    regexes again."""
    staged = df.withColumns({f"_pin_{name}": column for name, column in columns.items()})
    row = F.struct(*[F.col(f"_pin_{name}").alias(name) for name in columns])
    return staged.select(*df.columns, F.inline(F.array(row)))
