"""Differences of two listings, and ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import glob_to_regex

# Default ignore rules.
IGNORE_PATTERNS = ["__pycache__/", "*.pyc", "venv/", ".env", "node_modules/", "dist/", "build/"]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified or unchanged for every path of two (path, hash) listings."""
    before = old.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("in_old"))
    after = new.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("in_new"))
    return before.join(after, "path", "full_outer").select(
        "path",
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("modified")
        .alias("status"),
    )


def dirty(diff: DataFrame) -> DataFrame:
    """One row: has anything changed, and how much."""
    changed = F.count_if(F.col("status") != "unchanged")
    return diff.agg((changed > 0).alias("dirty"), changed.alias("n_changed"))


def filter_ignored(files: DataFrame, patterns: list[str] | None = None, path: str = "path") -> DataFrame:
    rules = "|".join(glob_to_regex(p) for p in (patterns or IGNORE_PATTERNS))
    return files.filter(~F.col(path).rlike(rules))
