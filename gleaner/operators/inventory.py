"""Inventory records out of semi-structured text, and enrichment by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import all_values, join_desc, labelled_value, trim_ws

# Fixed value: version in a registry line of an installed product.
VERSION_PATTERN = r"ORACLE_HOME\s+REG_SZ\s+.*?product\\([\d\.]+)\\"


def inventory(files: DataFrame, numeric_versions: bool = False) -> DataFrame:
    """Hostname, address, presence flag and version list of every text; other columns are kept."""
    content = F.col("content")
    found = (
        files.withColumn("hostname", labelled_value(content, "Hostname"))
        .withColumn("ip_address", labelled_value(content, "IP Address"))
        .withColumn("versions", all_values(content, VERSION_PATTERN))
        .drop("content")
    )
    return found.withColumn("present", F.when(F.size("versions") > 0, "Yes").otherwise("No")).withColumn(
        "version_list", join_desc(F.col("versions"), ":", numeric_versions)
    )


def grouped_inventory(files: DataFrame) -> DataFrame:
    """Inventory with the collection as sheet, ready for ``write.partitionBy``; labels are never cut."""
    return inventory(files).withColumn("sheet", F.col("collection"))


def missing_audit(records: DataFrame) -> DataFrame:
    """How many records per collection lack the host, the address or any version."""
    return records.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col("hostname") == "").alias("no_hostname"),
        F.count_if(F.col("ip_address") == "").alias("no_ip_address"),
        F.count_if(F.size("versions") == 0).alias("no_versions"),
    )


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """All sheets as one frame; a column one sheet lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def last_per_key(lookup: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every non-blank key."""
    trimmed = lookup.withColumn(key, trim_ws(F.col(key).cast("string"))).filter(F.col(key) != "")
    values = [c for c in lookup.columns if c != key]
    latest = trimmed.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row"))
    return latest.select(key, "row.*")


def enrich(
    base: DataFrame, lookup: DataFrame, key: str, order: list[str], lookup_key: str | None = None, prefix: str = "E2_"
) -> DataFrame:
    """Left join of the last lookup row per key; lookup columns come sorted, prefixed, with "" for no match.

    The lookup side is unique per key. Which join runs is left to the optimizer's size statistics; a hot key on the base
    side is split by adaptive skew handling.
    """
    lookup_key = lookup_key or key
    latest = last_per_key(lookup, lookup_key, order)
    extra = sorted(c for c in latest.columns if c not in (lookup_key, *order))
    right = latest.select(F.col(lookup_key).alias("_key"), *[F.col(c).cast("string").alias(prefix + c) for c in extra])
    joined = base.withColumn("_key", trim_ws(F.col(key).cast("string"))).join(right, "_key", "left").drop("_key")
    return joined.select(*base.columns, *[F.coalesce(prefix + c, F.lit("")).alias(prefix + c) for c in extra])
