"""Comparing files across collections: common names, presence, pair status, line changes, hunks.

The list of collections is an argument of the comparison, so the number of pairs per name is bounded by that list and
not by the data. Pairs are laid out from one aggregated row per name; no table is joined with itself.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_LINES = 3


def common_names(files: DataFrame, min_collections: int = 2) -> DataFrame:
    """Names that occur in at least so many collections."""
    return (
        files.groupBy("name")
        .agg(F.count_distinct("collection").alias("n_collections"))
        .filter(F.col("n_collections") >= min_collections)
    )


def _by_collection(files: DataFrame, collections: list[str]) -> DataFrame:
    """One row per name with the content hash in each collection."""
    return files.groupBy("name").agg(
        *[F.max(F.when(F.col("collection") == c, F.col("hash"))).alias(f"h{i}") for i, c in enumerate(collections)]
    )


def presence(files: DataFrame, collections: list[str]) -> DataFrame:
    """Presence matrix: one flag per collection and the number of collections that have the name."""
    rows = _by_collection(files, collections)
    flags = [F.col(f"h{i}").isNotNull() for i in range(len(collections))]
    held = flags[0].cast("int")
    for flag in flags[1:]:
        held = held + flag.cast("int")
    return rows.select(
        "name", *[flag.alias(c) for flag, c in zip(flags, collections, strict=True)], held.alias("n_collections")
    )


def _pairs(collections: list[str], hashes: list[Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(collections[i]).alias("left_collection"),
                F.lit(collections[j]).alias("right_collection"),
                hashes[i].alias("left_hash"),
                hashes[j].alias("right_hash"),
            )
            for i, j in combinations(range(len(collections)), 2)
        ]
    )


def collection_pairs(files: DataFrame, collections: list[str]) -> DataFrame:
    """Every unordered collection pair for each name that occurs in two or more of them."""
    hashes = [F.col(f"h{i}") for i in range(len(collections))]
    rows = _by_collection(files, collections)
    held = F.size(F.array_compact(F.array(*hashes)))
    return rows.filter(held >= 2).select("name", F.inline(_pairs(collections, hashes)))


def path_pairs(files: DataFrame, paths: list[str]) -> DataFrame:
    """Every unordered pair of a fixed list of paths; a path without a file has a NULL hash."""
    row = files.filter(F.col("path").isin(paths)).agg(
        *[F.max(F.when(F.col("path") == p, F.col("hash"))).alias(f"h{i}") for i, p in enumerate(paths)]
    )
    return row.select(F.inline(_pairs(paths, [F.col(f"h{i}") for i in range(len(paths))])))


def pair_status(pairs: DataFrame) -> DataFrame:
    """same, different or missing, from the hashes alone."""
    left, right = F.col("left_hash"), F.col("right_hash")
    return pairs.withColumn(
        "status",
        F.when(left.isNull() | right.isNull(), "missing").when(left == right, "same").otherwise("different"),
    )


def line_changes(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines added and removed between the two sides of every different pair, as multisets."""
    different = pair_status(pairs).filter("status = 'different'")
    sides = different.select(
        "name",
        "left_collection",
        "right_collection",
        F.inline(
            F.array(
                F.struct(F.col("left_collection").alias("collection"), F.lit(-1).alias("sign")),
                F.struct(F.col("right_collection").alias("collection"), F.lit(1).alias("sign")),
            )
        ),
    )
    lines = sides.join(files.select("name", "collection", "content"), ["name", "collection"]).select(
        "name", "left_collection", "right_collection", "sign", F.explode(F.split("content", "\n")).alias("line")
    )
    pair = ["name", "left_collection", "right_collection"]
    net = lines.groupBy(*pair, "line").agg(F.sum("sign").alias("net"))
    return net.groupBy(*pair).agg(
        F.sum(F.greatest(F.col("net"), F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("removed"),
    )


def _diff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hunks = [
            "\n".join(
                difflib.unified_diff(
                    left.split("\n"), right.split("\n"), fromfile=a, tofile=b, n=CONTEXT_LINES, lineterm=""
                )
            )
            for left, right, a, b in zip(
                pdf["left_content"], pdf["right_content"], pdf["left_path"], pdf["right_path"], strict=True
            )
        ]
        yield pdf[["name", "left_collection", "right_collection"]].assign(diff=hunks)


def diff_hunks(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unified diff with three lines of context for every different pair; one Arrow batch at a time."""
    content = files.select("name", "collection", "content")
    left = content.select("name", F.col("collection").alias("left_collection"), F.col("content").alias("left_content"))
    right = content.select(
        "name", F.col("collection").alias("right_collection"), F.col("content").alias("right_content")
    )
    joined = (
        pair_status(pairs)
        .filter("status = 'different'")
        .select("name", "left_collection", "right_collection")
        .join(left, ["name", "left_collection"])
        .join(right, ["name", "right_collection"])
        .withColumn("left_path", F.concat_ws("/", "left_collection", "name"))
        .withColumn("right_path", F.concat_ws("/", "right_collection", "name"))
    )
    return joined.mapInPandas(
        _diff_batches, "name string, left_collection string, right_collection string, diff string"
    )
