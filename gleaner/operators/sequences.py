"""Labels by value band, first occurrences, sequence validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Closed ranges of three channels per label, in declaration order, and the expected sequence.
BANDS = {
    "red": ((0, 100, 100), (10, 255, 255)),
    "green": ((35, 100, 100), (85, 255, 255)),
    "blue": ((100, 100, 100), (130, 255, 255)),
}
EXPECTED = ["red", "green", "blue"]

Bands = dict[str, tuple[tuple[int, int, int], tuple[int, int, int]]]


def label_bands(frames: DataFrame, bands: Bands | None = None) -> DataFrame:
    """(key, ts, label_order, label) for every label that any element of a frame falls into.

    The bands are constants, so a row is tested against them in place and no range join is needed.
    """
    hits = [
        F.when(
            F.col("h").between(low[0], high[0])
            & F.col("s").between(low[1], high[1])
            & F.col("v").between(low[2], high[2]),
            F.struct(F.lit(i).alias("label_order"), F.lit(label).alias("label")),
        )
        for i, (label, (low, high)) in enumerate((bands or BANDS).items())
    ]
    return frames.select("key", "ts", F.inline(F.array_compact(F.array(*hits)))).distinct()


def first_occurrences(labels: DataFrame) -> DataFrame:
    """Labels of each key by first time; ties follow ``label_order``. One element per label of the alphabet."""
    first = labels.groupBy("key", "label_order", "label").agg(F.min("ts").alias("first_ts"))
    return first.groupBy("key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_ts", "label_order", "label"))), lambda s: s["label"]
        ).alias("detected")
    )


def validate_sequence(labels: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """detected == expected per key."""
    wanted = F.array(*[F.lit(x) for x in (expected or EXPECTED)])
    return first_occurrences(labels).withColumn("valid", F.col("detected") == wanted)
