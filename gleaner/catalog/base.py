"""What a registered query is, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog.fixtures import FIXTURES
from gleaner.functions.frames import pinned
from gleaner.session import spread

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input: one SELECT over the given tables that reads the same in Spark and in the oracle."""
    spec = FIXTURES[name]
    for source in spec.tables:
        spread(table(spark, sf_dir, source)).createOrReplaceTempView(source)
    df = spark.sql(spec.spark_sql)
    if not spec.text:
        return df
    built = df.withColumnRenamed(spec.text, "_text")
    return pinned(built, {spec.text: F.col("_text")}).drop("_text")


def oracle(select: str, **ctes: str) -> str:
    """``select`` with the named CTEs in front; a value that names a fixture stands for its SELECT."""
    parts = []
    for name, body in ctes.items():
        parts.append(f"{name} AS ({FIXTURES[body].sql if body in FIXTURES else body})")
    return f"WITH {', '.join(parts)} {select}" if parts else select
