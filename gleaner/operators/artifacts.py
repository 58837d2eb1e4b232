"""Named code blocks in transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import trim_ws

# A "File:" line followed by a fenced block, and the variant with an optional prefix.
NAMED_BLOCK = r"(?s)File:\s*(.*?)\n```.*?\n(.*?)```"
LOOSE_BLOCK = r"(?s)(?:File:|###)?[ \t]*([\w/\\.\-]+)\s*```\w*\n(.*?)```"
DEFAULT_PROJECT = "generated_project"


def code_blocks(transcripts: DataFrame, prefix_optional: bool = False) -> DataFrame:
    """(project, turn, ordinal, path, content) of every block, in order."""
    pattern = F.lit(LOOSE_BLOCK if prefix_optional else NAMED_BLOCK)
    hits = transcripts.select(
        "project",
        "turn",
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("text", pattern, F.lit(1)).alias("path"),
                F.regexp_extract_all("text", pattern, F.lit(2)).alias("content"),
            )
        ).alias("ordinal", "hit"),
    )
    return hits.select(
        "project",
        "turn",
        "ordinal",
        trim_ws(F.col("hit.path")).alias("path"),
        trim_ws(F.col("hit.content")).alias("content"),
    ).filter(F.col("path") != "")


def latest_artifacts(blocks: DataFrame) -> DataFrame:
    """The last block of every path in a project."""
    return blocks.groupBy("project", "path").agg(
        F.max_by("content", F.struct("turn", "ordinal")).alias("content"), F.count(F.lit(1)).alias("n_versions")
    )


def with_unsafe_flag(artifacts: DataFrame) -> DataFrame:
    """Absolute paths and paths with a parent segment are flagged; nothing is ever written to them."""
    return artifacts.withColumn("unsafe_path", F.col("path").rlike(r"^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)"))


def project_manifest(artifacts: DataFrame, root: str = "generated_projects") -> DataFrame:
    """Files, bytes, unsafe paths and root folder per project."""
    named = F.coalesce(F.col("project").cast("string"), F.lit(DEFAULT_PROJECT))
    return (
        with_unsafe_flag(artifacts)
        .groupBy(named.alias("project_name"))
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum(F.octet_length("content")).alias("n_bytes"),
            F.count_if("unsafe_path").alias("n_unsafe"),
        )
        .withColumn("status", F.lit("success"))
        .withColumn("project_path", F.concat(F.lit(root + "/"), "project_name"))
    )
