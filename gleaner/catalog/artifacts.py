"""Registered queries over named code blocks in transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle
from gleaner.operators import artifacts as CX

_NAMED = r"'(?s)File:\s*(.*?)\n```.*?\n(.*?)```'"
_LOOSE = r"'(?s)(?:File:|###)?[ \t]*([\w/\\.\-]+)\s*```\w*\n(.*?)```'"


def _blocks(pattern: str) -> str:
    return f"""SELECT project, turn, ordinal, {D.trim_ws('path')} AS path, {D.trim_ws('content')} AS content FROM (
      SELECT project, turn, (generate_subscripts(regexp_extract_all(text, {pattern}, 1), 1) - 1)::INT AS ordinal,
        unnest(regexp_extract_all(text, {pattern}, 1)) AS path, unnest(regexp_extract_all(text, {pattern}, 2)) AS content
      FROM f6)"""


_LATEST = """SELECT project, path, arg_max(content, turn * 1000000 + ordinal) AS content, count(*) AS n_versions
  FROM blocks GROUP BY ALL"""
CTES = {"f6": "f6", "blocks": _blocks(_NAMED), "latest": _LATEST}


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return CX.code_blocks(fixture(spark, d, "f6"))


QUERIES = [
    Query("cx1_code_blocks", blocks, oracle("SELECT * FROM blocks", **CTES)),
    Query(
        "cx2_loose_blocks",
        lambda s, d: CX.code_blocks(fixture(s, d, "f6"), prefix_optional=True),
        oracle("SELECT * FROM loose", f6="f6", loose=_blocks(_LOOSE)),
    ),
    Query(
        "cx3_latest_artifacts",
        lambda s, d: CX.latest_artifacts(blocks(s, d)),
        oracle("SELECT * FROM latest", **CTES),
    ),
    Query(
        "cx4_project_manifest",
        lambda s, d: CX.project_manifest(CX.latest_artifacts(blocks(s, d))),
        oracle(
            r"""SELECT project::VARCHAR AS project_name, count(*) AS n_files, sum(strlen(content))::BIGINT AS n_bytes,
              count(*) FILTER (regexp_matches(path, '^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)')) AS n_unsafe,
              'success' AS status, 'generated_projects/' || project::VARCHAR AS project_path FROM latest GROUP BY project""",
            **CTES,
        ),
    ),
]
