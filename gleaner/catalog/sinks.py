"""Registered queries over sinks and whole jobs: what is written to the shared folder is read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog.base import Query, fixture, oracle
from gleaner.catalog.dedups import TAGGED
from gleaner.catalog.duck import features
from gleaner.catalog.files import HASHED
from gleaner.catalog.findings import _CATEGORIZED, _HEADER, _TIDY, RUN_SUMMARY, UNIQUE
from gleaner.catalog.statements import FEATURES, SPLIT, featured, line_runs
from gleaner.catalog.web import _FOUND, GRAPH, _recursive, _seeds, _target_path
from gleaner.operators import files as FD
from gleaner.operators import findings as A
from gleaner.plans.jobs import consolidate, plan_downloads
from gleaner.session import durable, shared_folder
from gleaner.sinks import reports as SK

_DUPLICATES = """SELECT hash, name, path, size FROM (SELECT *, count(*) OVER (PARTITION BY name, size, hash) AS n
  FROM hashed) WHERE n > 1"""


def _csv(spark: SparkSession, d: str) -> DataFrame:
    rows = FD.duplicate_rows(fixture(spark, d, "named"))
    path = shared_folder(spark, "csv")
    SK.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def _json(spark: SparkSession, d: str) -> DataFrame:
    rows = FD.duplicate_rows(fixture(spark, d, "named"))
    path = shared_folder(spark, "json")
    SK.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    """Four reports in four formats, one switched off; rows counted after reading them back."""
    rows = durable(featured(spark, d))
    frames = {
        "types": A.type_distribution(rows),
        "risks": A.risk_summary(rows),
        "tables": A.top_tables(rows),
        "findings": A.findings(rows),
        "statements": rows,
    }
    formats = {"types": "csv", "risks": "json", "tables": "parquet", "findings": "text", "statements": ""}
    written = SK.write_reports(frames, shared_folder(spark, "bundle"), "run", formats)
    readers = {
        "types": lambda p: spark.read.schema("query_type string, n long").option("header", True).csv(p),
        "risks": lambda p: spark.read.schema("risk_level string, n long").json(p),
        "tables": spark.read.parquet,
        "findings": spark.read.text,
    }
    counts = [
        readers[name](path).agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"))
        for name, path in written.items()
    ]
    out = counts[0]
    for frame in counts[1:]:
        out = out.unionByName(frame)
    return out


def _script(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "script")
    rows = durable(featured(spark, d))
    facts = spark.createDataFrame([("Files Scanned", "7"), ("High Risk", "1")], "metric string, value string")
    frame = SK.document_frame(facts, A.type_distribution(rows), "2024-01-02 03:04:05", "in")
    SK.write_consolidated(A.consolidated(rows), path, frame=frame)
    return spark.read.schema("value string, section_no int").text(path).groupBy("section_no", "value").agg(F.count(F.lit(1)).alias("n"))


def _consolidate(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(fixture(spark, d, "f2"), only={"run_summary"})["run_summary"]


# The whole job in SQL: split or scan every text, keep valid statements, three tiers, summary.
_EXTRACTED = """SELECT row_number() OVER (ORDER BY source_file, ordinal) AS stmt_id, * FROM (
  SELECT source_file, ordinal, raw_sql, line_start FROM kept UNION ALL
  SELECT source_file, ordinal, raw_sql, line_start FROM runs)"""
CORPUS = {
    **SPLIT,
    "rest": "SELECT * FROM f2 WHERE source_file NOT IN (SELECT source_file FROM kept)",
    **line_runs("rest"),
    "extracted": _EXTRACTED,
    **{name: body for name, body in TAGGED.items() if name != "f1"},
    "s": features("extracted"),
    "u": UNIQUE,
}

QUERIES = [
    Query("sk1_csv", _csv, oracle(_DUPLICATES, **HASHED)),
    Query("sk2_json", _json, oracle(_DUPLICATES, **HASHED)),
    Query(
        "sk4_report_bundle",
        _bundle,
        oracle(
            """SELECT 'types' AS report, count(DISTINCT query_type) AS n_rows FROM s
              UNION ALL SELECT 'risks', count(DISTINCT risk_level) FROM s
              UNION ALL SELECT 'tables', least(20, count(DISTINCT lower(t))) FROM (SELECT unnest(table_names) AS t FROM s)
              UNION ALL SELECT 'findings', (count(*) FILTER (risk_level = 'CRITICAL') > 0)::BIGINT
                + (count(*) FILTER (risk_level = 'HIGH') > 0)::BIGINT + (count(*) FILTER (complexity_score > 20) > 0)::BIGINT
                + (count(*) FILTER (query_type IN ('UPDATE', 'DELETE') AND NOT has_where) > 0)::BIGINT + 1
                + (count(*) FILTER (query_type IN ('CREATE', 'ALTER', 'DROP')) > 0)::BIGINT FROM s""",
            **FEATURES,
        ),
    ),
    Query(
        "sk6_consolidated_text",
        _script,
        oracle(
            """SELECT section_no, value, count(*) AS n FROM (
                SELECT section_no, unnest(string_split(text, chr(10))) AS value FROM texts
                UNION ALL SELECT section_no, value FROM fixed
                UNION ALL SELECT 0, format('    {:<30} : {}', query_type, count(*)) FROM s GROUP BY query_type) GROUP BY ALL""",
            **FEATURES,
            k=_CATEGORIZED,
            texts=f"""SELECT section_no, CASE WHEN row_number() OVER (PARTITION BY section_no ORDER BY source_file, ordinal) = 1
              THEN concat_ws(chr(10), '', '/' || repeat('=', 79), '||  ' || rpad(upper(category), 74, ' ') || ' ||',
                '||  Total: ' || rpad((count(*) OVER (PARTITION BY section_no))::VARCHAR, 70, ' ') || ' ||', repeat('=', 79) || '/')
              ELSE 'GO' END || chr(10) || chr(10) || repeat('-', 80) || chr(10) || {_HEADER} || chr(10) || repeat('-', 80)
                || chr(10) || {_TIDY} || chr(10) AS text FROM k""",
            fixed="""SELECT 0 AS section_no, unnest(['/*', repeat('=', 76), '  SQL QUERY CONSOLIDATION MASTER DOCUMENT', repeat('=', 76), '',
                '  Generated On      : 2024-01-02 03:04:05', '  Input Directory   : in', '  Files Scanned     : 7', '',
                '  QUERY DISTRIBUTION:', '', repeat('=', 76), '*/', '']) AS value
              UNION ALL SELECT 99, unnest(['', '/*', repeat('=', 76), '  END OF MASTER SQL DOCUMENT', '  Generated: 2024-01-02 03:04:05',
                repeat('=', 76), '*/'])""",
        ),
    ),
    Query("job_consolidate", _consolidate, _recursive(RUN_SUMMARY, **CORPUS)),
    Query(
        "job_plan_downloads",
        lambda s, d: plan_downloads(fixture(s, d, "sites"), _seeds(s, d)),
        _recursive(
            f"""SELECT {_target_path('target', 'tree')} AS target_path, min(target) AS url, count(*) - 1 AS n_collisions
              FROM found GROUP BY 1""",
            **GRAPH,
            found=_FOUND,
        ),
    ),
]
