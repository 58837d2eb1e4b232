"""Registered queries over statement reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog.base import Query, fixture, oracle
from gleaner.catalog.dedups import TAGGED, _recursive, tagged
from gleaner.catalog.statements import FEATURES, featured
from gleaner.functions import sqltext as S
from gleaner.operators import dedup as DD
from gleaner.operators import findings as A
from gleaner.session import durable
from gleaner.sinks.reports import as_line
from gleaner.sources.files import scan_metrics

_SECTIONS = """CASE query_type WHEN 'CREATE' THEN 'DDL - CREATE' WHEN 'ALTER' THEN 'DDL - ALTER'
  WHEN 'DROP' THEN 'DDL - DROP' WHEN 'TRUNCATE' THEN 'DDL - TRUNCATE' WHEN 'VIEW' THEN 'VIEWS'
  WHEN 'FUNCTION' THEN 'FUNCTIONS' WHEN 'STORED_PROCEDURE' THEN 'STORED PROCEDURES' WHEN 'EXEC' THEN 'EXEC'
  WHEN 'TRIGGER' THEN 'TRIGGERS' WHEN 'INDEX' THEN 'INDEXES' WHEN 'SELECT' THEN 'SELECT Queries'
  WHEN 'WITH' THEN 'CTE Queries' WHEN 'INSERT' THEN 'INSERT Queries' WHEN 'UPDATE' THEN 'UPDATE Queries'
  WHEN 'DELETE' THEN 'DELETE Queries' WHEN 'MERGE' THEN 'MERGE Queries'
  WHEN 'TRANSACTION' THEN 'TRANSACTION BLOCKS' ELSE 'Uncategorized' END"""
_SECTION_LIST = ", ".join(f"'{s}'" for s in A.SECTION_ORDER)
_CATEGORIZED = f"""SELECT *, list_position([{_SECTION_LIST}], category)::INT AS section_no
  FROM (SELECT *, {_SECTIONS} AS category FROM s)"""
_TOP = """SELECT lower(t) AS table_name, count(*) AS n FROM (SELECT unnest(table_names) AS t FROM s)
  GROUP BY 1 ORDER BY n DESC, table_name LIMIT {k}"""
_PREVIEW = "replace(substring(raw_sql, 1, {n}), chr(10), ' ')"
_COUNTS = """SELECT count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
  count(*) FILTER (complexity_score > 20) AS complex,
  count(*) FILTER (query_type IN ('UPDATE', 'DELETE') AND NOT has_where) AS unfiltered,
  count(*) FILTER (query_type IN ('CREATE', 'ALTER', 'DROP')) AS ddl, count(*) AS total,
  avg(complexity_score) AS average FROM s"""
_RULES = f"""SELECT 1 AS rule_no, 'critical' AS rule, critical AS metric, printf('CRITICAL: %d DELETE/UPDATE queries found WITHOUT WHERE clause. Review immediately to prevent mass data loss.', critical) AS message FROM c
  UNION ALL SELECT 2, 'high', high, printf('HIGH RISK: %d DROP/TRUNCATE queries found. Ensure these are intentional and have backups.', high) FROM c
  UNION ALL SELECT 3, 'complex', complex, printf('%d highly complex queries detected (score > 20). Consider optimization review.', complex) FROM c
  UNION ALL SELECT 4, 'unfiltered', unfiltered, printf('%d UPDATE/DELETE queries lack WHERE clauses - potential full table modifications!', unfiltered) FROM c
  UNION ALL SELECT 5, 'top_table', n, printf('Most referenced table: ''%s'' appears in %d queries. Ensure proper indexing.', table_name, n) FROM ({_TOP.format(k=1)})
  UNION ALL SELECT 6, 'ddl', ddl, printf('%d DDL statements found. Ensure schema changes are version-controlled.', ddl) FROM c"""
RULES = {**FEATURES, "c": _COUNTS, "rules": _RULES, "found": "SELECT * FROM rules WHERE metric > 0"}
_SUMMARY = f"""SELECT 1 AS section_no, 1 AS line_no, 'NATURAL LANGUAGE SUMMARY' AS text
  UNION ALL SELECT 1, 2, repeat('=', 60)
  UNION ALL SELECT 1, 3, printf('This consolidated document contains %d unique SQL queries.', total) FROM c
  UNION ALL SELECT 1, 4, ''
  UNION ALL SELECT 2, 0, 'Query Breakdown:' FROM c WHERE total > 0 UNION ALL SELECT 2, 1000, '' FROM c WHERE total > 0
  UNION ALL SELECT 3, 0, 'Risk Profile:' UNION ALL SELECT 3, 1000, '' UNION ALL SELECT 4, 1000, ''
  UNION ALL SELECT 5, 0, 'Top Referenced Tables:' FROM ({_TOP.format(k=1)})
  UNION ALL SELECT 5, 1000, '' FROM ({_TOP.format(k=1)})
  UNION ALL SELECT DISTINCT 6, 0, 'Key Recommendations:' FROM found
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, query_type)::INT, printf('  * %d %s queries', n, query_type)
    FROM (SELECT query_type, count(*) AS n FROM s GROUP BY 1)
  UNION ALL SELECT 3, 1, printf('  * %d CRITICAL risk (DELETE/UPDATE without WHERE)', critical) FROM c
  UNION ALL SELECT 3, 2, printf('  * %d HIGH risk (DROP/TRUNCATE)', high) FROM c
  UNION ALL SELECT 3, 3, printf('  * %d MEDIUM risk (DML with WHERE)', medium) FROM c
  UNION ALL SELECT 3, 4, printf('  * %d LOW risk (SELECT/DDL)', low) FROM c
  UNION ALL SELECT 4, 1, printf('Average complexity score: %.1f', average) FROM c
  UNION ALL SELECT 5, row_number() OVER (ORDER BY n DESC, table_name)::INT,
    printf('  * %s: referenced %d times', table_name, n) FROM ({_TOP.format(k=5)})
  UNION ALL SELECT 6, rule_no, '  ' || message FROM found"""
_HEADER = """concat_ws(chr(10), '-- Source File : ' || source_file, '-- Query Type  : ' || query_type,
  '-- Line Number : ' || line_start || ' - ' || line_end, '-- Complexity  : ' || complexity_score,
  '-- Risk Level  : ' || risk_level, '-- Importance  : ' || importance_score,
  CASE WHEN len(table_names) > 0 THEN '-- Tables      : ' || array_to_string(table_names, ', ') END)"""
_BARE = r"regexp_replace(raw_sql, '\s+$', '')"
_TIDY = (
    f"regexp_replace(regexp_replace(CASE WHEN ends_with({_BARE}, ';') THEN {_BARE} ELSE {_BARE} || ';' END, "
    r"',(\S)', ', \1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)
RUN_SUMMARY = """SELECT 'Total Queries Found' AS metric, count(*)::VARCHAR AS value FROM tagged
  UNION ALL SELECT 'Unique Queries', count(*) FILTER (tier = 'UNIQUE')::VARCHAR FROM tagged
  UNION ALL SELECT 'Duplicates Removed', count(*) FILTER (tier <> 'UNIQUE')::VARCHAR FROM tagged
  UNION ALL SELECT 'Deduplication Rate',
    printf('%.1f', round(count(*) FILTER (tier <> 'UNIQUE') * 100.0::DOUBLE / greatest(count(*), 1), 1)) FROM tagged
  UNION ALL SELECT 'Avg Complexity', printf('%.1f', avg(complexity_score)) FROM u
  UNION ALL SELECT 'Critical Risk', count(*) FILTER (risk_level = 'CRITICAL')::VARCHAR FROM u
  UNION ALL SELECT 'High Risk', count(*) FILTER (risk_level = 'HIGH')::VARCHAR FROM u"""

UNIQUE = "SELECT s.* FROM s JOIN tagged t USING (stmt_id) WHERE t.tier = 'UNIQUE'"


def _run_summary(spark, d):
    rows = durable(tagged(spark, d))
    return A.run_summary(DD.dedup_stats(rows), rows.filter("tier = 'UNIQUE'"), scan_metrics(fixture(spark, d, "files")))


_LISTING = [
    "number", "query_type", "source_file", "folder", "line_start", "line_end", "tables", "has_joins", "has_subquery",
    "has_cte", "complexity_score", "importance_score", "risk_level", "preview",
]

QUERIES = [
    Query(
        "an1_type_distribution",
        lambda s, d: A.type_distribution(featured(s, d)),
        oracle("SELECT query_type, count(*) AS n FROM s GROUP BY 1", **FEATURES),
    ),
    Query(
        "an2_risk_summary",
        lambda s, d: A.risk_summary(featured(s, d)),
        oracle("SELECT risk_level, count(*) AS n FROM s GROUP BY 1", **FEATURES),
    ),
    Query(
        "an2_risk_pivot",
        lambda s, d: A.risk_pivot(featured(s, d)),
        oracle("SELECT critical, high, medium, low FROM c", **RULES),
    ),
    Query(
        "an3_high_risk",
        lambda s, d: A.high_risk(featured(s, d)).select("source_file", "ordinal", "risk_level", "query_type"),
        oracle(
            "SELECT source_file, ordinal, risk_level, query_type FROM s WHERE risk_level IN ('HIGH', 'CRITICAL')",
            **FEATURES,
        ),
    ),
    Query(
        "an4_top_complexity",
        lambda s, d: A.top_by(featured(s, d), "complexity_score", 20).select("source_file", "ordinal", "complexity_score"),
        oracle(
            "SELECT source_file, ordinal, complexity_score FROM s "
            "ORDER BY complexity_score DESC, source_file, ordinal LIMIT 20",
            **FEATURES,
        ),
    ),
    Query(
        "an5_mean_complexity",
        lambda s, d: A.mean_complexity(featured(s, d)),
        oracle("SELECT avg(complexity_score) AS average_complexity FROM s", **FEATURES),
    ),
    Query(
        "an6_top_importance",
        lambda s, d: A.top_by(featured(s, d), "importance_score", 50).select("source_file", "ordinal", "importance_score"),
        oracle(
            "SELECT source_file, ordinal, importance_score FROM s "
            "ORDER BY importance_score DESC, source_file, ordinal LIMIT 50",
            **FEATURES,
        ),
    ),
    Query("an7_top_tables", lambda s, d: A.top_tables(featured(s, d)), oracle(_TOP.format(k=20), **FEATURES)),
    Query("an7_heavy_tables", lambda s, d: A.heavy_tables(featured(s, d)), oracle(_TOP.format(k=20), **FEATURES)),
    Query("an8_findings", lambda s, d: A.findings(featured(s, d)), oracle("SELECT * FROM found", **RULES)),
    Query("an9_summary_lines", lambda s, d: A.summary_lines(featured(s, d)), oracle(_SUMMARY, **RULES)),
    Query(
        "an10_run_summary",
        _run_summary,
        _recursive(
            RUN_SUMMARY + " UNION ALL SELECT 'Files Scanned', count(*)::VARCHAR FROM files",
            **TAGGED,
            u=UNIQUE,
            files="files",
        ),
    ),
    Query(
        "an11_browse",
        lambda s, d: A.browse(featured(s, d), "SELECT", "LOW"),
        oracle(
            "SELECT source_file, ordinal, query_type, risk_level, complexity_score, importance_score, "
            f"{_PREVIEW.format(n=120)} AS preview FROM s WHERE query_type = 'SELECT' AND risk_level = 'LOW' "
            "ORDER BY source_file, ordinal LIMIT 500",
            **FEATURES,
        ),
    ),
    Query(
        "an12_category",
        lambda s, d: A.with_category(featured(s, d)).groupBy("category", "section_no").agg(F.count(F.lit(1)).alias("n")),
        oracle("SELECT category, section_no, count(*) AS n FROM k GROUP BY ALL", **FEATURES, k=_CATEGORIZED),
    ),
    Query(
        "an13_consolidated",
        lambda s, d: A.consolidated(featured(s, d)),
        oracle(
            f"""SELECT section_no, category, source_file, ordinal, {_HEADER} AS header, {_TIDY} AS body,
              row_number() OVER (PARTITION BY section_no ORDER BY source_file, ordinal) AS entry_no,
              count(*) OVER (PARTITION BY section_no) AS section_total FROM k""",
            **FEATURES,
            k=_CATEGORIZED,
        ),
    ),
    Query(
        "an14_tidy",
        lambda s, d: fixture(s, d, "f1").select("stmt_id", S.tidy_sql(F.col("raw_sql")).alias("tidy")),
        oracle(f"SELECT stmt_id, {_TIDY} AS tidy FROM f1", f1="f1"),
    ),
    Query(
        "an15_issue",
        lambda s, d: A.with_issue(featured(s, d)).select("stmt_id", "issue"),
        oracle(
            f"""SELECT stmt_id, CASE risk_level WHEN 'CRITICAL' THEN '{A.ISSUE_CRITICAL}'
              WHEN 'HIGH' THEN '{A.ISSUE_HIGH}' END AS issue FROM s""",
            **FEATURES,
        ),
    ),
    Query(
        "an16_table_ranks",
        lambda s, d: A.table_ranks(featured(s, d)),
        oracle(
            f"SELECT row_number() OVER (ORDER BY n DESC, table_name)::INT AS rank, table_name, n FROM ({_TOP.format(k=20)})",
            **FEATURES,
        ),
    ),
    Query(
        "sk3_report_lines",
        lambda s, d: as_line(A.type_distribution(featured(s, d))),
        oracle(
            """SELECT printf('{"query_type":"%s","n":%d}', query_type, n) AS value
              FROM (SELECT query_type, count(*) AS n FROM s GROUP BY 1)""",
            **FEATURES,
        ),
    ),
    Query(
        "sk5_listing",
        lambda s, d: A.listing(featured(s, d)).select(*_LISTING),
        oracle(
            f"""SELECT row_number() OVER (ORDER BY source_file, ordinal) AS number, query_type, source_file,
              regexp_replace(source_file, '/?[^/]*$', '') AS folder, line_start, line_end,
              array_to_string(table_names[1:5], ', ') AS tables,
              CASE WHEN has_joins THEN 'Yes' ELSE 'No' END AS has_joins,
              CASE WHEN has_subquery THEN 'Yes' ELSE 'No' END AS has_subquery,
              CASE WHEN has_cte THEN 'Yes' ELSE 'No' END AS has_cte, complexity_score, importance_score, risk_level,
              {_PREVIEW.format(n=200)} AS preview FROM s""",
            **FEATURES,
        ),
    ),
]
