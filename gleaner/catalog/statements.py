"""Registered queries over statements: extraction, classification, features, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle
from gleaner.functions import sqltext as S
from gleaner.operators import statements as ST


def typed(spark: SparkSession, d: str) -> DataFrame:
    return ST.with_type(ST.filter_valid(fixture(spark, d, "f1")))


def featured(spark: SparkSession, d: str) -> DataFrame:
    return ST.with_features(typed(spark, d))


FEATURES = {"f1": "f1", "s": D.features("f1")}

_PIECES = f"""SELECT source_file, (generate_subscripts({D.pieces('content')}, 1) - 1)::INT AS ordinal,
  unnest({D.pieces('content')}) AS piece FROM f2"""
_SUMS = f"""SELECT *, sum({D.block_change('piece')}) OVER (PARTITION BY source_file ORDER BY ordinal) AS s FROM pieces"""
_DEPTHS = """SELECT *, s - least(0, min(s) OVER (PARTITION BY source_file ORDER BY ordinal)) AS depth FROM sums"""
_ENDS = """SELECT *, depth = 0 OR ordinal > coalesce(max(CASE WHEN depth = 0 THEN ordinal END) OVER (PARTITION BY source_file), -1)
  AS ends FROM depths"""
_NUMBERED = """SELECT source_file, ordinal, piece, coalesce(sum(ends::INT) OVER (PARTITION BY source_file ORDER BY ordinal
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement FROM ends"""
_WHOLE = """SELECT source_file, min(ordinal) AS ordinal, string_agg(piece, '' ORDER BY ordinal) AS piece FROM numbered
  GROUP BY source_file, statement"""
_SPLIT = f"""SELECT source_file, ordinal, {D.trim_ws('piece')} AS raw_sql, piece FROM whole"""
_LINES = f"""SELECT *, {D.statement_type('raw_sql')} AS query_type,
  (coalesce(sum({D.n_lines('piece')} - 1) OVER (PARTITION BY source_file ORDER BY ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + {D.n_lines(r"regexp_extract(piece, '^(\s*)', 1)")})::INT AS line_start FROM split"""
_KEPT = f"""SELECT source_file, ordinal, raw_sql, query_type, line_start,
  (line_start + {D.n_lines('raw_sql')} - 1)::INT AS line_end
  FROM lines WHERE length(raw_sql) >= 10 AND NOT ({D.comment_only('raw_sql')}) AND query_type <> 'UNKNOWN'"""
SPLIT = {
    "f2": "f2",
    "pieces": _PIECES,
    "sums": _SUMS,
    "depths": _DEPTHS,
    "ends": _ENDS,
    "numbered": _NUMBERED,
    "whole": _WHOLE,
    "split": _SPLIT,
    "lines": _LINES,
    "kept": _KEPT,
}

_STARTERS = "SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE|ALTER|DROP|TRUNCATE|EXEC|EXECUTE|WITH|BEGIN|DECLARE|CALL"


def line_runs(source: str) -> dict[str, str]:
    exploded = f"""SELECT source_file, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no,
      unnest(string_split(content, chr(10))) AS line FROM {source}"""
    marked = rf"""SELECT *, regexp_matches(line, '(?i)^\s*(?:{_STARTERS})\b') AS starts,
      contains(line, ';') OR regexp_matches(line, '^\s*$') AS closes FROM run_lines"""
    celled = """SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY source_file ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cell FROM run_marked"""
    opened = """SELECT *, min(CASE WHEN starts THEN line_no END) OVER (PARTITION BY source_file, cell) AS open_at
      FROM run_cells"""
    texts = f"""SELECT source_file, open_at, {D.trim_ws("string_agg(line, chr(10) ORDER BY line_no)")} AS raw_sql,
      max(line_no) AS line_end FROM run_open WHERE line_no >= open_at GROUP BY source_file, open_at"""
    kept = f"""SELECT source_file, (open_at - 1)::INT AS ordinal, raw_sql, query_type, open_at AS line_start, line_end
      FROM (SELECT *, {D.statement_type('raw_sql')} AS query_type FROM run_texts WHERE length(raw_sql) >= 10)
      WHERE query_type <> 'UNKNOWN'"""
    return {
        "run_lines": exploded,
        "run_marked": marked,
        "run_cells": celled,
        "run_open": opened,
        "run_texts": texts,
        "runs": kept,
    }


def compat_runs(source: str) -> dict[str, str]:
    """The block of a starter ends at the next closing line below it; the next block opens at the first starter below that."""
    plain = line_runs(source)
    jumps = """SELECT a.source_file, a.line_no, coalesce(min(b.line_no), 2147483647) AS end_at FROM run_marked a
      LEFT JOIN run_marked b ON a.source_file = b.source_file AND b.line_no > a.line_no AND b.closes
      WHERE a.starts GROUP BY ALL"""
    openers = """SELECT source_file, line_no, end_at FROM jumps
      QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY line_no) = 1
      UNION ALL SELECT source_file, line_no, end_at FROM (SELECT j.* FROM openers o JOIN jumps j
        ON j.source_file = o.source_file AND j.line_no > o.end_at
        QUALIFY row_number() OVER (PARTITION BY j.source_file ORDER BY j.line_no) = 1)"""
    opened = """SELECT m.*, o.line_no AS open_at FROM run_marked m JOIN openers o
      ON m.source_file = o.source_file AND m.line_no BETWEEN o.line_no AND o.end_at"""
    return {
        "run_lines": plain["run_lines"],
        "run_marked": plain["run_marked"],
        "jumps": jumps,
        "openers": openers,
        "run_open": opened,
        "run_texts": plain["run_texts"],
        "runs": plain["runs"],
    }


_PICK = ["source_file", "ordinal", "raw_sql", "query_type", "line_start", "line_end"]


def _first_match_sql() -> str:
    needle = f"substring({D.trim_ws('''split_part(raw_sql, chr(10), 1)''')}, 1, 50)"
    at = f"(CASE WHEN {needle} <> '' THEN instr(content, {needle}) ELSE 0 END)"
    start = f"(CASE WHEN {at} > 0 THEN {D.n_lines(f'substring(content, 1, {at} - 1)')} ELSE 1 END)"
    end = (
        f"(CASE WHEN {at} > 0 THEN least({start} + {D.n_lines('raw_sql')} - 1, {D.n_lines('content')}) ELSE 1 END)"
    )
    return oracle(
        f"SELECT source_file, ordinal, line_start, {start}::INT AS line_first_match, {end}::INT AS line_first_match_end "
        "FROM kept JOIN f2 USING (source_file)",
        **SPLIT,
    )


def _first_match(spark: SparkSession, d: str) -> DataFrame:
    files = fixture(spark, d, "f2")
    return ST.with_first_match_lines(ST.statement_lines(files), files).select(
        "source_file", "ordinal", "line_start", "line_first_match", "line_first_match_end"
    )


QUERIES = [
    Query(
        "sq1_split_statements",
        lambda s, d: ST.split_statements(fixture(s, d, "f2")).select(*_PICK[:4]),
        oracle(f"SELECT {', '.join(_PICK[:4])} FROM kept", **SPLIT),
    ),
    Query(
        "sq2_line_runs",
        lambda s, d: ST.extract_line_runs(fixture(s, d, "f2")).select(*_PICK),
        oracle(f"SELECT {', '.join(_PICK)} FROM runs", f2="f2", **line_runs("f2")),
    ),
    Query(
        "sq2_line_runs_compat",
        lambda s, d: ST.extract_line_runs(fixture(s, d, "f2"), "compat").select(*_PICK),
        oracle(f"SELECT {', '.join(_PICK)} FROM runs", f2="f2", **compat_runs("f2")).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    Query(
        "sq3_extract_statements",
        lambda s, d: ST.extract_statements(fixture(s, d, "f2")).select(*_PICK, "extractor"),
        oracle(
            f"SELECT {', '.join(_PICK)}, 'split' AS extractor FROM kept UNION ALL "
            f"SELECT {', '.join(_PICK)}, 'lines' AS extractor FROM runs",
            **SPLIT,
            rest="SELECT * FROM f2 WHERE source_file NOT IN (SELECT source_file FROM kept)",
            **line_runs("rest"),
        ),
    ),
    Query(
        "sq4_comment_only",
        lambda s, d: fixture(s, d, "f1").select(
            "stmt_id",
            S.is_comment_only(F.col("raw_sql")).alias("whole"),
            S.is_comment_only(F.col("raw_sql"), strict=True).alias("whole_by_lines"),
            S.is_comment_only(F.split_part("raw_sql", F.lit("\n"), F.lit(1))).alias("first_line"),
        ),
        oracle(
            f"SELECT stmt_id, {D.comment_only('raw_sql')} AS whole, {D.comment_only('raw_sql', True)} AS whole_by_lines, "
            f"{D.comment_only('split_part(raw_sql, chr(10), 1)')} AS first_line FROM f1",
            f1="f1",
        ),
    ),
    Query(
        "sq5_statement_type",
        lambda s, d: ST.with_type(fixture(s, d, "f1")).select("stmt_id", "query_type"),
        oracle(f"SELECT stmt_id, {D.statement_type('raw_sql')} AS query_type FROM f1", f1="f1"),
    ),
    Query(
        "sq6_valid",
        lambda s, d: ST.filter_valid(fixture(s, d, "f1")).select("stmt_id"),
        oracle(f"SELECT stmt_id FROM f1 WHERE {D.valid('raw_sql', False)}", f1="f1"),
    ),
    Query(
        "sq6_valid_strict",
        lambda s, d: ST.filter_valid(fixture(s, d, "f1"), strict=True).select("stmt_id"),
        oracle(f"SELECT stmt_id FROM f1 WHERE {D.valid('raw_sql', True)}", f1="f1"),
    ),
    Query(
        "sq7_normal_form",
        lambda s, d: ST.with_normal_form(fixture(s, d, "f1")).select("stmt_id", "normalized_sql"),
        oracle(f"SELECT stmt_id, {D.normalized('raw_sql')} AS normalized_sql FROM f1", f1="f1"),
    ),
    Query(
        "sq8_fingerprint",
        lambda s, d: ST.with_normal_form(fixture(s, d, "f1")).select("stmt_id", "fingerprint"),
        oracle(f"SELECT stmt_id, sha256({D.normalized('raw_sql')}) AS fingerprint FROM f1", f1="f1"),
    ),
    Query(
        "sq9_flags",
        lambda s, d: ST.with_flags(typed(s, d)).select(
            "stmt_id", "has_joins", "has_subquery", "has_cte", "has_aggregation", "has_where"
        ),
        oracle(
            "SELECT stmt_id, has_joins, has_subquery, has_cte, has_aggregation, has_where FROM s", **FEATURES
        ),
    ),
    Query(
        "sq10_table_refs",
        lambda s, d: fixture(s, d, "f1").select(
            "stmt_id", F.array_join(S.table_refs(F.col("raw_sql")), ",").alias("tables")
        ),
        oracle(f"SELECT stmt_id, array_to_string({D.tables('raw_sql')}, ',') AS tables FROM f1", f1="f1"),
    ),
    Query(
        "sq11_complexity",
        lambda s, d: featured(s, d).select("stmt_id", "complexity_score"),
        oracle("SELECT stmt_id, complexity_score FROM s", **FEATURES),
    ),
    Query(
        "sq12_risk",
        lambda s, d: featured(s, d).select("stmt_id", "risk_level"),
        oracle("SELECT stmt_id, risk_level FROM s", **FEATURES),
    ),
    Query(
        "sq13_importance",
        lambda s, d: featured(s, d).select("stmt_id", "importance_score"),
        oracle("SELECT stmt_id, importance_score FROM s", **FEATURES),
    ),
    Query("sq14_lines", _first_match, _first_match_sql()),
    Query(
        "sq15_filter_scores",
        lambda s, d: ST.filter_scores(featured(s, d), 2, 8).select("stmt_id", "complexity_score", "importance_score"),
        oracle(
            "SELECT stmt_id, complexity_score, importance_score FROM s "
            "WHERE complexity_score >= 2 AND importance_score >= 8",
            **FEATURES,
        ),
    ),
]
