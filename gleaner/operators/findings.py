"""Aggregates, rankings, findings and report rows over statement frames with features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.functions import sqltext as S
from gleaner.functions.text import literal_map
from gleaner.operators.skew import number_rows
from gleaner.session import durable

PATH_ORDER = ["source_file", "ordinal"]

# Display category of each statement type, and the order of the sections.
CATEGORY_BY_TYPE = {
    "SELECT": "SELECT Queries",
    "WITH": "CTE Queries",
    "INSERT": "INSERT Queries",
    "UPDATE": "UPDATE Queries",
    "DELETE": "DELETE Queries",
    "MERGE": "MERGE Queries",
    "CREATE": "DDL - CREATE",
    "ALTER": "DDL - ALTER",
    "DROP": "DDL - DROP",
    "TRUNCATE": "DDL - TRUNCATE",
    "EXEC": "EXEC",
    "STORED_PROCEDURE": "STORED PROCEDURES",
    "VIEW": "VIEWS",
    "FUNCTION": "FUNCTIONS",
    "TRIGGER": "TRIGGERS",
    "INDEX": "INDEXES",
    "TRANSACTION": "TRANSACTION BLOCKS",
}
UNCATEGORIZED = "Uncategorized"
SECTION_ORDER = [
    "DDL - CREATE",
    "DDL - ALTER",
    "DDL - DROP",
    "DDL - TRUNCATE",
    "VIEWS",
    "FUNCTIONS",
    "STORED PROCEDURES",
    "EXEC",
    "TRIGGERS",
    "INDEXES",
    "SELECT Queries",
    "CTE Queries",
    "INSERT Queries",
    "UPDATE Queries",
    "DELETE Queries",
    "MERGE Queries",
    "TRANSACTION BLOCKS",
    "Uncategorized",
]
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
HIGH_COMPLEXITY = 20

# Report texts.
ISSUE_CRITICAL = "DELETE/UPDATE without WHERE - may affect ALL rows!"
ISSUE_HIGH = "DROP/TRUNCATE - irreversible operation"
FINDING_TEXTS = {
    "critical": "CRITICAL: %d DELETE/UPDATE queries found WITHOUT WHERE clause. "
    "Review immediately to prevent mass data loss.",
    "high": "HIGH RISK: %d DROP/TRUNCATE queries found. Ensure these are intentional and have backups.",
    "complex": "%d highly complex queries detected (score > 20). Consider optimization review.",
    "unfiltered": "%d UPDATE/DELETE queries lack WHERE clauses - potential full table modifications!",
    "top_table": "Most referenced table: '%s' appears in %d queries. Ensure proper indexing.",
    "ddl": "%d DDL statements found. Ensure schema changes are version-controlled.",
}
RISK_TEXTS = {
    "CRITICAL": "CRITICAL risk (DELETE/UPDATE without WHERE)",
    "HIGH": "HIGH risk (DROP/TRUNCATE)",
    "MEDIUM": "MEDIUM risk (DML with WHERE)",
    "LOW": "LOW risk (SELECT/DDL)",
}


def type_distribution(statements: DataFrame) -> DataFrame:
    return statements.groupBy("query_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query_type")


def risk_summary(statements: DataFrame) -> DataFrame:
    return statements.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def risk_pivot(statements: DataFrame) -> DataFrame:
    return statements.agg(*[F.count_if(F.col("risk_level") == r).alias(r.lower()) for r in RISK_LEVELS])


def high_risk(statements: DataFrame) -> DataFrame:
    """HIGH and CRITICAL statements, CRITICAL first, with the issue text."""
    critical = F.col("risk_level") == "CRITICAL"
    return with_issue(statements.filter(F.col("risk_level").isin("HIGH", "CRITICAL"))).orderBy(
        F.when(critical, 0).otherwise(1), *PATH_ORDER
    )


def with_issue(statements: DataFrame) -> DataFrame:
    return statements.withColumn(
        "issue",
        F.when(F.col("risk_level") == "CRITICAL", ISSUE_CRITICAL).when(F.col("risk_level") == "HIGH", ISSUE_HIGH),
    )


def top_by(statements: DataFrame, score: str, k: int) -> DataFrame:
    """Top k by a score, ties in path order (a bounded top-k, no full sort)."""
    return statements.orderBy(F.desc(score), *PATH_ORDER).limit(k)


def mean_complexity(statements: DataFrame) -> DataFrame:
    return statements.agg(F.avg("complexity_score").alias("average_complexity"))


def top_tables(statements: DataFrame, k: int = 20) -> DataFrame:
    counted = (
        statements.select(F.explode("table_names").alias("name"))
        .groupBy(F.lower("name").alias("table_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.orderBy(F.desc("n"), "table_name").limit(k)


#: Names that the sketch of ``heavy_tables`` tracks.
TRACKED_NAMES = 10_000


def heavy_tables(statements: DataFrame, k: int = 20, tracked: int = TRACKED_NAMES) -> DataFrame:
    """The rows of ``top_tables`` where there are too many names to count them all.

    A frequent-items sketch, merged from all tasks, gives up to ``tracked`` candidates; these alone are counted exactly. A name
    that the sketch does not give occurs at most in a known share of all references, twice the sketch's error. If the k-th
    candidate is above that, no other name can be among the first k; if not, the names are too even, and all are counted.
    """
    names = durable(statements.select(F.explode("table_names").alias("name")).select(F.lower("name").alias("table_name")))
    seen = names.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(table_name, {tracked}, {tracked})").alias("items")).first()
    items = [i["item"] for i in seen["items"] or [] if i["item"] is not None]
    # At most ``tracked`` names: a broadcast of bounded size.
    wanted = statements.sparkSession.createDataFrame([(i,) for i in items], "table_name string")
    counted = names.join(F.broadcast(wanted), "table_name").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.orderBy(F.desc("n"), "table_name").limit(k)
    slots = 1 << max(0, (-(-4 * tracked // 3) - 1).bit_length())  # places of the sketch: the next power of two
    if seen["total"] > slots * 3 // 4:  # up to there the sketch holds every name
        last = ranked.agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        if last["rows"] < k or last["n"] <= 7 * seen["total"] / slots:
            every = names.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
            return every.orderBy(F.desc("n"), "table_name").limit(k)
    return ranked


def table_ranks(statements: DataFrame, k: int = 20) -> DataFrame:
    """Rank, table, count; only the k ranked rows are numbered in one place."""
    ranked = top_tables(statements, k)
    return ranked.select(
        F.row_number().over(W.orderBy(F.desc("n"), "table_name")).alias("rank"), "table_name", "n"
    )


def profile(statements: DataFrame) -> DataFrame:
    """One row with every counter the findings and summaries use; one pass over the statements."""
    lacks_where = F.col("query_type").isin("UPDATE", "DELETE") & ~F.col("has_where")
    return statements.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(
            *[
                F.struct(F.count_if(F.col("query_type") == t).alias("n"), F.lit(t).alias("query_type"))
                for t in S.STATEMENT_TYPES
            ]
        ).alias("types"),
        *[F.count_if(F.col("risk_level") == r).alias(r.lower()) for r in RISK_LEVELS],
        F.avg("complexity_score").alias("average_complexity"),
        F.count_if(F.col("complexity_score") > HIGH_COMPLEXITY).alias("complex"),
        F.count_if(lacks_where).alias("unfiltered"),
        F.count_if(F.col("query_type").isin("CREATE", "ALTER", "DROP")).alias("ddl"),
    )


def _counter_findings() -> Column:
    """Findings of the rules over the ``profile`` row, as an array."""
    order = {"critical": 1, "high": 2, "complex": 3, "unfiltered": 4, "ddl": 6}
    rows = [
        F.struct(
            F.lit(no).alias("rule_no"),
            F.lit(rule).alias("rule"),
            F.col(rule).alias("metric"),
            F.format_string(FINDING_TEXTS[rule], F.col(rule)).alias("message"),
        )
        for rule, no in order.items()
    ]
    return F.filter(F.array(*rows), lambda r: r["metric"] > 0)


def _table_finding() -> Column:
    return F.format_string(FINDING_TEXTS["top_table"], F.col("table_name"), F.col("n"))


def findings(statements: DataFrame) -> DataFrame:
    """Rule-based findings: (rule_no, rule, metric, message) for every rule whose metric is positive."""
    by_counter = profile(statements).select(F.inline(_counter_findings()))
    by_table = top_tables(statements, 1).select(
        F.lit(5).alias("rule_no"),
        F.lit("top_table").alias("rule"),
        F.col("n").alias("metric"),
        _table_finding().alias("message"),
    )
    return by_counter.unionByName(by_table)


CLOSING = 1000  # line number of the blank line that ends a section


def _line(section: int, line: Column | int, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section_no"),
        (F.lit(line) if isinstance(line, int) else line).alias("line_no"),
        text.alias("text"),
    )


def summary_lines(statements: DataFrame) -> DataFrame:
    """Narrative summary as ordered (section_no, line_no, text) rows, with the headings of its sections; one pass for
    counters, one for tables. The sentences are fixed values."""
    frequent = F.array_sort(
        F.filter("types", lambda t: t["n"] > 0),
        lambda a, b: F.when(a["n"] > b["n"], -1)
        .when(a["n"] < b["n"], 1)
        .when(a["query_type"] < b["query_type"], -1)
        .when(a["query_type"] > b["query_type"], 1)
        .otherwise(0),
    )
    total = F.format_string("This consolidated document contains %d unique SQL queries.", F.col("total"))
    average = F.format_string("Average complexity score: %.1f", F.coalesce("average_complexity", F.lit(0.0)))
    risks = [F.format_string("  * %d " + RISK_TEXTS[r], F.col(r.lower())) for r in RISK_LEVELS]
    none = F.array().cast("array<struct<section_no:int,line_no:int,text:string>>")
    counted = F.concat(
        F.array(
            _line(1, 1, F.lit("NATURAL LANGUAGE SUMMARY")), _line(1, 2, F.lit("=" * 60)), _line(1, 3, total), _line(1, 4, F.lit(""))
        ),
        F.when(F.size(frequent) > 0, F.array(_line(2, 0, F.lit("Query Breakdown:")), _line(2, CLOSING, F.lit("")))).otherwise(none),
        F.transform(
            frequent, lambda t, i: _line(2, i + 1, F.format_string("  * %d %s queries", t["n"], t["query_type"]))
        ),
        F.array(
            _line(3, 0, F.lit("Risk Profile:")), *[_line(3, i, text) for i, text in enumerate(risks, 1)], _line(3, CLOSING, F.lit("")),
            _line(4, 1, average), _line(4, CLOSING, F.lit("")),
        ),
        F.when(F.size(_counter_findings()) > 0, F.array(_line(6, 0, F.lit("Key Recommendations:")))).otherwise(none),
        F.transform(_counter_findings(), lambda r: _line(6, r["rule_no"], F.concat(F.lit("  "), r["message"]))),
    )
    referenced = F.format_string("  * %s: referenced %d times", F.col("table_name"), F.col("n"))
    ranked = F.array(
        _line(5, F.col("rank"), referenced),
        F.when(F.col("rank") == 1, _line(5, 0, F.lit("Top Referenced Tables:"))),
        F.when(F.col("rank") == 1, _line(5, CLOSING, F.lit(""))),
        F.when(F.col("rank") == 1, _line(6, 0, F.lit("Key Recommendations:"))),
        F.when(F.col("rank") == 1, _line(6, 5, F.concat(F.lit("  "), _table_finding()))),
    )
    return (
        profile(statements)
        .select(F.inline(counted))
        .unionByName(table_ranks(statements, 5).select(F.inline(F.array_compact(ranked))))
        .distinct()
    )


def run_summary(stats: DataFrame, statements: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Metric and value rows of a whole run, from ``dedup_stats``, the surviving statements and, if given, the one row of
    ``scan_metrics``."""
    counters = profile(statements)
    first = stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(column).cast("string").alias("value"))
                    for name, column in {
                        "Total Queries Found": "total_input",
                        "Unique Queries": "total_unique",
                        "Duplicates Removed": "total_duplicates",
                        "Deduplication Rate": "dedup_rate",
                    }.items()
                ]
            )
        )
    )
    second = counters.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("Avg Complexity").alias("metric"),
                    F.format_string("%.1f", F.coalesce("average_complexity", F.lit(0.0))).alias("value"),
                ),
                F.struct(F.lit("Critical Risk").alias("metric"), F.col("critical").cast("string").alias("value")),
                F.struct(F.lit("High Risk").alias("metric"), F.col("high").cast("string").alias("value")),
            )
        )
    )
    out = first.unionByName(second)
    if scanned is not None:
        out = out.unionByName(scanned.select(F.lit("Files Scanned").alias("metric"), F.col("scanned").cast("string").alias("value")))
    return out


def browse(statements: DataFrame, query_type: str = "All", risk: str = "All", limit: int = 500) -> DataFrame:
    """Filter by type and risk ("All" keeps everything) and show the first rows with a short preview."""
    out = statements
    if query_type != "All":
        out = out.filter(F.col("query_type") == query_type)
    if risk != "All":
        out = out.filter(F.col("risk_level") == risk)
    return (
        out.orderBy(*PATH_ORDER)
        .limit(limit)
        .select(
            *PATH_ORDER,
            "query_type",
            "risk_level",
            "complexity_score",
            "importance_score",
            S.preview(F.col("raw_sql"), 120).alias("preview"),
        )
    )


def with_category(statements: DataFrame) -> DataFrame:
    """Display category and its place in the section order."""
    category = F.coalesce(F.element_at(literal_map(CATEGORY_BY_TYPE), F.col("query_type")), F.lit(UNCATEGORIZED))
    return statements.withColumn("category", category).withColumn(
        "section_no", F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("category")).cast("int")
    )


def entry_header(statement: str = "raw_sql") -> Column:
    """Metadata comment in front of a listed statement."""
    lines = [
        F.concat(F.lit("-- Source File : "), F.col("source_file")),
        F.concat(F.lit("-- Query Type  : "), F.col("query_type")),
        F.concat(F.lit("-- Line Number : "), F.col("line_start"), F.lit(" - "), F.col("line_end")),
        F.concat(F.lit("-- Complexity  : "), F.col("complexity_score")),
        F.concat(F.lit("-- Risk Level  : "), F.col("risk_level")),
        F.concat(F.lit("-- Importance  : "), F.col("importance_score")),
        F.when(
            F.size("table_names") > 0,
            F.concat(F.lit("-- Tables      : "), F.array_join("table_names", ", ")),
        ),
    ]
    return F.concat_ws("\n", *lines)


def consolidated(statements: DataFrame) -> DataFrame:
    """Statements by section in section order: place in the section, section total, header and tidied text."""
    listed = with_category(statements).select(
        "section_no",
        "category",
        *PATH_ORDER,
        entry_header().alias("header"),
        S.tidy_sql(F.col("raw_sql")).alias("body"),
    )
    return number_rows(listed, ["section_no"], PATH_ORDER, "entry_no").withColumnRenamed(
        "entry_no_total", "section_total"
    )


def listing(statements: DataFrame) -> DataFrame:
    """Fourteen-column statement table, numbered in path order."""
    yes_no = {c: F.when(F.col(c), "Yes").otherwise("No") for c in ("has_joins", "has_subquery", "has_cte")}
    rows = statements.select(
        F.lit(0).alias("sheet"),
        *PATH_ORDER,
        "query_type",
        F.regexp_replace("source_file", "/?[^/]*$", "").alias("folder"),
        "line_start",
        "line_end",
        F.array_join(F.slice("table_names", 1, 5), ", ").alias("tables"),
        *[column.alias(name) for name, column in yes_no.items()],
        "complexity_score",
        "importance_score",
        "risk_level",
        S.preview(F.col("raw_sql"), 200).alias("preview"),
    )
    return number_rows(rows, ["sheet"], PATH_ORDER, "number").drop("sheet", "number_total", "ordinal")
