"""Registered queries over inventory texts and key enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle
from gleaner.operators import inventory as EX

_VERSIONS = r"list_distinct(regexp_extract_all(content, 'ORACLE_HOME\s+REG_SZ\s+.*?product\\([\d\.]+)\\', 1))"
_RECORDS = rf"""SELECT path, collection, regexp_extract(content, 'Hostname:\s*(\S+)', 1) AS hostname,
  regexp_extract(content, 'IP Address:\s*(\S+)', 1) AS ip_address, {_VERSIONS} AS versions FROM f3"""
CTES = {"f3": "f3", "records": _RECORDS}
_LIST = "array_to_string(list_sort(versions, 'DESC'), ':')"


def records(spark: SparkSession, d: str) -> DataFrame:
    return EX.inventory(fixture(spark, d, "f3"))


_LATEST = f"""SELECT key, arg_max(status, ord) AS status, arg_max(note, ord) AS note, arg_max(sheet, ord) AS sheet
  FROM (SELECT *, {D.trim_ws('ip')} AS key FROM f4_lookup) WHERE key <> '' GROUP BY key"""
_ENRICHED = f"""SELECT b.sheet, b.host, b.ip, coalesce(l.note, '') AS "E2_note", coalesce(l.sheet, '') AS "E2_sheet",
  coalesce(l.status, '') AS "E2_status" FROM f4_base b LEFT JOIN latest l ON {D.trim_ws('b.ip')} = l.key"""
LOOKUP = {"f4_base": "f4_base", "f4_lookup": "f4_lookup", "latest": _LATEST, "enriched": _ENRICHED}


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """The lookup as sheets with different columns: one of them lacks the note."""
    rows = fixture(spark, d, "f4_lookup")
    return EX.union_sheets([rows.filter("status <> 'N'"), rows.filter("status = 'N'").drop("note")])


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return EX.enrich(fixture(spark, d, "f4_base"), fixture(spark, d, "f4_lookup"), "ip", ["ord"])


QUERIES = [
    Query(
        "ex1_labelled_values",
        lambda s, d: records(s, d).select("path", "hostname", "ip_address"),
        oracle("SELECT path, hostname, ip_address FROM records", **CTES),
    ),
    Query(
        "ex2_versions",
        lambda s, d: records(s, d).select("path", F.size("versions").alias("n_versions"), "present"),
        oracle(
            "SELECT path, len(versions)::INT AS n_versions, CASE WHEN len(versions) > 0 THEN 'Yes' ELSE 'No' END AS present "
            "FROM records",
            **CTES,
        ),
    ),
    Query(
        "ex3_version_list",
        lambda s, d: records(s, d).select("path", "version_list"),
        oracle(f"SELECT path, {_LIST} AS version_list FROM records", **CTES),
    ),
    Query(
        "ex4_grouped_inventory",
        lambda s, d: EX.grouped_inventory(fixture(s, d, "f3")).groupBy("collection", "sheet").agg(
            F.count("*").alias("n"), F.count_if(F.col("present") == "Yes").alias("n_present")
        ),
        oracle(
            """SELECT collection, substring(collection, 1, 31) AS sheet, count(*) AS n,
              count(*) FILTER (len(versions) > 0) AS n_present FROM records GROUP BY ALL""",
            **CTES,
        ),
    ),
    Query(
        "ex5_missing_audit",
        lambda s, d: EX.missing_audit(records(s, d)),
        oracle(
            """SELECT collection, count(*) AS n_records, count(*) FILTER (hostname = '') AS no_hostname,
              count(*) FILTER (ip_address = '') AS no_ip_address, count(*) FILTER (len(versions) = 0) AS no_versions
              FROM records GROUP BY 1""",
            **CTES,
        ),
    ),
    Query("ex6_enrich", enriched, oracle("SELECT * FROM enriched", **LOOKUP)),
    Query(
        "ex6_union_sheets",
        lambda s, d: _sheets(s, d).groupBy("sheet", "status").agg(
            F.count("*").alias("n"), F.count("note").alias("n_note")
        ),
        oracle(
            """SELECT sheet, status, count(*) AS n, count(*) FILTER (status <> 'N') AS n_note FROM f4_lookup
              GROUP BY ALL""",
            f4_lookup="f4_lookup",
        ),
    ),
    Query(
        "ex7_per_sheet",
        lambda s, d: enriched(s, d).groupBy("sheet").agg(
            F.count("*").alias("n"), F.count_if(F.col("E2_status") != "").alias("n_matched")
        ),
        oracle(
            """SELECT sheet, count(*) AS n, count(*) FILTER ("E2_status" <> '') AS n_matched FROM enriched GROUP BY 1""",
            **LOOKUP,
        ),
    ),
]
