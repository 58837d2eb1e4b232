"""Registered queries over identical and similar files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.operators import files as FD
from gleaner.session import shared_folder

NAMED = {"named": "named"}
_CANDIDATES = """SELECT * FROM named SEMI JOIN
  (SELECT name, size FROM named GROUP BY ALL HAVING count(*) > 1) USING (name, size)"""
_HASHED = "SELECT *, sha256(content) AS hash FROM candidates"
HASHED = {**NAMED, "candidates": _CANDIDATES, "hashed": _HASHED}
_HISTORY = """SELECT concat('u', cast(user_id as string)) AS path, sha256(props) AS hash, ts AS scan_date FROM events"""
_DISTINCT = "SELECT name, count(*) AS n FROM names GROUP BY 1"


def _history(spark, d):
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("path"), F.sha2("props", 256).alias("hash"), F.col("ts").alias("scan_date")
    )


def _from_batches(spark, d):
    """Four batches, the second written twice, a snapshot of the first two, one of these written again."""
    history, rows = FD.ScanHistory(spark, shared_folder(spark, "history")), _history(spark, d)
    batch = lambda i: rows.filter(F.pmod(F.dayofyear("scan_date"), F.lit(4)) == i)
    for i in (0, 1, 1):
        history.add(batch(i), f"scan-{i}")
    history.compact()
    for i in (1, 2, 3):
        history.add(batch(i), f"scan-{i}")
    return history.latest().withColumn("scan_date", F.date_format("scan_date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_LATEST = oracle(
    """SELECT path, arg_max(hash, scan_date) AS hash, strftime(max(scan_date), '%Y-%m-%d %H:%M:%S.%f') AS scan_date
      FROM h GROUP BY 1""",
    h=_HISTORY,
)

QUERIES = [
    Query(
        "fd1_candidates",
        lambda s, d: FD.candidate_files(fixture(s, d, "named")).select("path", "name", "size"),
        oracle("SELECT path, name, size FROM candidates", **HASHED),
    ),
    Query(
        "fd2_content_hash",
        lambda s, d: FD.with_hash(fixture(s, d, "named")).select(
            "path", "hash", FD.content_hash(F.col("content"), "md5").alias("md5"),
            FD.content_hash(F.col("content"), "sha1").alias("sha1"),
        ),
        oracle("SELECT path, sha256(content) AS hash, md5(content) AS md5, sha1(content) AS sha1 FROM named", **NAMED),
    ),
    Query(
        "fd3_identical_groups",
        lambda s, d: FD.identical_groups(fixture(s, d, "named")),
        oracle(
            """SELECT name, size, hash, count(*) AS n_files, min(path) AS first_path FROM hashed
              GROUP BY name, size, hash HAVING count(*) > 1""",
            **HASHED,
        ),
    ),
    Query(
        "fd3_identical_content",
        lambda s, d: FD.identical_groups(fixture(s, d, "named"), key="content"),
        oracle(
            """SELECT size, sha256(content) AS hash, count(*) AS n_files, min(path) AS first_path FROM named
              GROUP BY 1, 2 HAVING count(*) > 1""",
            **NAMED,
        ),
    ),
    Query(
        "fd4_duplicate_rows",
        lambda s, d: FD.duplicate_rows(fixture(s, d, "named")),
        oracle(
            """SELECT hash, name, path, size FROM (SELECT *, count(*) OVER (PARTITION BY name, size, hash) AS n
              FROM hashed) WHERE n > 1""",
            **HASHED,
        ),
    ),
    Query(
        "fd5_similar_names",
        lambda s, d: FD.similar_names(fixture(s, d, "names")).withColumn("similarity", F.round("similarity", 6)),
        oracle(
            """SELECT a.name AS name_a, b.name AS name_b, a.n AS n_a, b.n AS n_b,
              round(100.0::DOUBLE * (1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))), 6)
                AS similarity
            FROM uniq a JOIN uniq b ON a.name < b.name
            WHERE 100.0::DOUBLE * (1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))) >= 80""",
            names="names",
            uniq=_DISTINCT,
        ),
    ),
    Query(
        "fd6_latest_hash",
        lambda s, d: FD.latest_hash(_history(s, d)).withColumn(
            "scan_date", F.date_format("scan_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        _LATEST,
    ),
    Query("fd6_latest_from_batches", _from_batches, _LATEST),
]
