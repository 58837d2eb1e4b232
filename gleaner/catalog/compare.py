"""Registered queries over collections and listings of files."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog.base import Query, fixture, oracle
from gleaner.catalog.fixtures import COLLECTIONS
from gleaner.operators import compare as CP
from gleaner.operators import hunks as HU
from gleaner.operators import snapshots as SN


def _files(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "f9").withColumn("hash", F.sha2("content", 256))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return CP.collection_pairs(_files(spark, d), COLLECTIONS)


_ORDER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COLLECTIONS))
_HASHED = f"SELECT *, sha256(content) AS hash, CASE collection {_ORDER} END AS pos FROM f9"
_SHARED = "SELECT name FROM hashed GROUP BY name HAVING count(DISTINCT collection) >= 2"
_SIDES = ", ".join(f"('{a}', '{b}')" for a, b in combinations(COLLECTIONS, 2))
_PAIRS = f"""SELECT n.name, p.a AS left_collection, p.b AS right_collection, l.hash AS left_hash, r.hash AS right_hash,
  l.content AS left_content, r.content AS right_content
FROM shared n CROSS JOIN (VALUES {_SIDES}) p(a, b)
LEFT JOIN hashed l ON l.name = n.name AND l.collection = p.a LEFT JOIN hashed r ON r.name = n.name AND r.collection = p.b"""
CTES = {"f9": "f9", "hashed": _HASHED, "shared": _SHARED, "pairs": _PAIRS}
_STATUS = """CASE WHEN left_hash IS NULL OR right_hash IS NULL THEN 'missing' WHEN left_hash = right_hash THEN 'same'
  ELSE 'different' END"""
_LINES = """SELECT name, left_collection, right_collection, line, sum(sign) AS net FROM (
    SELECT name, left_collection, right_collection, unnest(string_split(left_content, chr(10))) AS line, -1 AS sign
    FROM pairs WHERE left_hash <> right_hash
    UNION ALL
    SELECT name, left_collection, right_collection, unnest(string_split(right_content, chr(10))), 1
    FROM pairs WHERE left_hash <> right_hash) GROUP BY ALL"""
_FLAGS = ", ".join(f"bool_or(collection = '{c}') AS {c}" for c in COLLECTIONS)


def _side(spark: SparkSession, d: str, collection: str) -> DataFrame:
    return _files(spark, d).filter(F.col("collection") == collection).select(F.col("name").alias("path"), "hash")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return SN.snapshot_diff(_side(spark, d, "old"), _side(spark, d, "test"))


_DIFF = """SELECT coalesce(o.name, n.name) AS path, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed'
  WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status
  FROM (SELECT * FROM hashed WHERE collection = 'old') o
  FULL JOIN (SELECT * FROM hashed WHERE collection = 'test') n ON o.name = n.name"""

def _patched(spark: SparkSession, d: str) -> DataFrame:
    """The hunks between two versions of every document, applied to the old one, give the new one."""
    files = fixture(spark, d, "versions").withColumn("hash", F.sha2("content", 256))
    found = HU.hunks(files, CP.collection_pairs(files, ["old", "new"]))
    return HU.apply_hunks(files.filter("collection = 'old'"), found).select("name", F.sha2("patched", 256).alias("patched"))


QUERIES = [
    Query(
        "cp1_common_names",
        lambda s, d: CP.common_names(_files(s, d)),
        oracle(
            "SELECT name, count(DISTINCT collection) AS n_collections FROM f9 GROUP BY name HAVING n_collections >= 2",
            f9="f9",
        ),
    ),
    Query(
        "cp2_collection_pairs",
        _pairs,
        oracle("SELECT name, left_collection, right_collection, left_hash, right_hash FROM pairs", **CTES),
    ),
    Query(
        "cp2_path_pairs",
        lambda s, d: CP.path_pairs(_files(s, d), [f"{c}/part1.txt" for c in COLLECTIONS]),
        oracle(
            """SELECT left_collection || '/part1.txt' AS left_collection, right_collection || '/part1.txt' AS right_collection,
              left_hash, right_hash FROM pairs WHERE name = 'part1.txt'""",
            **CTES,
        ),
    ),
    Query(
        "cp3_presence",
        lambda s, d: CP.presence(_files(s, d), COLLECTIONS),
        oracle(f"SELECT name, {_FLAGS}, count(DISTINCT collection)::INT AS n_collections FROM f9 GROUP BY name", f9="f9"),
    ),
    Query(
        "cp4_pair_status",
        lambda s, d: CP.pair_status(_pairs(s, d)).select("name", "left_collection", "right_collection", "status"),
        oracle(f"SELECT name, left_collection, right_collection, {_STATUS} AS status FROM pairs", **CTES),
    ),
    Query(
        "cp5_line_changes",
        lambda s, d: CP.line_changes(_files(s, d), _pairs(s, d)),
        oracle(
            """SELECT name, left_collection, right_collection, sum(greatest(net, 0))::BIGINT AS added,
              sum(greatest(-net, 0))::BIGINT AS removed FROM net GROUP BY ALL""",
            **CTES,
            net=_LINES,
        ),
    ),
    Query(
        "cp5_hunks",
        lambda s, d: HU.hunks(_files(s, d), _pairs(s, d)).select(
            *HU.PAIR, "hunk", "left_start", "right_start", HU.unified().alias("diff")
        ),
        oracle(
            """SELECT name, left_collection, right_collection, 1 AS hunk, 5 AS left_start, 5 AS right_start,
              '@@ -5,1 +5,1 @@' || chr(10) || '-copy of ' || left_collection || chr(10) || '+copy of ' || right_collection AS diff
              FROM pairs WHERE left_hash <> right_hash""",
            **CTES,
        ),
    ),
    Query(
        "cp5_patched_versions",
        _patched,
        oracle(
            """SELECT n.name, sha256(n.content) AS patched FROM versions n JOIN versions o USING (name)
              WHERE n.collection = 'new' AND o.collection = 'old' AND n.content <> o.content""",
            versions="versions",
        ),
    ),
    Query("st5_snapshot_diff", _diff, oracle(_DIFF, **CTES)),
    Query(
        "st5_dirty",
        lambda s, d: SN.dirty(_diff(s, d)),
        oracle(
            "SELECT count(*) > 0 AS dirty, count(*) AS n_changed FROM diff WHERE status <> 'unchanged'", **CTES, diff=_DIFF
        ),
    ),
    Query(
        "st6_filter_ignored",
        lambda s, d: SN.filter_ignored(fixture(s, d, "files")).select("path"),
        oracle(
            r"""SELECT path FROM files WHERE NOT regexp_matches(path,
              '(^|/)(__pycache__|venv|node_modules|dist|build)/|(^|/)([^/]*\.pyc|\.env)(/|$)')""",
            files="files",
        ),
    ),
]
