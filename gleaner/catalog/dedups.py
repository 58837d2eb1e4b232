"""Registered queries over duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.catalog.fixtures import FIXTURES
from gleaner.catalog.statements import FEATURES, featured, typed
from gleaner.functions import sqltext as S
from gleaner.operators import dedup as DD
from gleaner.operators import statements as ST
from gleaner.operators.neardup import near_dup, pair_similarity
from gleaner.session import durable, shared_folder
from gleaner.streaming.streams import dedup_stream

_ORDER = "ORDER BY source_file, ordinal"
_EXACT = f"""SELECT *, first_value(stmt_id) OVER (PARTITION BY fingerprint {_ORDER}) AS first_id,
  count(*) OVER (PARTITION BY fingerprint) AS group_size FROM s"""
_KEPT = f"SELECT *, sha256({D.template('raw_sql')}) AS template FROM exact WHERE stmt_id = first_id"
_TEMPLATE = f"""SELECT * EXCLUDE (first_id, group_size),
  first_value(stmt_id) OVER (PARTITION BY template {_ORDER}) AS first_id,
  count(*) OVER (PARTITION BY template) AS group_size FROM first_seen"""
TIERS = {**FEATURES, "exact": _EXACT, "first_seen": _KEPT, "tmpl": _TEMPLATE}

# The leader rule, one record per recursion step: the state is the list of leaders so far.
_REPS = f"""SELECT stmt_id, query_type, source_file, ordinal, list_distinct({D.tokens('raw_sql')}) AS form,
  row_number() OVER (PARTITION BY query_type {_ORDER}) AS i FROM tmpl WHERE stmt_id = first_id"""
_FOUND = f"list_filter(w.leaders, lambda x: {D.jaccard('x.form', 'r.form')} >= 0.95)"
_WALK = f"""SELECT query_type, 0::BIGINT AS i, NULL::BIGINT AS stmt_id, NULL::BIGINT AS leader_id,
    []::STRUCT(id BIGINT, form VARCHAR[])[] AS leaders FROM reps WHERE i = 1
  UNION ALL
  SELECT r.query_type, r.i, r.stmt_id,
    CASE WHEN len({_FOUND}) > 0 THEN {_FOUND}[1].id ELSE r.stmt_id END,
    CASE WHEN len({_FOUND}) > 0 THEN w.leaders
      ELSE list_append(w.leaders, {{'id': r.stmt_id, 'form': r.form}}) END
  FROM walk w JOIN reps r ON r.query_type = w.query_type AND r.i = w.i + 1"""
NEAR = {**TIERS, "reps": _REPS, "walk": _WALK, "near": "SELECT stmt_id, leader_id FROM walk WHERE stmt_id IS NOT NULL"}


def _recursive(select: str, **ctes: str) -> str:
    return oracle(select, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_TAGGED = """SELECT stmt_id, 'EXACT' AS tier, first_id AS original_id FROM exact WHERE stmt_id <> first_id
  UNION ALL SELECT stmt_id, 'NORMALIZED', first_id FROM tmpl WHERE stmt_id <> first_id
  UNION ALL SELECT stmt_id, 'SEMANTIC', leader_id FROM near WHERE stmt_id <> leader_id
  UNION ALL SELECT stmt_id, 'UNIQUE', NULL FROM near WHERE stmt_id = leader_id"""
TAGGED = {**NEAR, "tagged": _TAGGED}


def exact(spark: SparkSession, d: str) -> DataFrame:
    return DD.exact_tier(durable(ST.with_normal_form(typed(spark, d))))


def template(spark: SparkSession, d: str) -> DataFrame:
    return DD.template_tier(durable(DD.survivors(exact(spark, d))))


def tagged(spark: SparkSession, d: str, metric: str = "jaccard") -> DataFrame:
    return DD.dedup(durable(featured(spark, d)), metric=metric)


_TIER_COLUMNS = ["source_file", "ordinal", "is_duplicate", "group_size"]


def _tier(df: DataFrame) -> DataFrame:
    return df.select(
        *_TIER_COLUMNS, F.col("survivor.source_file").alias("first_file"), F.col("survivor.ordinal").alias("first_ordinal")
    )


def _tier_sql(cte: str) -> str:
    return (
        f"SELECT a.source_file, a.ordinal, a.stmt_id <> a.first_id AS is_duplicate, a.group_size, "
        f"b.source_file AS first_file, b.ordinal AS first_ordinal FROM {cte} a JOIN f1 b ON b.stmt_id = a.first_id"
    )


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "f1").select("stmt_id", "raw_sql")
    after = rows.select((F.col("stmt_id") - 16).alias("stmt_id"), F.col("raw_sql").alias("other_sql"))
    return rows.join(after, "stmt_id")


_PAIRS = """SELECT a.stmt_id, a.raw_sql, b.raw_sql AS other_sql FROM f1 a JOIN f1 b ON b.stmt_id = a.stmt_id + 16"""


def _similarity(metric: str):
    return lambda s, d: pair_similarity(_neighbours(s, d), "raw_sql", "other_sql", metric).select(
        "stmt_id", F.round("similarity", 6).alias("similarity")
    )


def _similarity_sql(score: str) -> str:
    small, large = "least(len(t1), len(t2))", "greatest(len(t1), len(t2))"
    return oracle(
        f"SELECT stmt_id, round(CASE WHEN {small} = 0 OR {small} * 2 < {large} THEN 0.0 ELSE {score} END, 6) "
        "AS similarity FROM toks",
        f1="f1",
        pairs=_PAIRS,
        toks=f"SELECT stmt_id, {D.tokens('raw_sql')} AS t1, {D.tokens('other_sql')} AS t2 FROM pairs",
    )


_T1, _T2 = "array_to_string(t1, ' ')", "array_to_string(t2, ' ')"


def _template_survivors(spark: SparkSession, d: str) -> DataFrame:
    kept = DD.survivors(template(spark, d))
    return durable(kept.select("stmt_id", "source_file", "ordinal", "query_type", "raw_sql"))


def _near(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        near = near_dup(_template_survivors(spark, d), metric=metric)
        return near.select(
            "stmt_id",
            "is_duplicate",
            F.col("survivor.source_file").alias("leader_file"),
            F.col("survivor.ordinal").alias("leader_ordinal"),
        )

    return run


def _edges_sql() -> str:
    """Group numbers over all tiers, the first duplicate's preview, then the flat edges of all groups."""
    keyed = """SELECT t.stmt_id, t.tier, t.original_id, s.source_file, s.ordinal, s.line_start, s.raw_sql,
      CASE t.tier WHEN 'EXACT' THEN 1 WHEN 'NORMALIZED' THEN 2 ELSE 3 END AS tier_order,
      CASE WHEN t.tier = 'EXACT' THEN s.fingerprint ELSE t.stmt_id::VARCHAR END AS group_key
      FROM tagged t JOIN s USING (stmt_id) WHERE t.tier <> 'UNIQUE'"""
    groups = """SELECT tier_order, group_key, min(stmt_id) AS first_dup FROM keyed GROUP BY ALL"""
    numbered = """SELECT group_key, tier_order, first_dup,
      row_number() OVER (ORDER BY tier_order, first_dup) AS group_no FROM groups"""
    return _recursive(
        """SELECT n.group_no, CASE WHEN k.tier = 'NORMALIZED' THEN 'FORMATTING' ELSE k.tier END AS duplicate_type,
          o.source_file AS original_file, o.line_start AS original_line, k.source_file AS duplicate_file,
          k.line_start AS duplicate_line, k.tier AS match_type, substring(p.raw_sql, 1, 100) AS preview,
          CASE WHEN k.tier = 'SEMANTIC' THEN round(sim.score, 6) END AS similarity
        FROM keyed k JOIN numbered n USING (tier_order, group_key) JOIN f1 o ON o.stmt_id = k.original_id
        JOIN f1 p ON p.stmt_id = n.first_dup LEFT JOIN sim ON sim.stmt_id = k.stmt_id""",
        **TAGGED,
        keyed=keyed,
        groups=groups,
        numbered=numbered,
        sim=f"""SELECT stmt_id, CASE WHEN least(len(t1), len(t2)) * 2 < greatest(len(t1), len(t2)) THEN 0.0
          ELSE {D.jaccard('list_distinct(t1)', 'list_distinct(t2)')} END AS score FROM (
          SELECT t.stmt_id, {D.tokens('a.raw_sql')} AS t1, {D.tokens('b.raw_sql')} AS t2 FROM tagged t
          JOIN f1 a USING (stmt_id) JOIN f1 b ON b.stmt_id = t.original_id WHERE t.tier = 'SEMANTIC')""",
    )


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return DD.duplicate_edges(durable(tagged(spark, d))).withColumn("similarity", F.round("similarity", 6))


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = durable(tagged(spark, d))
    return DD.edge_report_lines(DD.dedup_stats(rows), durable(DD.duplicate_edges(rows))).select("group_no", "line_no", "text")


def _report_sql() -> str:
    titles = """SELECT group_no, min({'a': duplicate_type, 'b': original_file, 'c': original_line, 'd': preview}) AS g
      FROM edges GROUP BY 1"""
    counts = """SELECT count(*) AS n, count(*) FILTER (tier = 'UNIQUE') AS u, count(*) FILTER (tier IN ('EXACT', 'NORMALIZED')) AS e,
      count(*) FILTER (tier = 'SEMANTIC') AS m FROM tagged"""
    head = """SELECT unnest([repeat('=', 80), 'DEDUPLICATION REPORT', repeat('=', 80), printf('Total queries processed : %d', n),
      printf('Unique queries retained : %d', u), printf('Total duplicates removed: %d', n - u), printf('  - Exact duplicates    : %d', e),
      printf('  - Semantic duplicates : %d', m), printf('Deduplication rate      : %.1f%%', round((n - u) * 100.0::DOUBLE / greatest(n, 1), 1)),
      '', 'DUPLICATE GROUPS:', repeat('-', 80)]) AS text, generate_subscripts(range(12), 1) - 1 AS line_no FROM counts"""
    body, _, select = _edges_sql().rpartition("SELECT n.group_no")
    return (
        f"{body.rstrip()}, edges AS (SELECT n.group_no{select}), titles AS ({titles}), counts AS ({counts}), head AS ({head}) "
        """SELECT 0::BIGINT AS group_no, line_no::INT AS line_no, text FROM head
        UNION ALL SELECT group_no, 0, '' FROM titles
        UNION ALL SELECT group_no, 1, printf('Group #%d (%s)', group_no, g.a) FROM titles
        UNION ALL SELECT group_no, 2, printf('  Original : %s (Line %d)', g.b, g.c) FROM titles
        UNION ALL SELECT group_no, 3, '  Preview  : ' || substring(g.d, 1, 80) FROM titles
        UNION ALL SELECT group_no, 4, printf('  Duplicate: %s (Line %d) [%s]', duplicate_file, duplicate_line, match_type) FROM edges"""
    )


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders arrive as a stream of statements; the first of every fingerprint is written on, then read back."""
    schema = table(spark, d, "orders").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    source.createOrReplaceTempView("orders")
    arriving = spark.sql(f"SELECT current_timestamp() AS arrived, * FROM ({FIXTURES['f1'].sql})")
    unique = dedup_stream(ST.with_normal_form(arriving), "arrived").select("fingerprint")
    out = shared_folder(spark, "dedup-stream")
    query = (
        unique.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("fingerprint string").parquet(out)


QUERIES = [
    Query("dd1_exact", lambda s, d: _tier(exact(s, d)), oracle(_tier_sql("exact"), **TIERS)),
    Query(
        "dd1_exact_stream",
        _stream,
        oracle(f"SELECT DISTINCT sha256({D.normalized('raw_sql')}) AS fingerprint FROM f1", f1="f1"),
    ),
    Query("dd2_template", lambda s, d: _tier(template(s, d)), oracle(_tier_sql("tmpl"), **TIERS)),
    Query(
        "dd3_tokens",
        lambda s, d: fixture(s, d, "f1").select(
            "stmt_id", F.array_join(S.tokens(S.template_key(F.col("raw_sql"))), " ").alias("tokens")
        ),
        oracle(f"SELECT stmt_id, array_to_string({D.tokens('raw_sql')}, ' ') AS tokens FROM f1", f1="f1"),
    ),
    Query(
        "dd4_similarity_jaccard",
        _similarity("jaccard"),
        _similarity_sql(D.jaccard("list_distinct(t1)", "list_distinct(t2)")),
    ),
    Query(
        "dd4_similarity_levenshtein",
        _similarity("levenshtein"),
        _similarity_sql(f"1 - levenshtein({_T1}, {_T2}) / greatest(length({_T1}), length({_T2}))"),
    ),
    Query(
        "dd5_near_dup",
        _near("jaccard"),
        _recursive(
            "SELECT n.stmt_id, n.stmt_id <> n.leader_id AS is_duplicate, l.source_file AS leader_file, "
            "l.ordinal AS leader_ordinal FROM near n JOIN f1 l ON l.stmt_id = n.leader_id",
            **NEAR,
        ),
    ),
    Query(
        "dd6_stats",
        lambda s, d: DD.dedup_stats(tagged(s, d)),
        _recursive(
            """SELECT count(*) AS total_input, count(*) FILTER (tier = 'UNIQUE') AS total_unique,
              count(*) FILTER (tier <> 'UNIQUE') AS total_duplicates,
              count(*) FILTER (tier IN ('EXACT', 'NORMALIZED')) AS exact_duplicates,
              count(*) FILTER (tier = 'SEMANTIC') AS semantic_duplicates,
              round(count(*) FILTER (tier <> 'UNIQUE') * 100.0::DOUBLE / greatest(count(*), 1), 1) AS dedup_rate
            FROM tagged""",
            **TAGGED,
        ),
    ),
    Query("dd7_duplicate_edges", _edges, _edges_sql()),
    Query("dd7_edge_report", _report, _report_sql()),
]
