"""Registered queries over lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.functions.text import trim_ws
from gleaner.operators import language as LG
from gleaner.operators import lines as TX

_MARK = r"'^(\d{1,3})[.)]\s*(.*)$'"
_MARKED = f"""SELECT doc_id, line_no, line,
  CASE WHEN regexp_matches(line, {_MARK}) THEN regexp_extract(line, {_MARK}, 1) END AS marker,
  CASE WHEN regexp_matches(line, {_MARK}) THEN regexp_extract(line, {_MARK}, 2) ELSE line END AS rest FROM trimmed"""
_CARRIED = """SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS number FROM marked"""


def _votes() -> str:
    words = r"regexp_split_to_array(lower(rest), '[^\p{L}]+')"
    out = []
    for lang, vocabulary in TX.STOP_WORDS.items():
        listed = ", ".join(f"'{w}'" for w in vocabulary)
        out.append(f"len(list_filter({words}, lambda w: w IN ({listed}))) AS {lang}")
    return "SELECT *, " + ", ".join(out) + " FROM carried"


_LANG = """SELECT *, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en'
  WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS line_lang
  FROM votes"""
CTES = {
    "f5": "f5",
    "trimmed": f"SELECT doc_id, line_no, {D.trim_ws('line')} AS line FROM f5",
    "marked": _MARKED,
    "carried": _CARRIED,
    "votes": _votes(),
    "judged": _LANG,
}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "f5").withColumn("line", trim_ws(F.col("line")))


def _carried(spark: SparkSession, d: str) -> DataFrame:
    return TX.carry_marker(TX.with_marker(_lines(spark, d)))


def _gram_rows(source: str, keys: str, text: str) -> str:
    """(keys, gram) for every three characters of the words; a text without any has no rows."""
    return rf"""SELECT {keys}, c[i] || c[i + 1] || c[i + 2] AS gram FROM (SELECT {keys}, c, unnest(range(1, len(c) - 1)) AS i
      FROM (SELECT {keys}, string_split(' ' || trim(regexp_replace(lower({text}), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM {source}))"""


_WEIGHT = "floor(1000 * ln(({n} + 0.5) / (total + 0.5 * (SELECT count(DISTINCT gram) FROM counted))))::BIGINT"
GRAMS = {
    **{name: CTES[name] for name in ("f5", "trimmed", "marked")},
    "learnt": _gram_rows("documents", "lang", "text"),
    "counted": "SELECT lang, gram, count(*) AS n FROM learnt WHERE lang IS NOT NULL GROUP BY ALL",
    "totals": f"SELECT lang, {_WEIGHT.format(n=0)} AS unknown, total FROM (SELECT lang, sum(n)::BIGINT AS total FROM counted GROUP BY lang)",
    "gains": f"SELECT lang, gram, {_WEIGHT.format(n='n')} - unknown AS gain FROM counted JOIN totals USING (lang)",
    "asked": _gram_rows("marked", "doc_id, line_no", "rest"),
    "sizes": "SELECT doc_id, line_no, count(*) AS n FROM asked GROUP BY ALL",
    "sums": "SELECT doc_id, line_no, lang, sum(gain)::BIGINT AS gain FROM asked JOIN gains USING (gram) GROUP BY ALL",
    "scores": """SELECT p.doc_id, p.line_no, p.lang, n * unknown + coalesce(gain, 0) AS score
      FROM (SELECT doc_id, line_no, n, lang, unknown FROM sizes, totals) p LEFT JOIN sums s
      ON p.doc_id = s.doc_id AND p.line_no = s.line_no AND p.lang = s.lang""",
    "best": """SELECT doc_id, line_no, lang FROM scores
      QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, lang) = 1""",
}


def _line_languages(spark: SparkSession, d: str) -> DataFrame:
    model = LG.learn_languages(table(spark, d, "documents"))
    return LG.text_language(TX.with_marker(_lines(spark, d)), ["doc_id", "line_no"], model, "rest")


QUERIES = [
    Query(
        "tx4_line_language_by_grams",
        _line_languages,
        oracle("SELECT doc_id, line_no, lang FROM marked LEFT JOIN best USING (doc_id, line_no)", **GRAMS),
    ),
    Query(
        "tx1_explode_lines",
        lambda s, d: TX.explode_lines(table(s, d, "documents")),
        oracle(
            f"""SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no,
              {D.trim_ws('unnest(string_split(text, chr(10)))')} AS line FROM documents"""
        ),
    ),
    Query(
        "tx2_marker",
        lambda s, d: TX.with_marker(_lines(s, d)).select("doc_id", "line_no", "marker", "rest"),
        oracle("SELECT doc_id, line_no, marker, rest FROM marked", **CTES),
    ),
    Query(
        "tx3_carry_marker",
        lambda s, d: _carried(s, d).select("doc_id", "line_no", "number"),
        oracle("SELECT doc_id, line_no, number FROM carried", **CTES),
    ),
    Query(
        "tx4_line_language",
        lambda s, d: TX.with_line_lang(TX.with_marker(_lines(s, d))).select("doc_id", "line_no", "line_lang"),
        oracle("SELECT doc_id, line_no, line_lang FROM judged", **CTES),
    ),
    Query(
        "tx5_label_lines",
        lambda s, d: TX.label_lines(TX.with_line_lang(_carried(s, d))),
        oracle(
            """SELECT doc_id, line_no, CASE WHEN number IS NOT NULL THEN number || '. ' || rest ELSE rest END AS label
              FROM judged WHERE line_lang = 'en'""",
            **CTES,
        ),
    ),
]
