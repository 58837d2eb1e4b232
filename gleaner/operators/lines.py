"""Lines of documents: explode, number markers, carry-forward, language, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.functions.text import trim_ws
from gleaner.operators.skew import join_same

MARKER = r"^(\d{1,3})[.)]\s*(.*)$"
LINES_PER_BLOCK = 65536

# Frequent words that vote for a language; a word may vote for several.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "is", "that", "with", "by", "for", "was", "are", "this"],
    "fr": ["le", "la", "les", "des", "du", "et", "une", "est", "dans", "pour", "avec", "qui"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "von", "auf", "den"],
    "es": ["el", "los", "las", "que", "por", "con", "una", "para", "del", "como", "su", "y"],
}


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 1, trimmed line)."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")
    ).select("doc_id", (F.col("line_no") + 1).alias("line_no"), trim_ws(F.col("line")).alias("line"))


def with_marker(lines: DataFrame) -> DataFrame:
    """Leading number of one to three digits before ``.`` or ``)`` and the rest; number is NULL without one."""
    marked = F.col("line").rlike(MARKER)
    return lines.withColumn("marker", F.when(marked, F.regexp_extract("line", MARKER, 1))).withColumn(
        "rest", F.when(marked, F.regexp_extract("line", MARKER, 2)).otherwise(F.col("line"))
    )


def carry_marker(lines: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Each line's own marker or the last one above it in the document, as ``number``.

    A document is worked in blocks of lines: a window inside each block, and the last marker of the blocks before it
    from a small per-block table. No task holds more lines than a block, however long the document is.
    """
    blocks = lines.withColumn("_block", F.floor(F.col("line_no") / lines_per_block))
    ends = blocks.groupBy("doc_id", "_block").agg(
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("_end")
    )
    above = W.partitionBy("doc_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("doc_id", "_block", F.last("_end", ignorenulls=True).over(above).alias("_above"))
    inside = W.partitionBy("doc_id", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return (
        join_same(blocks.withColumn("_inside", F.last("marker", ignorenulls=True).over(inside)), carried, ["doc_id", "_block"])
        .withColumn("number", F.coalesce("_inside", "_above"))
        .drop("_block", "_inside", "_above")
    )


def line_language(text: Column, stop_words: dict[str, list[str]] | None = None) -> Column:
    """Language with the most stop words in the line (ties: first in the table), NULL without any."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def vote(place: int, lang: str, vocabulary: list[str]) -> Column:
        hits = F.filter(words, lambda w: w.isin(vocabulary))
        return F.struct(F.size(hits).alias("n"), F.lit(-place).alias("rank"), F.lit(lang).alias("lang"))

    votes = [vote(i, lang, vocabulary) for i, (lang, vocabulary) in enumerate((stop_words or STOP_WORDS).items())]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["lang"])


def with_line_lang(lines: DataFrame, stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    return lines.withColumn("line_lang", line_language(F.col("rest"), stop_words))


def label_lines(lines: DataFrame, lang: str | None = "en") -> DataFrame:
    """``<number>. <text>`` for the lines in one language, plain text before the first number; run after carry."""
    kept = lines if lang is None else lines.filter(F.col("line_lang") == lang)
    label = F.when(F.col("number").isNotNull(), F.concat_ws(". ", "number", "rest")).otherwise(F.col("rest"))
    return kept.select("doc_id", "line_no", label.alias("label"))
