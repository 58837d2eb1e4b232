"""Language of texts by letter n-grams, counted from texts whose language is known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import MAX_BROADCAST_ROWS
from gleaner.session import durable

GRAM = 3
#: Added to every count, and the unit of the logarithms: weights are whole numbers, so sums have no order.
SMOOTHING, UNIT = 0.5, 1000


def grams(text: Column) -> Column:
    """All runs of three characters of the words in lower case, with a blank around each word; overlapping."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit("(?=(" + "." * GRAM + "))"), F.lit(1))


@dataclass(frozen=True)
class LanguageModel:
    """``gains`` is (gram, gain: map of languages to whole numbers), what a gram adds above an unknown one; ``unknown`` what that
    adds for each language, in order of languages."""

    gains: DataFrame
    unknown: dict[str, int]


def learn_languages(texts: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over all rows that name a language. The driver gets one row per language."""
    named = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(grams(F.col(text))).alias("gram"))
    counts = durable(named.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.select("gram").distinct().count()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    weight = lambda n, total: F.floor(UNIT * F.log((n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * distinct))))
    rows = texts.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")
    rows = rows.withColumn("unknown", weight(F.lit(0), F.col("total")))
    gains = counts.join(F.broadcast(rows), "lang").withColumn("gain", weight(F.col("n"), F.col("total")) - F.col("unknown"))
    by_gram = gains.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("gain"))
    return LanguageModel(durable(by_gram), {r["lang"]: r["unknown"] for r in rows.orderBy("lang").collect()})


def text_language(texts: DataFrame, keys: list[str], model: LanguageModel, text: str = "text") -> DataFrame:
    """(keys, lang) of every key: the language under which its text is likeliest, of equal ones the first by name; NULL for a
    text without letters. One join with the model, which is broadcast up to a counted size, and one sum per language."""
    if not model.unknown:
        return texts.select(*keys, F.lit(None).cast("string").alias("lang")).distinct()
    gains = F.broadcast(model.gains) if model.gains.count() <= MAX_BROADCAST_ROWS else model.gains
    met = texts.select(*keys, F.explode_outer(grams(F.col(text))).alias("gram")).join(gains, "gram", "left")
    totals = [F.coalesce(F.sum(F.col("gain")[lang]), F.lit(0)).alias(f"_g{i}") for i, lang in enumerate(model.unknown)]
    summed = met.groupBy(*keys).agg(F.count("gram").alias("_n"), *totals)
    scored = F.array(
        *[
            F.struct((F.col(f"_g{i}") + F.col("_n") * unknown).alias("score"), F.lit(-i).alias("place"), F.lit(lang).alias("lang"))
            for i, (lang, unknown) in enumerate(model.unknown.items())
        ]
    )
    return summed.select(*keys, F.when(F.col("_n") > 0, F.array_max(scored)["lang"]).alias("lang"))
