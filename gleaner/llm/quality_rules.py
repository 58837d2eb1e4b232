"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is a column over the whole text; a rule bounds one measure. Nothing is shuffled, joined or run in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.frames import pinned
from gleaner.llm.common import free_name, replaced, words_of

WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as are this was at by an or from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an war "
    "le de la les et des en un une du dans que pour qui est au sur pas avec il elle "
    "el los las del se por con para su al lo como más una no"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``; the rule is asked only from ``from_words`` words on. With ``also``
    it rejects only where one of those (measure, bound) is above its bound too: a weak sign that needs a second one."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    also: tuple[tuple[str, float], ...] = ()


#: The base rules are the first two; the others are the method's own verdict.
BASE_RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeated_windows", "repeat_percent", high=20),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbols_per_word", high=0.25),
    # Good texts in languages that the list does not cover have no stop words of it either.
    Rule("no_stop_words", "stop_word_share", low=0.02, from_words=40, also=(("symbols_per_word", 0.1), ("dup_line_share", 0.3))),
    Rule("duplicate_lines", "dup_line_share", high=0.5),
)


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "repeat_percent", "mean_word_chars",
    "symbols_per_word", "stop_word_share", "dup_line_share", "base_failed", "failed_rules", "kept",
)


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash of each window of ``size`` words, in order; none for shorter texts."""
    n = F.size(words)
    return F.when(
        n >= size,
        F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def twice(sorted_hashes: Column) -> Column:
    """Whether two neighbours of a sorted array are equal."""
    n = F.size(sorted_hashes)
    return (n > 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(sorted_hashes, i) == F.get(sorted_hashes, i - 1)
    )


def covered(hashes: Column, size: int = WINDOW) -> Column:
    """How many word positions lie in windows that occur twice or more. Windows are sorted with their places, so the cost
    is n log n for a text of any length."""

    def with_equals(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(hits, lambda i: F.get(pairs, i)["at"]))

    def total(places: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(places) - 1), lambda k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - F.get(places, k), F.lit(size)))
        )
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    # An array of one element carries an intermediate result, so that it is built once.
    places = F.transform(F.array(pairs), with_equals)
    return F.get(F.transform(places, total), 0)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each whole text. Null text has no words. Columns of these names are replaced."""
    words, hashes, ordered, lines = (free_name(docs, w) for w in ("_words", "_windows", "_sorted", "_lines"))
    source = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumns(
        {
            words: words_of(F.col(text)),
            lines: F.filter(F.split(source, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))),
        }
    )
    # Each step is a column of its own: inside a lambda a whole expression would be evaluated per element.
    staged = staged.withColumn(hashes, window_hashes(F.col(words))).withColumn(ordered, F.sort_array(hashes))
    n = F.size(words).cast("long")
    n_lines = F.size(lines)
    n_dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
    chars = F.char_length(F.array_join(words, "")).cast("long")
    symbols = (F.char_length(source) - F.char_length(F.translate(source, SYMBOLS, ""))).cast("long")
    repeats = F.when(twice(F.col(ordered)), covered(F.col(hashes))).otherwise(0).cast("long")
    # One search in a short line of all stop words, for short words only: an IN list is walked word by word in a lambda.
    longest, line = max(map(len, STOP_WORDS)), F.lit(f" {' '.join(STOP_WORDS)} ")
    stops = F.size(
        F.filter(F.col(words), lambda w: (F.octet_length(w) <= longest + 4) & F.contains(line, F.concat(F.lit(" "), F.lower(w), F.lit(" "))))
    )
    counted = replaced(
        staged,
        {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": repeats, "n_lines": n_lines, "n_stop_words": stops},
    ).drop(words, hashes, ordered, lines)
    safe = F.greatest(F.col("n_words"), F.lit(1))
    return replaced(
        counted,
        {
            "repeat_percent": 100 * F.col("n_repeat_words") / safe,
            "mean_word_chars": F.col("word_chars") / safe,
            "symbols_per_word": F.col("n_symbols") / safe,
            "stop_word_share": F.col("n_stop_words") / safe,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        },
    )


def fails(rule: Rule) -> Column:
    value = F.col(rule.measure)
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (value < rule.low)
    if rule.high is not None:
        broken = broken | (value > rule.high)
    seconds = [F.col(measure) > bound for measure, bound in rule.also] or [F.lit(True)]
    return broken & (F.col("n_words") >= rule.from_words) & reduce(or_, seconds)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """The documents with their measures, base_failed, failed_rules (names, base rules first) and kept.

    Null and empty texts have 0 words and fail the base rules. Repeated rows are judged alike; an empty table stays
    empty; input columns named like a result are replaced, all others are kept.
    """
    measured = with_measures(docs, text)
    named = F.filter(F.array(*[F.when(fails(r), r.name) for r in (*base, *rules)]), lambda x: x.isNotNull())
    judged = replaced(measured, {"base_failed": F.coalesce(F.greatest(F.lit(False), *[fails(r) for r in base]), F.lit(False)), "failed_rules": named})
    judged = replaced(judged, {"kept": F.size("failed_rules") == 0})
    # Pinned: a later filter on a result must not be pushed into the measures, where it would be evaluated per element.
    own = [c for c in judged.columns if c not in docs.columns or c in RESULTS]
    named = judged.withColumnsRenamed({c: f"_rule_{c}" for c in own})
    return pinned(named, {c: F.col(f"_rule_{c}") for c in own}).drop(*[f"_rule_{c}" for c in own])
