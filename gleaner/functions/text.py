"""Column builders for plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(text: Column) -> Column:
    """Strip every kind of white space on both ends (the SQL trim strips blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze_ws(text: Column) -> Column:
    """Runs of white space become one blank, none is left on the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def count_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) + 1


def contains_any(text: Column, words: list[str]) -> Column:
    """True where any of the words occurs, ignoring case; an empty word list accepts everything."""
    if not words:
        return F.lit(True)
    lowered = F.lower(text)
    hit = F.contains(lowered, F.lit(words[0].lower()))
    for word in words[1:]:
        hit = hit | F.contains(lowered, F.lit(word.lower()))
    return hit


def labelled_value(text: Column, label: str) -> Column:
    """First token after ``<label>:``, or an empty string."""
    return F.regexp_extract(text, label + r":\s*(\S+)", 1)


def all_values(text: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches of one regex group."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def join_desc(values: Column, sep: str = ":", numeric: bool = False) -> Column:
    """Values in descending order joined by ``sep``; ``numeric`` compares dotted numbers part by part."""
    if not numeric:
        return F.array_join(F.sort_array(values, asc=False), sep)
    keyed = F.transform(
        values,
        lambda v: F.struct(
            F.transform(F.split(v, r"\."), lambda part: F.coalesce(part.try_cast("bigint"), F.lit(-1))).alias("key"),
            v.alias("value"),
        ),
    )
    return F.array_join(F.transform(F.sort_array(keyed, asc=False), lambda s: s["value"]), sep)


def literal_map(mapping: dict[str, object]) -> Column:
    """A constant map column for a small fixed table."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
