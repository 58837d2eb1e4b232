"""Column builders for file paths (``/``-separated)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def top_folder(relative_path: Column) -> Column:
    """First folder below the root; NULL for files that lie in the root itself."""
    return F.when(F.contains(relative_path, F.lit("/")), F.split_part(relative_path, F.lit("/"), F.lit(1)))


def strip_root(path: Column, root: str) -> Column:
    """Path below ``root``; scheme and authority are ignored on both sides."""
    bare_root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    bare_path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(
        F.startswith(bare_path, F.lit(bare_root + "/")), F.substring(bare_path, len(bare_root) + 2, 2**31 - 1)
    )


def has_dir(relative_path: Column, names: list[str], hidden: bool) -> Column:
    """True where a directory segment (never the file name) is one of ``names`` or starts with a dot."""
    alternatives = [re.escape(n) for n in names]
    if hidden:
        alternatives.append(r"\.[^/]*")
    if not alternatives:
        return F.lit(False)
    return relative_path.rlike(r"(^|/)(?:" + "|".join(alternatives) + r")/")


def glob_to_regex(pattern: str) -> str:
    """One ignore rule as a regex: a trailing slash names a directory, otherwise any path segment."""
    directory = pattern.endswith("/")
    body = "".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in pattern.rstrip("/"))
    return rf"(^|/){body}/" if directory else rf"(^|/){body}(/|$)"
