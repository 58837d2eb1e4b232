"""Column builders for URLs: parts, canonical form, resolution, classification, target paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import literal_map, trim_ws

# Generic URI syntax as published in RFC 3986, appendix B: scheme, authority, path, query, fragment.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Document suffixes, and the two suffix-to-category tables.
DOCUMENT_SUFFIXES = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "rtf", "zip"]
CATEGORIES_FINE = {
    "pdf": "PDF",
    "doc": "Word",
    "docx": "Word",
    "xls": "Excel",
    "xlsx": "Excel",
    "ppt": "PowerPoint",
    "pptx": "PowerPoint",
    "txt": "Text",
    "rtf": "Text",
    "zip": "Zip",
    "jpg": "Images",
    "jpeg": "Images",
    "png": "Images",
    "gif": "Images",
    "bmp": "Images",
    "webp": "Images",
}
CATEGORIES_COARSE = {
    "pdf": "Documents",
    "doc": "Documents",
    "docx": "Documents",
    "txt": "Documents",
    "rtf": "Documents",
    "zip": "Documents",
    "xls": "Spreadsheets",
    "xlsx": "Spreadsheets",
    "ppt": "Presentations",
    "pptx": "Presentations",
    "jpg": "Images",
    "jpeg": "Images",
    "png": "Images",
    "gif": "Images",
    "webp": "Images",
}


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, URI, 1)


def host(url: Column) -> Column:
    """Authority as written (case, user info and port are kept)."""
    return F.regexp_extract(url, URI, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URI, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URI, 4)


def is_valid_url(url: Column) -> Column:
    """Scheme and authority are both present."""
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"), F.lit(False))


def canon_url(url: Column) -> Column:
    """Comparison form: lower-case scheme and host, single slashes, no trailing slash, query kept, fragment gone."""
    squeezed = F.regexp_replace(path(url), r"/+", "/")
    trimmed = F.when(F.length(squeezed) > 1, F.regexp_replace(squeezed, r"/$", "")).otherwise(squeezed)
    q = query(url)
    return F.concat(
        F.lower(scheme(url)),
        F.lit("://"),
        F.lower(host(url)),
        trimmed,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
    )


def remove_dots(url_path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments and drop empty inner ones; untouched paths skip the array work."""
    parts = F.split(url_path, "/")
    size = F.size(parts)
    inner = F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == size - 1))
    kept = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(kept, tail), "/")
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(url_path.rlike(r"/\.{1,2}(/|$)|//"), rooted).otherwise(url_path)


def resolve_url(base: Column, ref: Column) -> Column:
    """Reference against base, RFC 3986 section 5."""
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    base_dir = F.regexp_extract(path(base), r"^(.*/)", 1)
    base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
    without_fragment = F.regexp_replace(base, r"#.*$", "")
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_replace(F.regexp_extract(ref, r"^[^?#]*(.*)$", 1), r"#$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme(base), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, remove_dots(ref_path), ref_tail))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, path(base), ref_tail))
        .when(F.startswith(ref, F.lit("#")), F.concat(without_fragment, ref_tail))
        .when(ref == "", base)
        .otherwise(F.concat(origin, remove_dots(F.concat(base_dir, ref_path)), ref_tail))
    )


def unescape_entities(text: Column) -> Column:
    """The five character entities HTML always defines; the ampersand comes last."""
    out = text
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def file_suffix(url: Column, whole_url: bool = False) -> Column:
    """Lower-case suffix without dot: of the path, else right before ``?`` or the end of the URL.

    ``whole_url`` looks only at the end of the URL, so a query string hides the suffix.
    """
    if whole_url:
        return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1))
    on_path = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    pattern = r"(?i)\.(" + "|".join(DOCUMENT_SUFFIXES) + r")(?:$|\?)"
    anywhere = F.lower(F.regexp_extract(url, pattern, 1))
    return F.when(on_path.isin(list(CATEGORIES_FINE)), on_path).when(anywhere != "", anywhere).otherwise(on_path)


def file_category(suffix: Column, coarse: bool = False) -> Column:
    """Display category of a suffix, NULL for page links."""
    return F.element_at(literal_map(CATEGORIES_COARSE if coarse else CATEGORIES_FINE), suffix)


def sanitize_part(part: Column) -> Column:
    return F.regexp_replace(part, r"[^a-zA-Z0-9._-]", "_")


def target_path(url: Column, layout: str = "tree", site: Column | None = None) -> Column:
    """Where a file would be stored.

    ``tree``: second-level host label / sanitised folders / file name;
    ``flat``: host / whole path with separators replaced; ``name``: host / file name. ``site`` is the host of the page
    (or start address) under which ``flat`` and ``name`` keep a file, also one of another host; without it the file's own.
    """
    home = host(url) if site is None else F.lower(site)
    bare = F.regexp_replace(path(url), r"^/+", "")
    if layout == "flat":
        return F.concat(home, F.lit("/"), F.regexp_replace(bare, r'[\\/*?:"<>|]', "_"))
    if layout == "name":
        name = F.regexp_extract(path(url), r"([^/]*)$", 1)
        return F.concat(home, F.lit("/"), F.regexp_replace(name, r'[\\/*?:"<>|]', "_"))
    if layout != "tree":
        raise ValueError(f"unknown layout {layout!r}")
    labels = F.split(host(url), r"\.")
    label = F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(host(url))
    folders = F.regexp_replace(F.regexp_replace(bare, r"/+", "/"), r"/$", "")
    no_path = F.when(query(url) != "", query(url)).otherwise(F.lit("file"))
    below = F.when(folders == "", sanitize_part(no_path)).otherwise(
        F.regexp_replace(folders, r"[^a-zA-Z0-9._/-]", "_")
    )
    return F.concat(sanitize_part(label), F.lit("/"), below)


def clean_href(raw: Column) -> Column:
    """Attribute value without its quotes, entities resolved, trimmed."""
    return trim_ws(unescape_entities(F.regexp_replace(raw, "^[\"']|[\"']$", "")))
