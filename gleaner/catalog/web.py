"""Registered queries over pages, links, frontiers and download plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.functions import urls as U
from gleaner.operators import web as WB
from gleaner.session import durable

_URI = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {_URI}, {group})"


def _canon(url: str) -> str:
    squeezed = f"regexp_replace({_part(url, 3)}, '/+', '/', 'g')"
    trimmed = f"CASE WHEN length({squeezed}) > 1 THEN regexp_replace({squeezed}, '/$', '') ELSE {squeezed} END"
    q = _part(url, 4)
    return (
        f"concat(lower({_part(url, 1)}), '://', lower({_part(url, 2)}), {trimmed}, "
        f"CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"
    )


_TAG = r"""'(?i)<(?:(a)\b[^>]*?\shref|(img)\b[^>]*?\ssrc)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
_BARE = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"


def _clean(raw: str) -> str:
    out = f"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')"""
    for entity, char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return D.trim_ws(out)


def _links(source: str) -> str:
    return f"""SELECT page_id, url, link_no, lower(tag) AS tag, {_clean('raw')} AS href FROM (
      SELECT page_id, url, (generate_subscripts(regexp_extract_all(bare, {_TAG}, 1), 1) - 1)::INT AS link_no,
        concat(unnest(regexp_extract_all(bare, {_TAG}, 1)), unnest(regexp_extract_all(bare, {_TAG}, 2))) AS tag,
        unnest(regexp_extract_all(bare, {_TAG}, 3)) AS raw
      FROM (SELECT page_id, url, {_BARE} AS bare FROM {source})) WHERE {_clean('raw')} <> ''"""


# Relative references of the sites are at most one parent segment deep, which one replacement resolves.
_ORIGIN = f"{_part('url', 1)} || '://' || {_part('url', 2)}"
_DIR = f"regexp_extract({_part('url', 3)}, '^(.*/)', 1)"
_JOINED = f"regexp_replace({_DIR} || regexp_extract(href, '^([^?#]*)', 1), '/[^/]+/\\.\\./', '/')"
_RESOLVED = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
  WHEN starts_with(href, '//') THEN {_part('url', 1)} || ':' || href
  WHEN starts_with(href, '/') THEN {_ORIGIN} || href
  WHEN starts_with(href, '?') THEN {_ORIGIN} || {_part('url', 3)} || href
  WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
  ELSE {_ORIGIN} || {_JOINED} || regexp_extract(href, '^[^?#]*(.*)$', 1) END"""
_ABSOLUTE = f"SELECT *, {_RESOLVED} AS target FROM links"
_TARGETS = f"""SELECT *, {_canon('target')} AS canonical, {_part('target', 2)} AS target_host,
  lower(regexp_extract({_part('target', 3)}, '\\.([A-Za-z0-9]+)$', 1)) AS on_path,
  lower(regexp_extract(target, '(?i)\\.(pdf|doc|docx|ppt|pptx|xls|xlsx|txt|rtf|zip)(?:$|\\?)', 1)) AS anywhere
  FROM absolute WHERE regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]')"""
_KINDS = ", ".join(f"('{suffix}', '{category}')" for suffix, category in U.CATEGORIES_FINE.items())
_CLASSED = f"""SELECT t.*, k.category, t.suffix IN ('pdf', 'doc', 'docx', 'ppt', 'pptx', 'xls', 'xlsx', 'txt', 'rtf',
    'zip') AS is_document FROM (SELECT *, CASE WHEN on_path IN (SELECT suffix FROM kinds) THEN on_path
    WHEN anywhere <> '' THEN anywhere ELSE on_path END AS suffix FROM targets) t LEFT JOIN kinds k ON k.suffix = t.suffix"""
_EDGES = f"SELECT DISTINCT {_canon('url')} AS src, canonical AS dst FROM classed WHERE category IS NULL"
LINKS = {"sites": "sites", "links": _links("sites"), "absolute": _ABSOLUTE}
CLASSED = {
    **LINKS,
    "targets": _TARGETS,
    "kinds": f"SELECT * FROM (VALUES {_KINDS}) v(suffix, category)",
    "classed": _CLASSED,
}
_HOST = "regexp_extract({u}, '^[^:]*://([^/?#]*)', 1)"


def _walk(max_depth: int) -> str:
    return f"""SELECT {_canon('url')} AS seed, {_canon('url')} AS url, 0 AS depth FROM sites WHERE ends_with(url, '/p/0.html')
      UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url
      WHERE w.depth < {max_depth} AND {_HOST.format(u='e.dst')} = {_HOST.format(u='w.seed')}"""


_MIN = "SELECT seed, url, min(depth)::INT AS depth FROM walk GROUP BY ALL"
DEPTH, DEEP = 2, 12
GRAPH = {**CLASSED, "edges": _EDGES, "walk": _walk(DEPTH), "reached": _MIN}
DEEP_GRAPH = {**CLASSED, "edges": _EDGES, "walk": _walk(DEEP), "reached": _MIN}
_FOUND = """SELECT DISTINCT c.target, c.suffix, c.category FROM reached r JOIN classed c ON r.url = {page}
  WHERE c.is_document AND lower(c.target_host) = {host}""".format(page=_canon("c.url"), host=_HOST.format(u="r.seed"))


def _recursive(select: str, **ctes: str) -> str:
    return oracle(select, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def links(spark: SparkSession, d: str) -> DataFrame:
    return WB.extract_links(fixture(spark, d, "sites"))


def classed(spark: SparkSession, d: str) -> DataFrame:
    return WB.with_file_category(WB.resolve_links(links(spark, d)))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The home page of every site."""
    return fixture(spark, d, "sites").filter(F.endswith("url", F.lit("/p/0.html"))).select("url")


def frontier(spark: SparkSession, d: str, max_depth: int | None = DEPTH, max_pages: int | None = None):
    edges = durable(WB.page_edges(classed(spark, d)))
    return WB.expand_frontier(edges, _seeds(spark, d), max_depth, max_pages)


def _found(spark: SparkSession, d: str) -> DataFrame:
    rows = durable(classed(spark, d))
    reached = WB.expand_frontier(WB.page_edges(rows), _seeds(spark, d), DEPTH)
    return WB.file_links(reached, rows)


def _sanitized(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9._-]', '_', 'g')"


def _target_path(url: str, layout: str) -> str:
    bare = f"regexp_replace({_part(url, 3)}, '^/+', '')"
    unsafe = r"'[\\/*?:\"<>|]'"
    if layout == "flat":
        return f"{_part(url, 2)} || '/' || regexp_replace({bare}, {unsafe}, '_', 'g')"
    if layout == "name":
        return f"{_part(url, 2)} || '/' || regexp_replace(regexp_extract({_part(url, 3)}, '([^/]*)$', 1), {unsafe}, '_', 'g')"
    labels = f"string_split({_part(url, 2)}, '.')"
    label = f"CASE WHEN len({labels}) >= 2 THEN {labels}[len({labels}) - 1] ELSE {_part(url, 2)} END"
    parts = f"list_filter(string_split({bare}, '/'), lambda p: p <> '')"
    none = f"CASE WHEN {_part(url, 4)} <> '' THEN {_part(url, 4)} ELSE 'file' END"
    clean = f"list_transform({parts}, lambda p: {_sanitized('p')})"
    return (
        f"{_sanitized(label)} || '/' || CASE WHEN len({parts}) = 0 THEN {_sanitized(none)} "
        f"ELSE array_to_string({clean}, '/') END"
    )


_URLS = "SELECT DISTINCT target FROM absolute UNION SELECT url FROM pages"
TARGET_LIST = {**LINKS, "urls": _URLS}


def _urls(spark: SparkSession, d: str) -> DataFrame:
    absolute = links(spark, d).select(U.resolve_url(F.col("url"), F.col("href")).alias("target"))
    return absolute.union(table(spark, d, "pages").select("url")).distinct()


_HEADERS = """CASE page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png'
  WHEN 3 THEN 'Application/ZIP' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  ELSE 'text/plain' END"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(_HEADERS).alias("content_type"))


_LINE = r"'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (?:(?:DEBUG|INFO|WARNING|ERROR|CRITICAL) - )?(.*)$'"
_MSG = f"regexp_extract(line, {_LINE}, 3)"
_EVENT = f"""CASE WHEN starts_with({_MSG}, 'Downloaded: ') OR starts_with({_MSG}, 'Downloaded ') THEN 'downloaded'
  WHEN starts_with({_MSG}, 'Failed to download ') THEN 'failed'
  WHEN starts_with({_MSG}, 'Error fetching ') THEN 'fetch_error' ELSE 'other' END"""
_PARSED = f"""SELECT event_id, strptime(regexp_extract(line, {_LINE}, 1) || '.' || regexp_extract(line, {_LINE}, 2),
    '%Y-%m-%d %H:%M:%S.%g') AS logged_at, {_EVENT} AS event,
  regexp_replace(regexp_extract({_MSG}, '([A-Za-z][A-Za-z0-9+.\\-]*://\\S+)', 1), ':$', '') AS url, {_MSG} AS message
  FROM f8 WHERE regexp_matches(line, {_LINE})"""
LOG = {"f8": "f8", "parsed": _PARSED, "hosted": f"SELECT *, {_part('url', 2)} AS host FROM parsed"}


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    parsed = WB.parse_run_log(fixture(spark, d, "f8")).filter("event IN ('downloaded', 'failed')")
    return parsed.select(
        "host",
        F.when(F.col("event") == "downloaded", 200).otherwise(404).alias("status"),
        F.lit(False).alias("already_there"),
    )


QUERIES = [
    Query(
        "wb1_extract_links",
        lambda s, d: links(s, d).select("page_id", "link_no", "tag", "href"),
        oracle("SELECT page_id, link_no, tag, href FROM links", **LINKS),
    ),
    Query(
        "wb1_extract_links_raw_pages",
        lambda s, d: WB.extract_links(table(s, d, "pages"), media=False).select("page_id", "link_no", "href"),
        oracle("SELECT page_id, link_no, href FROM links WHERE tag = 'a'", links=_links("pages")),
    ),
    Query(
        "wb2_resolve_url",
        lambda s, d: links(s, d).select(
            "page_id", "link_no", U.resolve_url(F.col("url"), F.col("href")).alias("target")
        ),
        oracle("SELECT page_id, link_no, target FROM absolute", **LINKS),
    ),
    Query(
        "wb3_valid_url",
        lambda s, d: links(s, d).select("page_id", "link_no", U.is_valid_url(F.col("href")).alias("valid")),
        oracle(
            "SELECT page_id, link_no, regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]') AS valid FROM links",
            **LINKS,
        ),
    ),
    Query(
        "wb4_canonical_url",
        lambda s, d: _urls(s, d).select("target", U.canon_url(F.col("target")).alias("canonical")),
        oracle(f"SELECT target, {_canon('target')} AS canonical FROM urls", **TARGET_LIST),
    ),
    Query(
        "wb5_same_host",
        lambda s, d: WB.filter_same_host(classed(s, d), files_same_host=False).select("page_id", "link_no", "target"),
        oracle(
            f"""SELECT page_id, link_no, target FROM classed WHERE target_host = {_part('url', 2)}
              OR category IS NOT NULL""",
            **CLASSED,
        ),
    ),
    Query(
        "wb6_file_category",
        lambda s, d: classed(s, d).select("page_id", "link_no", "suffix", "category", "is_document"),
        oracle("SELECT page_id, link_no, suffix, category, is_document FROM classed", **CLASSED),
    ),
    Query(
        "wb7_content_class",
        lambda s, d: WB.with_content_class(_responses(s, d)),
        oracle(
            f"""SELECT page_id, content_type, CASE
              WHEN regexp_matches(regexp_extract(lower(content_type), '^[^/;]*/([^;\\s]*)', 1), 'pdf|doc|ppt|xls|txt|rtf|zip')
                THEN 'file' WHEN contains(lower(content_type), 'text/html') THEN 'page' ELSE 'other' END AS content_class
              FROM (SELECT page_id, {_HEADERS} AS content_type FROM pages)"""
        ),
    ),
    Query("wb8_frontier", frontier, _recursive("SELECT seed, url, depth FROM reached", **GRAPH)),
    Query(
        "wb8_frontier_page_cap",
        lambda s, d: frontier(s, d, DEEP, 10),
        _recursive(
            "SELECT seed, url, depth FROM reached QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, url) <= 10",
            **DEEP_GRAPH,
        ),
    ),
    Query(
        "wb9_frontier_fixpoint",
        lambda s, d: frontier(s, d, None, None),
        _recursive("SELECT seed, url, depth FROM reached", **DEEP_GRAPH),
    ),
    Query("wb10_file_links", _found, _recursive(_FOUND, **GRAPH)),
    *[
        Query(
            f"wb11_target_path_{layout}",
            lambda s, d, layout=layout: _urls(s, d).select("target", U.target_path(F.col("target"), layout).alias("path")),
            oracle(f"SELECT target, {_target_path('target', layout)} AS path FROM urls", **TARGET_LIST),
        )
        for layout in ("tree", "flat", "name")
    ],
    Query(
        "wb12_download_plan",
        lambda s, d: WB.download_plan(classed(s, d).filter("is_document"), layout="name"),
        oracle(
            f"""SELECT {_target_path('target', 'name')} AS target_path, min(target) AS url, count(*) - 1 AS n_collisions
              FROM classed WHERE is_document GROUP BY 1""",
            **CLASSED,
        ),
    ),
    Query(
        "wb13_outcome_rollup",
        lambda s, d: WB.outcome_rollup(_outcomes(s, d)),
        oracle(
            """SELECT host, count(*) AS found, count(*) FILTER (event = 'downloaded') AS downloaded,
              count(*) FILTER (event = 'failed') AS failed FROM hosted WHERE event IN ('downloaded', 'failed')
              GROUP BY ROLLUP (host)""",
            **LOG,
        ),
    ),
    Query(
        "wb14_run_log",
        lambda s, d: WB.parse_run_log(fixture(s, d, "f8")).withColumn(
            "logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss.SSS")
        ),
        oracle(
            """SELECT event_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S.%g') AS logged_at, event, url, host, message
              FROM hosted""",
            **LOG,
        ),
    ),
    Query(
        "wb14_log_rejects",
        lambda s, d: WB.log_rejects(fixture(s, d, "f8")),
        oracle(f"SELECT event_id, line FROM f8 WHERE NOT regexp_matches(line, {_LINE})", f8="f8"),
    ),
]
