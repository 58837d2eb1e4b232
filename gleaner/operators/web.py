"""Link extraction, frontier expansion and download planning over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.functions import urls as U
from gleaner.operators.skew import MAX_BROADCAST_ROWS, number_rows
from gleaner.session import durable, laid_out, release

# Scripts, styles and comments are no page content; tags are matched outside them.
HIDDEN_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"(?i)<(?:(a)\b[^>]*?\shref|(img)\b[^>]*?\ssrc)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"

# Log line layout of the download tools (some write a level), and how each kind of message starts.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (?:(?:DEBUG|INFO|WARNING|ERROR|CRITICAL) - )?(.*)$"
LOG_EVENTS = {"downloaded": r"^Downloaded:? ", "failed": r"^Failed to download ", "fetch_error": r"^Error fetching "}


def extract_links(pages: DataFrame, media: bool = True) -> DataFrame:
    """(page columns without html, link_no, tag, href) for every anchor and, with ``media``, every image."""
    html = F.regexp_replace("html", HIDDEN_MARKUP, " ")
    tagged = pages.withColumn("html", html).select(
        *[c for c in pages.columns if c != "html"],
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("html", F.lit(TAG), F.lit(1)).alias("anchor"),
                F.regexp_extract_all("html", F.lit(TAG), F.lit(2)).alias("image"),
                F.regexp_extract_all("html", F.lit(TAG), F.lit(3)).alias("raw"),
            )
        ).alias("link_no", "hit"),
    )
    links = tagged.select(
        "*", F.lower(F.concat("hit.anchor", "hit.image")).alias("tag"), U.clean_href(F.col("hit.raw")).alias("href")
    ).drop("hit")
    links = links.filter(F.col("href") != "")
    return links if media else links.filter(F.col("tag") == "a")


def resolve_links(links: DataFrame) -> DataFrame:
    """Absolute target of every link, invalid ones dropped, with canonical form and host."""
    return (
        links.withColumn("target", U.resolve_url(F.col("url"), F.col("href")))
        .filter(U.is_valid_url(F.col("target")))
        .withColumn("canonical", U.canon_url(F.col("target")))
        .withColumn("target_host", U.host(F.col("target")))
    )


def with_file_category(links: DataFrame, coarse: bool = False, whole_url: bool = False) -> DataFrame:
    """Suffix, category and document flag of every target; page links have a NULL category."""
    out = links.withColumn("suffix", U.file_suffix(F.col("target"), whole_url)).withColumn(
        "category", U.file_category(F.col("suffix"), coarse)
    )
    return out.withColumn("is_document", F.col("suffix").isin(U.DOCUMENT_SUFFIXES))


def filter_same_host(links: DataFrame, files_same_host: bool = True) -> DataFrame:
    """Keep links on the page's own host; files on other hosts stay when ``files_same_host`` is off."""
    same = F.col("target_host") == U.host(F.col("url"))
    return links.filter(same if files_same_host else same | F.col("category").isNotNull())


def with_content_class(responses: DataFrame, whole_header: bool = False) -> DataFrame:
    """file, page or other, from the content type: document words in the subtype mean a file."""
    header = F.lower("content_type")
    subject = header if whole_header else F.regexp_extract(header, r"^[^/;]*/([^;\s]*)", 1)
    is_file = subject.rlike("|".join(U.DOCUMENT_SUFFIXES)) | F.contains(header, F.lit("application/pdf"))
    return responses.withColumn(
        "content_class",
        F.when(is_file, "file").when(F.contains(header, F.lit("text/html")), "page").otherwise("other"),
    )


def page_edges(links: DataFrame) -> DataFrame:
    """Distinct (src, dst) canonical page links out of classified links."""
    return (
        links.filter(F.col("category").isNull())
        .select(U.canon_url(F.col("url")).alias("src"), F.col("canonical").alias("dst"))
        .distinct()
    )


#: Seeds that share a row of the search: bits of a long. Links of a page that lie in one slice of the edges.
SEEDS_PER_ROW = 64
LINKS_PER_SLICE = 10_000


def _numbered_seeds(seeds: DataFrame, same_host: bool) -> DataFrame:
    """(seed, host, block, bit): seeds of a host (or all) in blocks of SEEDS_PER_ROW."""
    start = U.canon_url(F.col("url"))
    host = U.host(F.col("seed")) if same_host else F.lit("")
    roots = seeds.select(start.alias("seed")).distinct().withColumn("host", F.coalesce(host, F.lit("")))
    place = F.col("n") - 1
    return number_rows(roots, ["host"], ["seed"], "n").select(
        "seed", "host", F.floor(place / SEEDS_PER_ROW).alias("block"), (place % SEEDS_PER_ROW).cast("int").alias("bit")
    )


def _one_bit(bit: str) -> Column:
    return F.expr(f"shiftleft(1L, {bit})")


def _per_seed(rows: DataFrame) -> DataFrame:
    """One row per seed in place of the bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SEEDS_PER_ROW - 1)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return rows.withColumn("bit", F.explode(bits)).drop("bits")


def _first_pages(fresh: DataFrame, visited: DataFrame, max_pages: int) -> DataFrame:
    """Of each seed the first fresh pages by URL, up to what its pages so far leave of ``max_pages``."""
    seed = ["host", "block", "bit"]
    room = _per_seed(visited).groupBy(*seed).agg((F.lit(max_pages) - F.count(F.lit(1))).alias("room"))
    place = F.row_number().over(W.partitionBy(*seed).orderBy("url"))
    kept = (
        _per_seed(fresh)
        .withColumn("place", place)
        .filter(F.col("place") <= max_pages)
        .join(room, seed)
        .filter(F.col("place") <= F.col("room"))
    )
    return kept.groupBy("url", "host", "block").agg(F.bit_or(_one_bit("bit")).alias("bits"))


def expand_frontier(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = 2,
    max_pages: int | None = None,
    same_host: bool = True,
    links_per_slice: int = LINKS_PER_SLICE,
) -> DataFrame:
    """Pages reached from each seed with their smallest depth: (seed, url, depth).

    ``edges`` is (src, dst) in canonical form, ``seeds`` a column ``url``. All seeds are followed together: a row of the
    search is a page with the seeds that reach it as bits, 64 seeds (of a host, with ``same_host``) to a row, so a level
    shuffles a page once for all of them. The edges are laid out by source once, the links of a page with more than
    ``links_per_slice`` of them in slices; a level moves only the pages it starts from and those it finds. ``max_depth=None``
    runs until nothing new is found. ``max_pages`` keeps the first pages of each seed by (depth, url); every level is
    trimmed to it by a top-k per seed, so a page deep below a full seed is never expanded.
    """
    page = ["url", "host", "block"]
    if same_host:
        # Everything reached so far lies on its seed's host, so the test needs the edge alone.
        edges = edges.filter(U.host(F.col("src")) == U.host(F.col("dst")))
    numbered = durable(_numbered_seeds(seeds, same_host))
    first = numbered.groupBy(F.col("seed").alias("url"), "host", "block").agg(F.bit_or(_one_bit("bit")).alias("bits"))
    frontier = visited = durable(first.withColumn("depth", F.lit(0)))
    edges = durable(edges.select("src", "dst"))
    slices = edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / links_per_slice).cast("int").alias("slices"))
    # At most edges / links_per_slice hubs; broadcast only after counting them.
    hubs = durable(slices.filter("slices > 1"))
    hubs = F.broadcast(hubs) if hubs.count() <= MAX_BROADCAST_ROWS else hubs
    slice_of = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("slices")), F.lit(0)).cast("int")
    sliced = edges.join(hubs, "src", "left").select("src", slice_of.alias("slice"), "dst")
    depth = 0
    with laid_out(sliced, ["src", "slice"]) as links:
        while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
            depth += 1
            places = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1))
            starts = frontier.select(F.col("url").alias("src"), "host", "block", "bits").join(hubs, "src", "left").withColumn("slice", places)
            found = starts.join(links, ["src", "slice"]).groupBy(F.col("dst").alias("url"), "host", "block")
            found = durable(found.agg(F.bit_or("bits").alias("bits")))
            # The few pages found are looked up among all visited ones, which stay where they are.
            seen = visited.join(found.select(*page), page).groupBy(*page).agg(F.bit_or("bits").alias("seen"))
            new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.col("seen"), F.lit(0).cast("long"))))
            fresh = found.join(seen, page, "left").select(*page, new.alias("bits")).filter("bits <> 0")
            if max_pages is not None:
                fresh = _first_pages(fresh, visited, max_pages)
            frontier = durable(fresh.withColumn("depth", F.lit(depth)))
            release(found)
            visited = visited.unionByName(frontier)
            if depth % 8 == 0:
                visited = durable(visited)
    release(edges)
    return _per_seed(visited).join(numbered, ["host", "block", "bit"]).select("seed", "url", "depth")


def file_links(frontier: DataFrame, links: DataFrame, same_host: bool = True) -> DataFrame:
    """Distinct document targets on visited pages over all seeds."""
    documents = links.filter("is_document").select(
        U.canon_url(F.col("url")).alias("page"), "target", "target_host", "suffix", "category"
    )
    reached = frontier.select("seed", F.col("url").alias("page")).join(documents, "page")
    if same_host:
        reached = reached.filter(F.lower("target_host") == U.host(F.col("seed")))
    return reached.select("target", "suffix", "category").distinct()


def download_plan(
    targets: DataFrame, existing: DataFrame | None = None, layout: str = "tree", site_col: str | None = None
) -> DataFrame:
    """One URL (the smallest) per target path, paths already present left out; counts what collided. ``site_col`` names the
    column with the host of the page that links to the target, see ``target_path``."""
    site = F.col(site_col) if site_col else None
    planned = targets.withColumn("target_path", U.target_path(F.col("target"), layout, site))
    plan = planned.groupBy("target_path").agg(
        F.min("target").alias("url"), (F.count(F.lit(1)) - 1).alias("n_collisions")
    )
    return plan if existing is None else plan.join(existing.select("target_path"), "target_path", "left_anti")


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """found, downloaded and failed per host, and in total where host is NULL."""
    done = (F.col("status") == 200) | F.col("already_there")
    return outcomes.rollup("host").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(done).alias("downloaded"),
        F.count_if(~done).alias("failed"),
    )


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Log lines as records: time, event, url, host, detail. Lines in another layout come from ``log_rejects``."""
    line = F.col("line")
    message = F.regexp_extract(line, LOG_LINE, 3)
    logged_at = F.try_to_timestamp(
        F.concat_ws(".", F.regexp_extract(line, LOG_LINE, 1), F.regexp_extract(line, LOG_LINE, 2)),
        F.lit("yyyy-MM-dd HH:mm:ss.SSS"),
    )
    event = F.coalesce(*[F.when(message.rlike(start), name) for name, start in LOG_EVENTS.items()], F.lit("other"))
    # A colon ends the address where a reason follows; "Downloaded <url> -> <path>" leaves the path to ``message``.
    url = F.regexp_replace(F.regexp_extract(message, r"([A-Za-z][A-Za-z0-9+.\-]*://\S+)", 1), ":$", "")
    return lines.filter(line.rlike(LOG_LINE)).select(
        *[c for c in lines.columns if c != "line"],
        logged_at.alias("logged_at"),
        event.alias("event"),
        url.alias("url"),
        U.host(url).alias("host"),
        message.alias("message"),
    )


def log_rejects(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("line").rlike(LOG_LINE))
