"""End-to-end jobs built from the operators. Each returns lazy frames; only reports are small."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import base_name
from gleaner.functions.urls import canon_url
from gleaner.operators import dedup as D
from gleaner.operators import files as FD
from gleaner.operators import findings as A
from gleaner.operators import statements as ST
from gleaner.operators import web as WB
from gleaner.session import durable, spread
from gleaner.sinks.reports import write_reports
from gleaner.sources.files import (
    DUPLICATE_EXCLUDED_DIRS,
    ScanOptions,
    decode_text,
    filter_extension,
    filter_size,
    list_files,
    prune_dirs,
    scan_failures,
    scan_files,
    scan_metrics,
)


@dataclass
class ConsolidateOptions:
    min_complexity: int = 0
    min_importance: int = 0
    skip_dedup: bool = False
    near: bool = True
    threshold: float = 0.95
    strict: bool = False
    metric: str = "jaccard"


def statement_features(files: DataFrame, options: ConsolidateOptions | None = None) -> DataFrame:
    """Files (source_file, content) to valid statements with lines, features and scores."""
    o = options or ConsolidateOptions()
    statements = ST.extract_statements(files.select("source_file", "content")).drop("extractor")
    found = ST.with_features(ST.filter_valid(statements, o.strict))
    # Scores are never below zero; without a bound they are computed only for those who read them.
    return ST.filter_scores(found, o.min_complexity, o.min_importance) if o.min_complexity > 0 or o.min_importance > 0 else found


#: Reports that only count, and what they and the tiers read of a statement.
COUNTING = {"dedup_stats", "run_summary"}
COUNTED = ["query_type", "has_where", "risk_level", "complexity_score"]
COMPARED = ["source_file", "ordinal", "line_start", "raw_sql", "fingerprint"]


def consolidate(
    files: DataFrame,
    options: ConsolidateOptions | None = None,
    only: set[str] | None = None,
    scanned: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Text corpus to report frames, all or the named ones. The tagged statements are cut once and feed every report; if all
    that is wanted are counts, only the columns they need are made, moved and written.
    ``scanned`` is the row of ``scan_metrics`` that the run summary quotes."""
    o = options or ConsolidateOptions()
    counts = only is not None and only <= COUNTING
    features = statement_features(files, o)
    found = durable(features.select(*COMPARED, *COUNTED) if counts else features)
    tagged = D.dedup(found, threshold=o.threshold, near=o.near, bypass=o.skip_dedup, metric=o.metric)
    tagged = durable(tagged.select("tier", *COUNTED) if counts else tagged)
    unique = tagged.filter("tier = 'UNIQUE'")
    stats = D.dedup_stats(tagged)
    reports: dict[str, Callable[[], DataFrame]] = {
        "statements": lambda: unique,
        "dedup_stats": lambda: stats,
        "duplicate_edges": lambda: D.duplicate_edges(tagged),
        "edge_report": lambda: D.edge_report_lines(stats, D.duplicate_edges(tagged)),
        "type_distribution": lambda: A.type_distribution(unique),
        "risk_summary": lambda: A.risk_summary(unique),
        "high_risk": lambda: A.high_risk(unique),
        "top_complexity": lambda: A.top_by(unique, "complexity_score", 20),
        "top_importance": lambda: A.top_by(unique, "importance_score", 50),
        "table_ranks": lambda: A.table_ranks(unique),
        "findings": lambda: A.findings(unique),
        "summary": lambda: A.summary_lines(unique),
        "run_summary": lambda: A.run_summary(stats, unique, scanned),
        "listing": lambda: A.listing(unique),
        "consolidated": lambda: A.consolidated(unique),
    }
    return {name: build() for name, build in reports.items() if only is None or name in only}


def consolidate_tree(
    spark: SparkSession,
    roots: list[str] | str,
    output: str,
    run_id: str,
    scan: ScanOptions | None = None,
    options: ConsolidateOptions | None = None,
    formats: dict[str, str] | None = None,
) -> dict[str, str]:
    """Scan trees, consolidate, write the reports, with the scan's metrics and its failures; no files give these alone."""
    scan = scan or ScanOptions()
    chosen = prune_dirs(
        filter_extension(list_files(spark, roots), scan.extensions, scan.exclude_extensions), scan.exclude_dirs, scan.drop_hidden
    )
    metrics = durable(scan_metrics(decode_text(filter_size(chosen, scan.max_bytes)).drop("raw"), scan.keywords))
    frames = {"scan_metrics": metrics, "failures": scan_failures(chosen, scan.max_bytes)}
    files = scan_files(spark, roots, scan).withColumn("source_file", F.col("path"))
    if not files.isEmpty():
        frames |= consolidate(files, options, scanned=metrics)
    return write_reports(frames, output, run_id, formats)


def find_duplicate_files(
    spark: SparkSession,
    roots: list[str] | str,
    key: str = "name",
    exclude_dirs: list[str] | None = None,
    algorithm: str = "sha256",
    skip_unreadable: bool = False,
) -> DataFrame:
    """Identical files below the roots as flat report rows; only the candidates are opened, and once. Candidates that
    cannot be read raise an error, or are left out with ``skip_unreadable``."""
    listed = prune_dirs(list_files(spark, roots, contents=False), exclude_dirs or DUPLICATE_EXCLUDED_DIRS, drop_hidden=False)
    files = listed.select("path", base_name(F.col("path")).alias("name"), "size")
    hashed = durable(FD.hash_paths(spread(FD.candidate_files(files, key), force=True), algorithm))
    if not skip_unreadable and (bad := hashed.filter("hash is null").limit(3).collect()):
        raise OSError("; ".join(f"{r['path']}: {r['error']}" for r in bad))
    return FD.duplicate_members(hashed, ["name", "size"] if key == "name" else ["size"])


def plan_downloads(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = 2,
    max_pages: int | None = None,
    existing: DataFrame | None = None,
    layout: str = "tree",
) -> DataFrame:
    """Fetched pages (url, html) and seed URLs to a plan of document downloads.

    With a ``content_type`` column only HTML responses are parsed, and reached URLs that served a file are documents too.
    """
    served = None
    if "content_type" in pages.columns:
        typed = WB.with_content_class(pages)
        served = typed.filter("content_class = 'file'").select(canon_url(F.col("url")).alias("page"), "url")
        pages = typed.filter("content_class = 'page'").drop("content_type", "content_class")
    links = durable(WB.with_file_category(WB.resolve_links(WB.extract_links(pages))))
    frontier = WB.expand_frontier(durable(WB.page_edges(links)), seeds, max_depth, max_pages)
    targets = WB.file_links(frontier, links).select("target")
    if served is not None:
        reached = frontier.select(F.col("url").alias("page")).distinct()
        targets = targets.unionByName(served.join(reached, "page").select(F.col("url").alias("target"))).distinct()
    return WB.download_plan(targets, existing, layout)
