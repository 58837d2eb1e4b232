"""Tiered de-duplication of records: same key, same template, near duplicates; plus statistics and edge reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import sqltext as S
from gleaner.operators.neardup import near_dup, pair_similarity
from gleaner.operators.skew import MAX_BROADCAST_ROWS, ROWS_PER_SLICE, join_leaders, join_same, number_rows
from gleaner.session import durable, release

PLACE = ["source_file", "ordinal"]


def dedup_by_key(
    df: DataFrame, key: str, order: list[str], carry: list[str] | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Tag every row with the first row of its key.

    Adds ``is_duplicate``, ``group_size`` and ``survivor`` (a struct of the first row's order columns plus ``carry``).
    The first row comes from a map-side combined minimum, and the join back slices hot keys.
    """
    first = F.struct(*order, *(carry or []))
    leaders = df.groupBy(key).agg(F.min(first).alias("survivor"), F.count(F.lit(1)).alias("group_size"))
    tagged = join_leaders(df, leaders, [key], "group_size", order, rows_per_slice)
    own = F.struct(*order)
    return tagged.withColumn(
        "is_duplicate", own != F.struct(*[F.col("survivor")[c].alias(c) for c in order])
    )


def survivors(tagged: DataFrame) -> DataFrame:
    return tagged.filter(~F.col("is_duplicate")).drop("is_duplicate", "survivor", "group_size")


def exact_tier(statements: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    return dedup_by_key(
        statements, "fingerprint", ["source_file", "ordinal"], ["line_start"], rows_per_slice
    )


def template_tier(statements: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Literal-blind tier; statements that differ only in constants are merged."""
    keyed = statements.withColumn("template", F.sha2(S.template_key(F.col("raw_sql")), 256))
    return dedup_by_key(keyed, "template", ["source_file", "ordinal"], ["line_start"], rows_per_slice)


def dedup(
    statements: DataFrame, threshold: float = 0.95, near: bool = True, bypass: bool = False, metric: str = "jaccard"
) -> DataFrame:
    """All tiers. Every input row comes back once with ``tier`` (UNIQUE, EXACT, NORMALIZED or SEMANTIC) and, for
    duplicates, the surviving statement's file, ordinal and line.

    ``statements`` needs source_file, ordinal, raw_sql, query_type, fingerprint and line_start.
    """
    nothing = {
        "tier": F.lit("UNIQUE"),
        "original_file": F.lit(None).cast("string"),
        "original_ordinal": F.lit(None).cast(statements.schema["ordinal"].dataType),
        "original_line": F.lit(None).cast(statements.schema["line_start"].dataType),
    }
    if bypass:
        return statements.withColumns(nothing)

    def edges(tagged: DataFrame, tier: str) -> DataFrame:
        return tagged.filter("is_duplicate").select(
            *PLACE,
            F.lit(tier).alias("tier"),
            F.col("survivor.source_file").alias("original_file"),
            F.col("survivor.ordinal").alias("original_ordinal"),
            F.col("survivor.line_start").alias("original_line"),
        )

    # Texts stay where they are: the tiers run on places and hashes, near-dup reads the texts of the few template
    # survivors, and the verdicts meet the statements once at the end. Every tier feeds its edges and the next one, so
    # each is cut.
    template = F.sha2(S.template_key(F.col("raw_sql")), 256)
    narrow = durable(statements.select(*PLACE, "line_start", "fingerprint", template.alias("template")))
    first = durable(dedup_by_key(narrow, "fingerprint", PLACE, ["line_start"]))
    second = durable(dedup_by_key(survivors(first), "template", PLACE, ["line_start"]))
    parts = [edges(first, "EXACT"), edges(second, "NORMALIZED")]
    done = [narrow, first, second]
    if near:
        kept = join_same(survivors(second).select(*PLACE), statements.select(*PLACE, "query_type", "raw_sql", "line_start"), PLACE)
        third = durable(near_dup(durable(kept), threshold=threshold, metric=metric, carry=["line_start"]).drop("raw_sql"))
        parts.append(edges(third, "SEMANTIC"))
        done.append(third)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = durable(found)
    for cut in done:
        release(cut)
    verdict = {name: F.coalesce(name, F.lit("UNIQUE")) if name == "tier" else F.col(name) for name in nothing}
    return join_same(statements, found, PLACE, "left").withColumns(verdict)


def dedup_stats(tagged: DataFrame) -> DataFrame:
    """One row of counters over the output of ``dedup``."""
    tier = F.col("tier")
    return tagged.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if(tier == "UNIQUE").alias("total_unique"),
        F.count_if(tier != "UNIQUE").alias("total_duplicates"),
        F.count_if(tier.isin("EXACT", "NORMALIZED")).alias("exact_duplicates"),
        F.count_if(tier == "SEMANTIC").alias("semantic_duplicates"),
    ).withColumn(
        "dedup_rate",
        F.round(F.col("total_duplicates") * 100.0 / F.greatest(F.col("total_input"), F.lit(1)), 1),
    )


def duplicate_edges(tagged: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Flat report: group number, kind, original and duplicate place, preview of the group's first duplicate, and for
    SEMANTIC edges the token similarity of both statements.

    An exact group is one fingerprint; the other tiers form one group per duplicate. All groups are numbered, by range
    partitions; ``max_groups`` keeps the first ones only.
    """
    edges = tagged.filter(F.col("tier") != "UNIQUE").withColumn(
        "tier_order", F.when(F.col("tier") == "EXACT", 1).when(F.col("tier") == "NORMALIZED", 2).otherwise(3)
    )
    edges = edges.withColumn(
        "group_key",
        F.when(F.col("tier") == "EXACT", F.col("fingerprint")).otherwise(
            F.concat_ws(":", "tier", "source_file", "ordinal")
        ),
    )
    first = F.min(F.struct(*PLACE, F.substring("raw_sql", 1, 100).alias("preview")))
    groups = edges.groupBy("tier_order", "group_key").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    flat = groups.select("tier_order", "group_key", "group_size", "first.*")
    numbered = number_rows(flat, [], ["tier_order", *PLACE], "group_no").select("group_no", "group_key", "group_size", "preview")
    if max_groups is not None:
        numbered = numbered.filter(F.col("group_no") <= max_groups)
    semantic = durable(edges.filter("tier = 'SEMANTIC'").select(*PLACE, "original_file", "original_ordinal", "raw_sql"))
    # Only the texts of statements that a semantic duplicate points to are moved.
    wanted = durable(semantic.select("original_file", "original_ordinal").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted
    places = tagged.select(
        F.col("source_file").alias("original_file"), F.col("ordinal").alias("original_ordinal"), F.col("raw_sql").alias("original_sql")
    )
    originals = join_same(places, wanted, ["original_file", "original_ordinal"], "left_semi")
    scored = pair_similarity(join_same(semantic, originals, ["original_file", "original_ordinal"]), "raw_sql", "original_sql", "jaccard")
    narrow = edges.select("group_key", "tier", *PLACE, "line_start", "original_file", "original_line")
    joined = join_leaders(narrow, numbered, ["group_key"], "group_size", PLACE)
    return join_same(joined, scored.select(*PLACE, "similarity"), PLACE, "left").select(
        "group_no",
        F.when(F.col("tier") == "NORMALIZED", "FORMATTING").otherwise(F.col("tier")).alias("duplicate_type"),
        "original_file",
        "original_line",
        F.col("source_file").alias("duplicate_file"),
        F.col("line_start").alias("duplicate_line"),
        F.col("tier").alias("match_type"),
        "preview",
        "similarity",
    )


# The texts of the report.
REPORT_HEAD = ("=" * 80, "DEDUPLICATION REPORT", "=" * 80)
REPORT_COUNTS = {
    "Total queries processed : %d": "total_input",
    "Unique queries retained : %d": "total_unique",
    "Total duplicates removed: %d": "total_duplicates",
    "  - Exact duplicates    : %d": "exact_duplicates",
    "  - Semantic duplicates : %d": "semantic_duplicates",
    "Deduplication rate      : %.1f%%": "dedup_rate",
}


def edge_report_lines(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """The report as text: (group_no, line_no, duplicate_file, duplicate_line, text), to be read in that order. Group 0 is
    the head; a group has its title, original and preview (80 characters, as such reports show) and a line per duplicate."""

    def line(no: int | Column, text: Column) -> Column:
        return F.struct((F.lit(no) if isinstance(no, int) else no).alias("line_no"), text.alias("text"))

    head = [F.lit(x) for x in REPORT_HEAD] + [F.format_string(form, F.col(c)) for form, c in REPORT_COUNTS.items()]
    head += [F.lit(""), F.lit("DUPLICATE GROUPS:"), F.lit("-" * 80)]
    top = stats.select(
        F.lit(0).cast("bigint").alias("group_no"), F.lit(None).cast("string").alias("duplicate_file"), F.lit(None).cast("int").alias("duplicate_line"),
        F.inline(F.array(*[line(i, x) for i, x in enumerate(head)])),
    )
    opening = ["duplicate_type", "original_file", "original_line", "preview"]
    groups = edges.groupBy("group_no").agg(F.min(F.struct(*opening)).alias("g")).select("group_no", "g.*")
    titles = groups.select(
        "group_no", F.lit(None).cast("string").alias("duplicate_file"), F.lit(None).cast("int").alias("duplicate_line"),
        F.inline(
            F.array(
                line(0, F.lit("")),
                line(1, F.format_string("Group #%d (%s)", "group_no", "duplicate_type")),
                line(2, F.format_string("  Original : %s (Line %d)", "original_file", "original_line")),
                line(3, F.concat(F.lit("  Preview  : "), F.substring("preview", 1, 80))),
            )
        ),
    )
    members = edges.select(
        "group_no", "duplicate_file", "duplicate_line", F.lit(4).alias("line_no"),
        F.format_string("  Duplicate: %s (Line %d) [%s]", "duplicate_file", "duplicate_line", "match_type").alias("text"),
    )
    return top.unionByName(titles).unionByName(members).select("group_no", "line_no", "duplicate_file", "duplicate_line", "text")
