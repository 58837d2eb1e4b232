"""Report sinks: CSV, JSON, text, Parquet, and bundles of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FORMATS = ("parquet", "csv", "json", "text")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line."""
    df.write.mode(mode).json(path)


def as_line(df: DataFrame) -> DataFrame:
    """Every row as one text line: a single string column as is, anything else as JSON."""
    if len(df.columns) == 1 and df.dtypes[0][1] == "string":
        return df.toDF("value")
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """One line per row. ``single_file`` is for small reports: it writes through one task."""
    lines = as_line(df)
    (lines.coalesce(1) if single_file else lines).write.mode(mode).text(path)


def write_reports(
    frames: dict[str, DataFrame], base: str, run_id: str, formats: dict[str, str] | None = None
) -> dict[str, str]:
    """Write the frames that are switched on (all without ``formats``, as Parquet) below ``base/run_id``.

    ``formats`` maps a report name to parquet, csv, json, text or "" for off. Returns name -> path.
    """
    written: dict[str, str] = {}
    for name, frame in frames.items():
        kind = "parquet" if formats is None else formats.get(name, "parquet")
        if not kind:
            continue
        if kind not in FORMATS:
            raise ValueError(f"unknown format {kind!r} for report {name!r}")
        path = f"{base.rstrip('/')}/{run_id}/{name}"
        if kind == "csv":
            write_csv(frame, path)
        elif kind == "json":
            write_json(frame, path)
        elif kind == "text":
            write_lines(frame, path)
        else:
            frame.write.mode("overwrite").parquet(path)
        written[name] = path
    return written


# Frame of the consolidated document.
RULE = "=" * 76
DOCUMENT_TITLE = ("/*", RULE, "  SQL QUERY CONSOLIDATION MASTER DOCUMENT", RULE, "")
DOCUMENT_FACTS = {
    "Files Scanned": "  Files Scanned     : ",
    "Total Queries Found": "  Queries Found     : ",
    "Unique Queries": "  Unique Queries    : ",
    "Duplicates Removed": "  Duplicates Removed: ",
}
DOCUMENT_END = "  END OF MASTER SQL DOCUMENT"
HEAD_SECTION, FOOT_SECTION = 0, 99


def document_frame(run_summary: DataFrame, types: DataFrame, generated_on: str, input_directory: str = "N/A") -> DataFrame:
    """Header and footer of the consolidated document: (section_no 0 or 99, entry_no, value). Counts come from the metric
    rows of ``run_summary`` and from the type distribution, types in falling order."""
    spark = run_summary.sparkSession
    stamps = [f"  Generated On      : {generated_on}", f"  Input Directory   : {input_directory}"]
    fixed = [(HEAD_SECTION, i, line) for i, line in enumerate([*DOCUMENT_TITLE, *stamps])]
    fixed += [(HEAD_SECTION, 100, ""), (HEAD_SECTION, 101, "  QUERY DISTRIBUTION:")]
    fixed += [(HEAD_SECTION, 900 + i, line) for i, line in enumerate(["", RULE, "*/", ""])]
    foot = ["", "/*", RULE, DOCUMENT_END, f"  Generated: {generated_on}", RULE, "*/"]
    fixed += [(FOOT_SECTION, i, line) for i, line in enumerate(foot)]
    lines = spark.createDataFrame(fixed, "section_no int, entry_no long, value string")
    names = list(DOCUMENT_FACTS)
    label = F.create_map(*[F.lit(x) for pair in DOCUMENT_FACTS.items() for x in pair])
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric")) + 50
    facts = run_summary.filter(F.col("metric").isin(names)).select(
        F.lit(HEAD_SECTION).alias("section_no"), place.alias("entry_no"), F.concat(F.element_at(label, F.col("metric")), "value").alias("value")
    )
    # One row per statement type, a fixed alphabet.
    rank = F.row_number().over(W.orderBy(F.desc("n"), "query_type"))
    spread = types.select(
        F.lit(HEAD_SECTION).alias("section_no"), (rank + 101).cast("bigint").alias("entry_no"),
        F.format_string("    %-30s : %d", "query_type", "n").alias("value"),
    )
    return lines.unionByName(facts).unionByName(spread)


def write_consolidated(entries: DataFrame, path: str, mode: str = "overwrite", frame: DataFrame | None = None) -> None:
    """Consolidated listing as text, one folder per section, entries in order, separated by GO. ``frame`` adds the header
    and footer of ``document_frame`` as first and last section."""
    rule = "-" * 80
    box = F.concat_ws(
        "\n",
        F.lit(""),
        F.lit("/" + "=" * 79),
        F.concat(F.lit("||  "), F.rpad(F.upper("category"), 74, " "), F.lit(" ||")),
        F.concat(F.lit("||  Total: "), F.rpad(F.col("section_total").cast("string"), 70, " "), F.lit(" ||")),
        F.lit("=" * 79 + "/"),
    )
    text = F.concat_ws(
        "\n", F.when(F.col("entry_no") == 1, box).otherwise(F.lit("GO")), F.lit(""), F.lit(rule), "header", F.lit(rule), "body", F.lit("")
    )
    listed = entries.select("section_no", F.col("entry_no").cast("bigint").alias("entry_no"), text.alias("value"))
    listed = listed if frame is None else listed.unionByName(frame)
    (
        listed.repartitionByRange("section_no", "entry_no")
        .sortWithinPartitions("section_no", "entry_no")
        .select("section_no", "value")
        .write.mode(mode)
        .partitionBy("section_no")
        .text(path)
    )
