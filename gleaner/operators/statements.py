"""Statements out of a text corpus: extraction, classification, features, scores.

File frames carry ``source_file`` and ``content``; statement frames carry ``source_file``, ``ordinal`` (position inside
the file) and ``raw_sql``. ``(source_file, ordinal)`` is the total order every "first" refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.functions import sqltext as S
from gleaner.functions.frames import pinned
from gleaner.functions.text import count_lines, literal_map, trim_ws
from gleaner.session import durable, release


def _is_statement(sql: Column) -> Column:
    return (
        (F.length(sql) >= S.MIN_LENGTH) & ~S.is_comment_only(sql) & (S.statement_type(sql) != "UNKNOWN")
    )


def _starts(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*(?:" + "|".join(S.LINE_STARTERS) + r")\b")


def _closes(line: Column) -> Column:
    return F.contains(line, F.lit(";")) | line.rlike(r"^\s*$")


def _with_starts(pieces: DataFrame, counts: Column | None = None) -> DataFrame:
    """``start``: place of the first piece of the statement that a piece (``pos``, ``unit``) of a file belongs to.

    A running sum of opened and closed blocks, kept from falling below zero, gives the depth behind every piece; a statement
    ends where it is zero. A block that nothing closes is none: behind the last piece at depth zero every piece ends a
    statement. ``counts`` tells which rows are pieces at all. A file's pieces are one text value exploded, hence a window
    per file holds no more than that value did.
    """
    ordered = W.partitionBy("source_file").orderBy("pos")
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    change = S.block_change(F.col("unit"))
    summed = pieces.withColumn("_change", change if counts is None else F.when(counts, change).otherwise(F.lit(0)))
    summed = summed.withColumn("_sum", F.sum("_change").over(so_far))
    deep = summed.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(so_far), F.lit(0)))
    closed = F.max(F.when(F.col("_depth") == 0, F.col("pos"))).over(W.partitionBy("source_file"))
    ends = (F.col("_depth") == 0) | (F.col("pos") > F.coalesce(closed, F.lit(-1)))
    marked = deep.withColumn("_ends", ends)
    first = F.coalesce(F.lag("_ends").over(ordered), F.lit(True))
    return (
        marked.withColumn("_first", first)
        .withColumn("start", F.max(F.when(F.col("_first"), F.col("pos"))).over(so_far))
        .drop("_change", "_sum", "_depth", "_ends", "_first")
    )


def _opened_in_cell(place: str) -> Column:
    """Place of the first starter of the cell a row lies in, as far as it is not below the row. The last cell with a starter
    has the largest number, so a running maximum in the order of the file tells, and no row is sorted by its cell."""
    so_far = W.partitionBy("source_file").orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.max(F.when(F.col("starts"), F.struct(F.col("cell").alias("cell"), (-F.col(place)).alias("first")))).over(so_far)
    return F.when(last["cell"] == F.col("cell"), -last["first"])


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda u: u[column])


def _pieces(files: DataFrame) -> DataFrame:
    return files.select(
        *[c for c in files.columns if c != "content"],
        F.posexplode(S.statement_pieces(F.col("content"))).alias("pos", "unit"),
    )


def split_statements(files: DataFrame) -> DataFrame:
    """Split texts into statements: at semicolons outside quotes and comments, but not within the blocks of a body.

    Texts without the word BEGIN have no blocks and are split where they lie; only those that have it meet the other pieces
    of their file again.
    """
    others = [c for c in files.columns if c != "content"]
    bodies = F.coalesce(F.col("content").rlike(r"(?i)\bBEGIN\b"), F.lit(False))
    plain = _pieces(files.filter(~bodies)).select(*others, F.col("pos").alias("ordinal"), F.col("unit").alias("text"))
    joined = (
        _with_starts(_pieces(files.filter(bodies)))
        .groupBy(*others, F.col("start").alias("ordinal"))
        .agg(F.array_join(_in_order("unit"), "").alias("text"))
    )
    trimmed = pinned(plain.unionByName(joined), {"raw_sql": trim_ws(F.col("text"))}).drop("text")
    long_enough = trimmed.filter((F.length("raw_sql") >= S.MIN_LENGTH) & ~S.is_comment_only(F.col("raw_sql")))
    return with_type(long_enough).filter(F.col("query_type") != "UNKNOWN")


def statement_lines(files: DataFrame) -> DataFrame:
    """SQ1 with the exact line range of every statement, counted over the pieces of its own file."""
    others = [c for c in files.columns if c != "content"]
    before = W.partitionBy("source_file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    counted = _with_starts(_pieces(files)).withColumn("above", F.coalesce(F.sum(count_lines(F.col("unit")) - 1).over(before), F.lit(0)))
    texts = counted.groupBy(*others, F.col("start").alias("ordinal")).agg(
        F.array_join(_in_order("unit"), "").alias("text"), F.min("above").alias("above")
    )
    located = (
        pinned(texts, {"raw_sql": trim_ws(F.col("text"))})
        .withColumn("line_start", (F.col("above") + count_lines(F.regexp_extract("text", r"^(\s*)", 1))).cast("int"))
        .withColumn("line_end", (F.col("line_start") + count_lines(F.col("raw_sql")) - 1).cast("int"))
    )
    long_enough = located.filter((F.length("raw_sql") >= S.MIN_LENGTH) & ~S.is_comment_only(F.col("raw_sql")))
    return (
        with_type(long_enough)
        .filter(F.col("query_type") != "UNKNOWN")
        .select(*others, "ordinal", "raw_sql", "query_type", "line_start", "line_end")
    )


def _openers(marked: DataFrame) -> DataFrame:
    """(source_file, line_no, end_at) of the starters that open a block: the first of a file, and from each the first one
    below the end of its block.

    These jumps are followed by pointer doubling: in round k the openers known so far reach those 2^k jumps further on, and
    every jump becomes one twice as long, so a file with n blocks takes log2(n) rounds. Only file and line numbers are moved.
    """
    starters = marked.filter("starts").select("source_file", "line_no", F.coalesce("end_at", F.lit(2**31 - 1)).alias("end_at"))
    starters = durable(starters)
    ends = marked.select("source_file", F.col("line_no").alias("end_at"), F.col("next_start").alias("to"))
    jumps = starters.join(ends, ["source_file", "end_at"]).filter("to IS NOT NULL").select("source_file", "line_no", "to")
    jumps = durable(jumps)
    known = durable(starters.groupBy("source_file").agg(F.min("line_no").alias("line_no")))
    while not jumps.isEmpty():
        further = known.join(jumps, ["source_file", "line_no"]).select("source_file", F.col("to").alias("line_no"))
        # What is 2^k jumps further on has not been reached in fewer, so nothing comes twice.
        reached = durable(known.unionByName(further))
        second = jumps.select("source_file", F.col("line_no").alias("to"), F.col("to").alias("_to"))
        longer = durable(jumps.join(second, ["source_file", "to"]).select("source_file", "line_no", F.col("_to").alias("to")))
        release(known)
        release(jumps)
        known, jumps = reached, longer
    return known.join(starters, ["source_file", "line_no"])


def extract_line_runs(files: DataFrame, mode: str = "default") -> DataFrame:
    """Line scanner: a starter word opens a block, a semicolon or a blank line closes it.

    The default closes a block on its own first line too; ``mode="compat"`` tests from the second line on, so a
    one-line statement takes the following lines with it. A file's lines are one text value exploded, hence a window
    per file holds no more than that value did.
    """
    if mode not in ("default", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    others = [c for c in files.columns if c != "content"]
    lines = files.select(
        *others, F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)
    lines = lines.withColumn("starts", _starts(F.col("line"))).withColumn("closes", _closes(F.col("line")))
    ordered = W.partitionBy("source_file").orderBy("line_no")
    if mode == "default":
        # A closing line ends whatever is open, so a block is fixed by the first starter after the last close.
        closed = ordered.rowsBetween(W.unboundedPreceding, -1)
        cells = lines.withColumn("cell", F.coalesce(F.sum(F.col("closes").cast("int")).over(closed), F.lit(0)))
        opened = cells.withColumn("open_at", _opened_in_cell("line_no"))
    else:
        # The opening line cannot close its own block: from each starter the next closing line below ends it, and
        # starters up to there belong to it.
        after = ordered.rowsBetween(1, W.unboundedFollowing)
        below = lambda flag: F.min(F.when(F.col(flag), F.col("line_no"))).over(after)
        marked = lines.withColumns({"end_at": below("closes"), "next_start": below("starts")})
        openers = _openers(marked)
        marked = marked.drop("next_start").withColumn("end_at", F.coalesce("end_at", F.lit(2**31 - 1)))
        openers = openers.select("source_file", "line_no", F.col("line_no").alias("opener"), F.col("end_at").alias("last"))
        opened = (
            marked.drop("end_at")
            .join(openers, ["source_file", "line_no"], "left")
            .withColumn("open_at", F.last("opener", ignorenulls=True).over(ordered))
            .withColumn("last_at", F.last("last", ignorenulls=True).over(ordered))
            .filter(F.col("line_no") <= F.col("last_at"))
        )
    blocks = (
        opened.filter(F.col("line_no") >= F.col("open_at"))
        .groupBy(*others, "open_at")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"
            ).alias("text"),
            F.max("line_no").alias("line_end"),
        )
    )
    return (
        with_type(pinned(blocks, {"raw_sql": trim_ws(F.col("text"))}).filter(F.length("raw_sql") >= S.MIN_LENGTH))
        .filter(F.col("query_type") != "UNKNOWN")
        .select(
            *others,
            (F.col("open_at") - 1).cast("int").alias("ordinal"),
            "raw_sql",
            "query_type",
            F.col("open_at").cast("int").alias("line_start"),
            F.col("line_end").cast("int").alias("line_end"),
        )
    )


def extract_statements(files: DataFrame, mode: str = "default") -> DataFrame:
    """Statement split with exact lines, and the line scanner only for files where the split yields nothing.

    One scan and one shuffle: each text becomes either its statement pieces or its lines, and both kinds of units pass
    the same window and the same grouping by file.
    """
    others = [c for c in files.columns if c != "content"]
    cut = pinned(files, {"_pieces": S.statement_pieces(F.col("content"))})
    cut = pinned(
        cut, {"_splits": F.coalesce(F.exists("_pieces", lambda p: _is_statement(trim_ws(p))), F.lit(False))}
    )
    if mode == "compat":
        by_split = statement_lines(cut.filter("_splits").select(*files.columns))
        by_lines = extract_line_runs(cut.filter(~F.col("_splits")).select(*files.columns), mode)
        return by_split.withColumn("extractor", F.lit("split")).unionByName(
            by_lines.withColumn("extractor", F.lit("lines"))
        )
    units = cut.select(
        *others,
        "_splits",
        F.posexplode(F.when(F.col("_splits"), F.col("_pieces")).otherwise(F.split("content", "\n"))).alias("pos", "unit"),
    )
    before = W.partitionBy("source_file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    newlines = F.when(F.col("_splits"), count_lines(F.col("unit")) - 1)
    counted = (
        units.withColumn("closes", ~F.col("_splits") & _closes(F.col("unit")))
        .withColumn("starts", ~F.col("_splits") & _starts(F.col("unit")))
        .withColumn("above", F.coalesce(F.sum(newlines).over(before), F.lit(0)))
        .withColumn("cell", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)))
    )
    opened = _opened_in_cell("pos")
    pieces = F.col("_splits")
    blocks = (
        _with_starts(counted, counts=pieces)
        .withColumn("block", F.when(pieces, F.col("start")).otherwise(opened))
        .filter(F.col("pos") >= F.col("block"))
        .groupBy(*others, "_splits", "block")
        .agg(_in_order("unit").alias("units"), F.max("pos").alias("last"), F.min("above").alias("above"))
        .withColumn("text", F.when(pieces, F.array_join("units", "")).otherwise(F.array_join("units", "\n")))
        .drop("units")
    )
    texts = pinned(blocks, {"raw_sql": trim_ws(F.col("text"))}).filter(F.length("raw_sql") >= S.MIN_LENGTH)
    texts = with_type(texts.filter(~F.col("_splits") | ~S.is_comment_only(F.col("raw_sql"))))
    first = F.when(
        F.col("_splits"), F.col("above") + count_lines(F.regexp_extract("text", r"^(\s*)", 1))
    ).otherwise(F.col("block") + 1)
    last = F.when(F.col("_splits"), F.col("line_start") + count_lines(F.col("raw_sql")) - 1).otherwise(F.col("last") + 1)
    return (
        texts.filter(F.col("query_type") != "UNKNOWN")
        .withColumn("line_start", first.cast("int"))
        .select(
            *others,
            F.col("block").alias("ordinal"),
            "raw_sql",
            "query_type",
            "line_start",
            last.cast("int").alias("line_end"),
            F.when(F.col("_splits"), "split").otherwise("lines").alias("extractor"),
        )
    )


def filter_valid(statements: DataFrame, strict: bool = False, max_length: int | None = None) -> DataFrame:
    return statements.filter(S.is_valid_statement(F.col("raw_sql"), strict, max_length))


def with_type(statements: DataFrame) -> DataFrame:
    return pinned(statements, {"query_type": S.statement_type(F.col("raw_sql"))})


def with_normal_form(statements: DataFrame) -> DataFrame:
    return statements.withColumn("normalized_sql", S.normalize_sql(F.col("raw_sql"))).withColumn(
        "fingerprint", S.fingerprint(F.col("normalized_sql"))
    )


def with_flags(statements: DataFrame) -> DataFrame:
    """Five feature flags and the referenced tables; needs ``query_type``."""
    sql = F.upper("raw_sql")
    flagged = pinned(
        statements,
        {
            "has_joins": sql.rlike(r"\bJOIN\b"),
            "has_subquery": sql.rlike(r"\(\s*SELECT\b"),
            "has_cte": (F.col("query_type") == "WITH") | sql.rlike(r"\bWITH\s+\w+\s+AS\s*\("),
            "has_aggregation": sql.rlike(r"\b(?:COUNT|SUM|AVG|MAX|MIN|GROUP\s+BY|HAVING)\b"),
            "has_where": sql.rlike(r"\bWHERE\b"),
        },
    )
    return flagged.withColumn("table_names", S.table_refs(F.col("raw_sql")))


def with_complexity(statements: DataFrame) -> DataFrame:
    """Integer score: joins, subqueries, CTE, aggregation, windows, unions, HAVING, length. The points are fixed values."""
    sql = F.upper("raw_sql")
    points = (
        F.lit(1)
        + 3 * F.regexp_count(sql, F.lit(r"\bJOIN\b"))
        + 4 * F.regexp_count(sql, F.lit(r"\(\s*SELECT\b"))
        + 3 * F.col("has_cte").cast("int")
        + 2 * F.col("has_aggregation").cast("int")
        + 4 * sql.rlike(r"\bOVER\s*\(").cast("int")
        + 2 * F.regexp_count(sql, F.lit(r"\bUNION\b"))
        + 2 * sql.rlike(r"\bHAVING\b").cast("int")
        + F.least(F.floor(F.length("raw_sql") / 200), F.lit(10))
    )
    return statements.withColumn("complexity_score", points.cast("int"))


def with_risk(statements: DataFrame) -> DataFrame:
    changes_rows = F.col("query_type").isin("UPDATE", "DELETE")
    return statements.withColumn(
        "risk_level",
        F.when(changes_rows & ~F.col("has_where"), "CRITICAL")
        .when(F.col("query_type").isin("DROP", "TRUNCATE"), "HIGH")
        .when(changes_rows | (F.col("query_type") == "INSERT"), "MEDIUM")
        .otherwise("LOW"),
    )


def with_importance(statements: DataFrame) -> DataFrame:
    weight = F.coalesce(F.element_at(literal_map(S.TYPE_WEIGHTS), F.col("query_type")), F.lit(S.DEFAULT_WEIGHT))
    points = (
        weight
        + F.least(F.floor(F.col("complexity_score") / 3), F.lit(10))
        + 3 * F.col("has_joins").cast("int")
        + 4 * F.col("has_subquery").cast("int")
        + 3 * F.col("has_cte").cast("int")
        + 2 * F.col("has_aggregation").cast("int")
        + F.col("has_where").cast("int")
        + F.least(F.size("table_names"), F.lit(5))
    )
    return statements.withColumn("importance_score", points.cast("int"))


def with_features(statements: DataFrame) -> DataFrame:
    """Everything derived from one statement: normal form, fingerprint, flags, tables, scores, risk. One projection."""
    return with_importance(with_risk(with_complexity(with_flags(with_normal_form(statements)))))


def with_first_match_lines(statements: DataFrame, files: DataFrame) -> DataFrame:
    """Line of the first place in the file where the statement's first line (50 characters) occurs.

    Repeated statements all report the first occurrence; (1, 1) when it is nowhere.
    """
    needle = F.substring(trim_ws(F.split_part("raw_sql", F.lit("\n"), F.lit(1))), 1, 50)
    keyed = pinned(statements, {"_needle": needle})
    # A text meets the distinct first lines of its own statements once; line numbers, not texts, go back to statements.
    wanted = keyed.groupBy("source_file").agg(F.collect_set("_needle").alias("_needles"))
    met = files.select("source_file", "content").join(wanted, "source_file")

    def place(n: Column) -> Column:
        at = F.when(n != "", F.instr(F.col("content"), n)).otherwise(F.lit(0))
        line = F.transform(
            F.array(at), lambda i: F.when(i > 0, count_lines(F.substr(F.col("content"), F.lit(1), i - 1))).otherwise(F.lit(0))
        )
        return F.struct(n.alias("_needle"), F.get(line, 0).cast("int").alias("_line"))

    places = met.select(
        "source_file", count_lines(F.col("content")).alias("_length"), F.explode(F.transform("_needles", place)).alias("_p")
    ).select("source_file", "_length", "_p._needle", "_p._line")
    located = keyed.join(places, ["source_file", "_needle"])
    hit = F.col("_line") > 0
    last = F.least(F.col("_line") + count_lines(F.col("raw_sql")) - 1, F.col("_length"))
    return located.withColumns(
        {
            "line_first_match": F.when(hit, F.col("_line")).otherwise(F.lit(1)).cast("int"),
            "line_first_match_end": F.when(hit, last).otherwise(F.lit(1)).cast("int"),
        }
    ).drop("_needle", "_line", "_length")


def filter_scores(statements: DataFrame, min_complexity: int = 0, min_importance: int = 0) -> DataFrame:
    return statements.filter(
        (F.col("complexity_score") >= min_complexity) & (F.col("importance_score") >= min_importance)
    )
