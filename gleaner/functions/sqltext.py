"""Column builders for SQL statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import literal_map, squeeze_ws, trim_ws

# Statement types by leading keyword, and by the object a CREATE makes.
TYPE_BY_KEYWORD = {
    "CREATE": "CREATE",
    "ALTER": "ALTER",
    "DROP": "DROP",
    "TRUNCATE": "TRUNCATE",
    "SELECT": "SELECT",
    "INSERT": "INSERT",
    "UPDATE": "UPDATE",
    "DELETE": "DELETE",
    "MERGE": "MERGE",
    "EXEC": "EXEC",
    "EXECUTE": "EXEC",
    "BEGIN": "TRANSACTION",
    "COMMIT": "TRANSACTION",
    "ROLLBACK": "TRANSACTION",
    "CALL": "EXEC",
}
TYPE_BY_CREATED_OBJECT = {
    "PROCEDURE": "STORED_PROCEDURE",
    "FUNCTION": "FUNCTION",
    "TRIGGER": "TRIGGER",
    "VIEW": "VIEW",
    "INDEX": "INDEX",
}
STATEMENT_TYPES = [
    "SELECT",
    "INSERT",
    "UPDATE",
    "DELETE",
    "MERGE",
    "CREATE",
    "ALTER",
    "DROP",
    "TRUNCATE",
    "EXEC",
    "WITH",
    "TRANSACTION",
    "STORED_PROCEDURE",
    "VIEW",
    "FUNCTION",
    "TRIGGER",
    "INDEX",
    "UNKNOWN",
]
# Keywords a valid statement starts with, and those that open a line run.
VALID_STARTS = [
    "SELECT",
    "INSERT",
    "UPDATE",
    "DELETE",
    "CREATE",
    "ALTER",
    "DROP",
    "TRUNCATE",
    "MERGE",
    "EXEC",
    "WITH",
    "BEGIN",
    "CALL",
]
EXTRA_VALID_STARTS = ["COMMIT", "ROLLBACK", "DECLARE"]
LINE_STARTERS = [
    "SELECT",
    "INSERT",
    "UPDATE",
    "DELETE",
    "MERGE",
    "CREATE",
    "ALTER",
    "DROP",
    "TRUNCATE",
    "EXEC",
    "EXECUTE",
    "WITH",
    "BEGIN",
    "DECLARE",
    "CALL",
]
# Words after FROM, JOIN, INTO, UPDATE or TABLE that are no table names.
NOT_TABLES = [
    "SELECT",
    "SET",
    "WHERE",
    "GROUP",
    "ORDER",
    "HAVING",
    "ON",
    "AND",
    "OR",
    "NOT",
    "NULL",
    "AS",
    "IF",
    "EXISTS",
]
# Importance per statement type; every other type weighs 3.
TYPE_WEIGHTS = {
    "CREATE": 8,
    "ALTER": 7,
    "STORED_PROCEDURE": 9,
    "VIEW": 8,
    "FUNCTION": 8,
    "TRIGGER": 7,
    "SELECT": 5,
    "INSERT": 6,
    "UPDATE": 6,
    "DELETE": 6,
    "MERGE": 7,
    "WITH": 6,
}
DEFAULT_WEIGHT = 3
# Shortest statement, and the longest one a sequential tool accepts (no bound here unless asked for).
MIN_LENGTH = 10
MAX_LENGTH = 500000

# One piece: everything up to a semicolon that is outside quotes, dollar quotes and comments. Possessive quantifiers keep
# the matcher iterative, so a piece of any length fits the thread stack.
NO_CODE = r"'[^']*+'|\"[^\"]*+\"|--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|\$\$(?:[^$]|\$(?!\$))*+\$\$"
PIECE = rf"(?:[^;'\"/\-$]++|{NO_CODE}|['\"/\-$])++;?|;"
# Blocks of procedural code. BEGIN and CASE open one, END closes one; not so where they belong to a transaction, or to a
# closing END CASE, END IF or END of a loop. Only a piece that starts like procedural code can open blocks.
BLOCK_WORD = r"(?i)\b(?:BEGIN|CASE|END)\b"
TRANSACTION_BEGIN = r"\bBEGIN\s*(?:;|(?:TRAN|TRANSACTION|WORK|DEFERRED|IMMEDIATE|EXCLUSIVE|ISOLATION|READ)\b)"
NO_BLOCK_END = r"\bEND\s+(?:IF|LOOP|WHILE|REPEAT|FOR|TRAN|TRANSACTION)\b"
OPENING_PIECE = (
    r"^\s*(?:(?:CREATE|ALTER)\s+(?:\S+\s+){0,5}?(?:PROCEDURE|PROC|FUNCTION|TRIGGER|PACKAGE|EVENT)\b"
    r"|(?:BEGIN|DECLARE|IF|ELSE|ELSEIF|ELSIF|WHILE|FOR|FOREACH|LOOP|REPEAT|WHEN|CASE|EXCEPTION|END|AS|IS)\b|\w+\s*:|<<)"
)
LEADING_COMMENTS = r"^(?:\s|--[^\n]*+(?:\n|$)|/\*(?:[^*]|\*(?!/))*+\*/)*+"


def strip_leading_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, LEADING_COMMENTS, "")


def statement_pieces(content: Column) -> Column:
    """The text cut behind every semicolon of its code, in order, untrimmed: their concatenation is the text. A statement is
    one piece, or several where it has a body of statements."""
    return F.regexp_extract_all(content, F.lit(PIECE), F.lit(0))


def block_change(piece: Column) -> Column:
    """How many blocks a piece leaves open (or closes, if negative)."""
    code = F.upper(F.regexp_replace(piece, NO_CODE, " "))
    found = lambda pattern: F.regexp_count(code, F.lit(pattern))
    opened = found(r"\bBEGIN\b") - found(TRANSACTION_BEGIN) + found(r"\bCASE\b") - found(r"\bEND\s+CASE\b")
    change = opened - (found(r"\bEND\b") - found(NO_BLOCK_END))
    kept = F.when(code.rlike(OPENING_PIECE), change).otherwise(F.least(change, F.lit(0)))
    return F.when(piece.rlike(BLOCK_WORD), kept).otherwise(F.lit(0))


def is_comment_only(sql: Column, strict: bool = False) -> Column:
    """Nothing but comments and blanks. ``strict`` looks at lines: every non-blank one starts like a comment line, even
    where a statement follows the closing mark."""
    if strict:
        return ~sql.rlike(r"(?m)^[ \t\r\f]*+(?!--|/\*|\*)\S")
    return strip_leading_comments(sql) == ""


def statement_type(sql: Column) -> Column:
    """Statement type from the leading keywords, comments before them skipped; UNKNOWN when none fits."""
    head = strip_leading_comments(F.upper(sql))
    keyword = F.regexp_extract(head, r"^(\w+)", 1)
    created = F.regexp_extract(
        head, r"^CREATE\s+(?:OR\s+REPLACE\s+)?(" + "|".join(TYPE_BY_CREATED_OBJECT) + r")\b", 1
    )
    return F.coalesce(
        F.element_at(literal_map(TYPE_BY_CREATED_OBJECT), created),
        F.element_at(literal_map(TYPE_BY_KEYWORD), keyword),
        F.when((keyword == "WITH") & head.rlike(r"^WITH\s+\w+.*\bAS\s*\("), F.lit("WITH")),
        F.when((keyword == "DECLARE") & head.rlike(r"^DECLARE\s+@"), F.lit("EXEC")),
        F.lit("UNKNOWN"),
    )


def is_valid_statement(sql: Column, strict: bool = False, max_length: int | None = None) -> Column:
    """At least MIN_LENGTH characters and at most ``max_length`` (MAX_LENGTH with ``strict``), not only comments, known
    first keyword.

    ``strict`` tests the raw text, so a statement behind a comment fails, as do COMMIT, ROLLBACK and DECLARE;
    otherwise comments in front are skipped and the three are accepted.
    """
    max_length = MAX_LENGTH if strict and max_length is None else max_length
    text = trim_ws(sql)
    head = F.upper(text) if strict else strip_leading_comments(F.upper(text))
    starts = VALID_STARTS if strict else VALID_STARTS + EXTRA_VALID_STARTS
    short_enough = F.lit(True) if max_length is None else F.length(text) <= max_length
    return (
        (F.length(text) >= MIN_LENGTH)
        & short_enough
        & ~is_comment_only(text, strict)
        & head.rlike("^(?:" + "|".join(starts) + ")")
    )


def normalize_sql(sql: Column) -> Column:
    """Comments deleted, white space collapsed, upper case, no trailing semicolon."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(F.upper(squeeze_ws(bare)), r";+$", ""))


def fingerprint(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def template_key(sql: Column) -> Column:
    """Literal-blind form: comments to blanks, upper case, quoted strings and whole numbers to question marks."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    flat = F.trim(F.regexp_replace(squeeze_ws(F.upper(bare)), r";+$", ""))
    return F.regexp_replace(F.regexp_replace(flat, r"'[^']*'", "'?'"), r"\b\d+\b", "?")


def tokens(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"\w+"), F.lit(0))


def table_refs(sql: Column) -> Column:
    """Distinct names after FROM, JOIN, INTO, UPDATE and TABLE, sorted. The name is only looked at, not consumed,
    so one scan finds what five separate scans would."""
    found = F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(?=([\w.]+))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~F.upper(w).isin(NOT_TABLES))))


def tidy_sql(sql: Column) -> Column:
    """Trailing semicolon, a blank after each comma, at most one empty line in a row."""
    text = F.regexp_replace(sql, r"\s+$", "")
    closed = F.when(F.endswith(text, F.lit(";")), text).otherwise(F.concat(text, F.lit(";")))
    return F.regexp_replace(F.regexp_replace(closed, r",(?!\s)", ", "), r"\n{3,}", "\n\n")


def preview(sql: Column, length: int) -> Column:
    """First characters on one line."""
    return F.translate(F.substring(sql, 1, length), "\n", " ")
