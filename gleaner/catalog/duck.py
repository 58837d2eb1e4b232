"""Oracle expressions for DuckDB (RE2 regexes: no lookaround, no possessive quantifiers)."""

from __future__ import annotations


def trim_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def n_lines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')) + 1)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_NO_CODE = r"''[^'']*''|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/|\$\$(?s:.*?)\$\$"


def pieces(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?:[^;''\"/\-$]+|{_NO_CODE}|[''\"/\-$])+;?|;')"


def block_change(x: str) -> str:
    code = f"upper(regexp_replace({x}, '{_NO_CODE}', ' ', 'g'))"
    opened = (
        rf"{count(code, r'\b(BEGIN|CASE)\b')} - {count(code, r'\bEND\s+CASE\b')} - "
        + count(code, r"\bBEGIN\s*(?:;|(?:TRAN|TRANSACTION|WORK|DEFERRED|IMMEDIATE|EXCLUSIVE|ISOLATION|READ)\b)")
    )
    ended = rf"{count(code, r'\bEND\b')} - {count(code, r'\bEND\s+(?:IF|LOOP|WHILE|REPEAT|FOR|TRAN|TRANSACTION)\b')}"
    opening = (
        r"^\s*(?:(?:CREATE|ALTER)\s+(?:\S+\s+){0,5}?(?:PROCEDURE|PROC|FUNCTION|TRIGGER|PACKAGE|EVENT)\b"
        r"|(?:BEGIN|DECLARE|IF|ELSE|ELSEIF|ELSIF|WHILE|FOR|FOREACH|LOOP|REPEAT|WHEN|CASE|EXCEPTION|END|AS|IS)\b|\w+\s*:|<<)"
    )
    change = f"(({opened}) - ({ended}))"
    return f"CASE WHEN regexp_matches({code}, '{opening}') THEN {change} ELSE least({change}, 0) END"


def strip_comments(x: str) -> str:
    return rf"regexp_replace({x}, '^(?:\s|--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/)*', '')"


def comment_only(x: str, strict: bool = False) -> str:
    if not strict:
        return f"{strip_comments(x)} = ''"
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {trim_ws('l')})"
    return (
        f"len(list_filter({lines}, lambda l: l <> '' AND NOT starts_with(l, '--') AND NOT starts_with(l, '/*') "
        "AND NOT starts_with(l, '*'))) = 0"
    )


def statement_type(x: str) -> str:
    head = strip_comments(f"upper({x})")
    word = rf"regexp_extract({head}, '^(\w+)', 1)"
    made = rf"regexp_extract({head}, '^CREATE\s+(?:OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION|TRIGGER|VIEW|INDEX)\b', 1)"
    return f"""CASE WHEN {made} = 'PROCEDURE' THEN 'STORED_PROCEDURE' WHEN {made} <> '' THEN {made}
      WHEN {word} IN ('CREATE', 'ALTER', 'DROP', 'TRUNCATE', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'MERGE') THEN {word}
      WHEN {word} IN ('EXEC', 'EXECUTE', 'CALL') THEN 'EXEC'
      WHEN {word} IN ('BEGIN', 'COMMIT', 'ROLLBACK') THEN 'TRANSACTION'
      WHEN regexp_matches({head}, '^WITH\\s+\\w+.*\\bAS\\s*\\(') THEN 'WITH'
      WHEN regexp_matches({head}, '^DECLARE\\s+@') THEN 'EXEC' ELSE 'UNKNOWN' END"""


def valid(x: str, strict: bool) -> str:
    text = trim_ws(x)
    head = f"upper({text})" if strict else strip_comments(f"upper({text})")
    extra = "" if strict else "|COMMIT|ROLLBACK|DECLARE"
    words = "SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|MERGE|EXEC|WITH|BEGIN|CALL" + extra
    longest = f"AND length({text}) <= 500000 " if strict else ""
    return (
        f"length({text}) >= 10 {longest}AND NOT ({comment_only(text, strict)}) "
        f"AND regexp_matches({head}, '^(?:{words})')"
    )


def normalized(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '--[^\n]*', '', 'g'), '/\*(?s:.*?)\*/', '', 'g')"
    return rf"trim(rtrim(upper(trim(regexp_replace({bare}, '\s+', ' ', 'g'))), ';'))"


def template(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '--[^\n]*', ' ', 'g'), '/\*(?s:.*?)\*/', ' ', 'g')"
    flat = rf"trim(rtrim(trim(regexp_replace(upper({bare}), '\s+', ' ', 'g')), ';'))"
    return rf"regexp_replace(regexp_replace({flat}, '''[^'']*''', '''?''', 'g'), '\b\d+\b', '?', 'g')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({template(x)}, '\w+')"


def tables(x: str) -> str:
    scans = ", ".join(
        rf"regexp_extract_all({x}, '(?i)\b{w}\s+([\w.]+)', 1)" for w in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE")
    )
    return (
        f"list_sort(list_distinct(list_filter(flatten([{scans}]), lambda w: upper(w) NOT IN ('SELECT', 'SET', 'WHERE', "
        "'GROUP', 'ORDER', 'HAVING', 'ON', 'AND', 'OR', 'NOT', 'NULL', 'AS', 'IF', 'EXISTS'))))"
    )


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared} / (len({a}) + len({b}) - {shared}) END)"


def features(source: str, valid_only: bool = True) -> str:
    """SELECT with every feature column over a CTE with raw_sql; ``valid_only`` applies the default validity test."""
    u = "upper(raw_sql)"
    where = f" WHERE {valid('raw_sql', False)}" if valid_only else ""
    typed = f"SELECT *, {statement_type('raw_sql')} AS query_type FROM {source}{where}"
    flagged = rf"""SELECT *, sha256({normalized('raw_sql')}) AS fingerprint,
      regexp_matches({u}, '\bJOIN\b') AS has_joins, regexp_matches({u}, '\(\s*SELECT\b') AS has_subquery,
      query_type = 'WITH' OR regexp_matches({u}, '\bWITH\s+\w+\s+AS\s*\(') AS has_cte,
      regexp_matches({u}, '\b(COUNT|SUM|AVG|MAX|MIN|GROUP\s+BY|HAVING)\b') AS has_aggregation,
      regexp_matches({u}, '\bWHERE\b') AS has_where, {tables('raw_sql')} AS table_names FROM ({typed})"""
    scored = rf"""SELECT *, (1 + 3 * {count(u, r'\bJOIN\b')} + 4 * {count(u, r'\(\s*SELECT\b')}
      + 3 * has_cte::INT + 2 * has_aggregation::INT + 4 * regexp_matches({u}, '\bOVER\s*\(')::INT
      + 2 * {count(u, r'\bUNION\b')} + 2 * regexp_matches({u}, '\bHAVING\b')::INT
      + least(length(raw_sql) // 200, 10))::INT AS complexity_score,
      CASE WHEN query_type IN ('UPDATE', 'DELETE') AND NOT has_where THEN 'CRITICAL'
        WHEN query_type IN ('DROP', 'TRUNCATE') THEN 'HIGH'
        WHEN query_type IN ('UPDATE', 'DELETE', 'INSERT') THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
      FROM ({flagged})"""
    return f"""SELECT *, (CASE query_type WHEN 'STORED_PROCEDURE' THEN 9 WHEN 'CREATE' THEN 8 WHEN 'VIEW' THEN 8
        WHEN 'FUNCTION' THEN 8 WHEN 'ALTER' THEN 7 WHEN 'TRIGGER' THEN 7 WHEN 'MERGE' THEN 7 WHEN 'INSERT' THEN 6
        WHEN 'UPDATE' THEN 6 WHEN 'DELETE' THEN 6 WHEN 'WITH' THEN 6 WHEN 'SELECT' THEN 5 ELSE 3 END
      + least(complexity_score // 3, 10) + 3 * has_joins::INT + 4 * has_subquery::INT + 3 * has_cte::INT
      + 2 * has_aggregation::INT + has_where::INT + least(len(table_names), 5))::INT AS importance_score
      FROM ({scored})"""
