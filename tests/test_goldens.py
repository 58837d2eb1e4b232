"""Fixed inputs with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import sqltext as S
from gleaner.functions import urls as U
from gleaner.functions.text import join_desc
from gleaner.operators import dedup as DD
from gleaner.operators import findings as A
from gleaner.operators import statements as ST


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def statements(spark, sqls, types=None):
    rows = [(f"f{i:03d}.sql", i, 1, s) for i, s in enumerate(sqls)]
    df = spark.createDataFrame(rows, "source_file string, ordinal int, line_start int, raw_sql string")
    return ST.with_features(ST.with_type(df))


def test_statement_types(spark):
    cases = {
        "SELECT * FROM users": "SELECT",
        "INSERT INTO users (name) VALUES ('x')": "INSERT",
        "UPDATE users SET name='x' WHERE id=1": "UPDATE",
        "DELETE FROM users WHERE id=1": "DELETE",
        "CREATE TABLE t (id INT)": "CREATE",
        "CREATE PROCEDURE p AS SELECT 1": "STORED_PROCEDURE",
        "CREATE VIEW v AS SELECT 1": "VIEW",
        "ALTER TABLE t ADD col INT": "ALTER",
        "DROP TABLE t": "DROP",
        "WITH cte AS (SELECT 1) SELECT * FROM cte": "WITH",
        "EXEC sp_test": "EXEC",
        "GARBAGE TEXT": "UNKNOWN",
        "create or replace  trigger t": "TRIGGER",
        "CREATE OR REPLACE INDEX i ON t (a)": "INDEX",
        "CREATE UNIQUE INDEX i ON t (a)": "CREATE",
        "WITH x\nAS (SELECT 1) SELECT 2": "UNKNOWN",
        "-- note\n/* more\n lines */ commit": "TRANSACTION",
        "DECLARE @x INT": "EXEC",
        "DECLARE x INT": "UNKNOWN",
        "SELECTED things": "UNKNOWN",
        "EXECUTE p": "EXEC",
        "CALL p()": "EXEC",
        "MERGE INTO t": "MERGE",
        "TRUNCATE TABLE t": "TRUNCATE",
    }
    assert column(spark, list(cases), S.statement_type) == list(cases.values())


def test_validity(spark):
    cases = {
        "SELECT id FROM users WHERE active=1": (True, True),
        "": (False, False),
        "SELECT 1": (False, False),
        "-- only a comment here": (False, False),
        "-- note\nSELECT * FROM t": (True, False),
        "COMMIT TRANSACTION": (True, False),
        "  \n SELECT * FROM t  ": (True, True),
    }
    loose = column(spark, list(cases), S.is_valid_statement)
    strict = column(spark, list(cases), lambda c: S.is_valid_statement(c, strict=True))
    assert list(zip(loose, strict)) == list(cases.values())


def test_comment_only(spark):
    cases = ["-- comment", "SELECT * FROM t", "/* a\n * b\n */", "  \n-- x\n\t/* y */", "-- x\nSELECT 1"]
    assert column(spark, cases, S.is_comment_only) == [True, False, True, True, False]


def test_normal_forms(spark):
    same = ["SELECT   *   FROM   t", "select * from t", "SELECT * FROM t;", "SELECT * -- c\nFROM t ;;"]
    assert set(column(spark, same, S.normalize_sql)) == {"SELECT * FROM T"}
    blind = ["select * from t where a = 'x' and b = 12", "SELECT * FROM t WHERE a='' AND b = 7;"]
    keys = column(spark, blind, S.template_key)
    assert keys == ["SELECT * FROM T WHERE A = '?' AND B = ?", "SELECT * FROM T WHERE A='?' AND B = ?"]
    assert column(spark, ["x1 = 10 and y_2 = 3.5"], S.template_key) == ["X1 = ? AND Y_2 = ?.?"]


def test_features(spark):
    cases = [
        ("DELETE FROM temp_processing_queue;", "DELETE", "CRITICAL", 1, 7, ["temp_processing_queue"]),
        ("DROP TABLE IF EXISTS old_backup_2019;", "DROP", "HIGH", 1, 3, []),
        ("ALTER TABLE users ADD COLUMN phone VARCHAR(20) NULL;", "ALTER", "LOW", 1, 8, ["users"]),
        ("UPDATE users SET last_login = 1\nWHERE id = @user_id;", "UPDATE", "MEDIUM", 1, 8, ["users"]),
        ("INSERT INTO audit_log (a) VALUES (1);", "INSERT", "MEDIUM", 1, 7, ["audit_log"]),
        ("SELECT u.id FROM users u INNER JOIN orders o ON u.id=o.uid", "SELECT", "LOW", 4, 11, ["orders", "users"]),
        ("SELECT * FROM users WHERE id IN (SELECT uid FROM orders)", "SELECT", "LOW", 5, 13, ["orders", "users"]),
        ("MERGE INTO t USING s ON 1=1", "MERGE", "LOW", 1, 8, ["t"]),
    ]
    rows = statements(spark, [c[0] for c in cases]).orderBy("source_file").collect()
    for row, case in zip(rows, cases, strict=True):
        got = (row.query_type, row.risk_level, row.complexity_score, row.importance_score, row.table_names)
        assert got == case[1:], case[0]


def test_overlapping_table_words(spark):
    assert column(spark, ["SELECT 1 FROM UPDATE x"], S.table_refs) == [["UPDATE", "x"]]


def test_split_keeps_quotes_and_comments(spark):
    text = "select ';' from t; -- a; b\nupdate t set a = \"x;y\" /* ; \n; */ where b = 1;\n\ndelete from t where c = 'it''s;'"
    files = spark.createDataFrame([("a.sql", text)], "source_file string, content string")
    rows = ST.statement_lines(files).orderBy("ordinal").collect()
    assert [(r.query_type, r.line_start, r.line_end) for r in rows] == [
        ("SELECT", 1, 1),
        ("UPDATE", 1, 3),
        ("DELETE", 5, 5),
    ]
    assert rows[1].raw_sql.startswith("-- a; b\nupdate") and rows[2].raw_sql.endswith("'it''s;'")


PROCEDURE = """CREATE OR REPLACE PROCEDURE pay(a INT)
BEGIN
  UPDATE t SET x = CASE WHEN a > 1 THEN 'END;' ELSE 'b' END; -- BEGIN
  IF a > 2 THEN BEGIN DELETE FROM u WHERE id = a; END; END IF;
END;"""


def split(spark, text):
    """The statements by all three extractors, which must agree; lines from the two that tell them."""
    files = spark.createDataFrame([("a.sql", text)], "source_file string, content string")
    found = [(r.ordinal, r.raw_sql) for r in ST.split_statements(files).orderBy("ordinal").collect()]
    for extract in (ST.statement_lines, ST.extract_statements):
        rows = extract(files).orderBy("ordinal").collect()
        assert [(r.ordinal, r.raw_sql) for r in rows] == found
        for r in rows:
            assert "\n".join(text.split("\n")[r.line_start - 1 : r.line_end]).find(r.raw_sql.split("\n")[0]) >= 0
    return [sql for _, sql in found]


def test_bodies_stay_whole(spark):
    assert split(spark, f"SELECT a FROM b;\n\n{PROCEDURE}\nDROP TABLE last_one;") == ["SELECT a FROM b;", PROCEDURE, "DROP TABLE last_one;"]
    nested = "create trigger g after insert on t for each row begin\n case new.y when 1 then begin delete from v; end; end case;\nend;"
    assert split(spark, f"{nested} DELETE FROM w;") == [nested, "DELETE FROM w;"]
    tsql = "CREATE PROC p AS BEGIN TRY SELECT a FROM b; END TRY BEGIN CATCH ROLLBACK TRANSACTION; END CATCH;"
    assert split(spark, f"{tsql}\nSELECT 2 FROM c;") == [tsql, "SELECT 2 FROM c;"]
    loop = "BEGIN FOR i IN 1..3 LOOP DELETE FROM a; END LOOP; WHILE x DO UPDATE b SET c = 1; END WHILE; END;"
    assert split(spark, f"{loop} SELECT 2 FROM c;") == [loop, "SELECT 2 FROM c;"]
    dollar = "CREATE FUNCTION f() RETURNS INT AS $$ BEGIN DELETE FROM x; RETURN 1; END; $$ LANGUAGE plpgsql;"
    assert split(spark, f"{dollar} SELECT '$$' FROM c;") == [dollar, "SELECT '$$' FROM c;"]


def test_transactions_and_prose_open_no_block(spark):
    text = "BEGIN TRANSACTION;\nDELETE FROM a;\nCOMMIT WORK;BEGIN ;UPDATE b SET c = 1;END;DELETE FROM d;"
    assert split(spark, text) == ["BEGIN TRANSACTION;", "DELETE FROM a;", "COMMIT WORK;", "UPDATE b SET c = 1;", "DELETE FROM d;"]
    assert split(spark, "we begin in this case; SELECT a FROM b; the end; begin_x; DELETE FROM end_of;") == ["SELECT a FROM b;", "DELETE FROM end_of;"]
    assert split(spark, "SELECT CASE WHEN a THEN 1 END FROM t; DELETE FROM u; -- BEGIN") == ["SELECT CASE WHEN a THEN 1 END FROM t;", "DELETE FROM u;"]


def test_block_without_end_is_no_block(spark):
    text = f"{PROCEDURE}\nCREATE PROC q AS BEGIN SELECT a FROM b;\nDELETE FROM c;\nDROP TABLE dd;"
    assert split(spark, text) == [PROCEDURE, "CREATE PROC q AS BEGIN SELECT a FROM b;", "DELETE FROM c;", "DROP TABLE dd;"]


def test_features_of_a_body(spark):
    row = statements(spark, [PROCEDURE], None).first()
    assert (row.query_type, row.risk_level, row.table_names) == ("STORED_PROCEDURE", "LOW", ["t", "u"])


def test_long_texts_fit_the_stack(spark):
    text = "/*" + "x*y\n" * 200000 + "*/" + "-- c\n" * 50000 + "select 1 from t;" + "select ';;' from u;\n" * 20000
    files = spark.createDataFrame([("big.sql", text)], "source_file string, content string")
    assert ST.split_statements(files).count() == 20001
    body = "CREATE PROC p AS BEGIN " + "BEGIN DELETE FROM t; END;\n" * 20000 + "END;"
    files = spark.createDataFrame([("big.sql", body + "SELECT 1 FROM u;")], "source_file string, content string")
    assert [len(r.raw_sql) for r in ST.split_statements(files).orderBy("ordinal").collect()] == [len(body), 16]


def test_fallback_only_where_split_finds_nothing(spark):
    log = "run started\n\nSELECT * FROM users\n\nend of run\ndelete from tmp_x"
    files = spark.createDataFrame(
        [("a.log", log), ("b.sql", "select 1 from t;"), ("c.txt", "prose only")], "source_file string, content string"
    )
    rows = ST.extract_statements(files).orderBy("source_file", "ordinal").collect()
    assert [(r.source_file, r.extractor, r.line_start, r.line_end, r.raw_sql) for r in rows] == [
        ("a.log", "lines", 3, 4, "SELECT * FROM users"),
        ("a.log", "lines", 6, 6, "delete from tmp_x"),
        ("b.sql", "split", 1, 1, "select 1 from t;"),
    ]


def test_dedup_counts(spark):
    same, other = "SELECT * FROM users", "SELECT * FROM orders WHERE x = 1"

    def counts(sqls):
        row = DD.dedup_stats(DD.dedup(statements(spark, sqls))).first()
        return row.total_input, row.total_unique, row.total_duplicates

    assert counts([same, same]) == (2, 1, 1)
    assert counts([same, other]) == (2, 2, 0)
    assert counts([same, same, same]) == (3, 1, 2)
    assert counts([same, "select  *  from users;"]) == (2, 1, 1)
    assert counts([same] * 5 + [other, "SELECT name FROM products"]) == (7, 3, 4)
    empty = statements(spark, [same]).filter(F.lit(False))
    assert DD.dedup_stats(DD.dedup(empty)).first().total_input == 0
    bypassed = DD.dedup_stats(DD.dedup(statements(spark, [same, same]), bypass=True)).first()
    assert bypassed.total_unique == 2


def test_duplicate_edges(spark):
    sqls = ["SELECT * FROM users", "select * from users", "SELECT * FROM users;", "SELECT a FROM t WHERE x = 1",
            "SELECT a FROM t WHERE x = 2"]
    rows = DD.duplicate_edges(DD.dedup(statements(spark, sqls))).orderBy("group_no", "duplicate_file").collect()
    assert [(r.group_no, r.duplicate_type, r.match_type, r.original_file, r.duplicate_file) for r in rows] == [
        (1, "EXACT", "EXACT", "f000.sql", "f001.sql"),
        (1, "EXACT", "EXACT", "f000.sql", "f002.sql"),
        (2, "FORMATTING", "NORMALIZED", "f003.sql", "f004.sql"),
    ]
    assert rows[1].preview == "select * from users"


def test_findings_and_summary(spark):
    df = statements(spark, ["DELETE FROM users", "DROP TABLE t1", "SELECT * FROM users", "SELECT * FROM Users JOIN b ON 1=1"])
    assert {(r.rule, r.metric) for r in A.findings(df).collect()} == {
        ("critical", 1), ("high", 1), ("unfiltered", 1), ("top_table", 3), ("ddl", 1)
    }
    lines = [r.text for r in A.summary_lines(df).orderBy("section_no", "line_no").collect()]
    assert lines[2] == "This consolidated document contains 4 unique SQL queries."
    assert "  * 2 SELECT queries" in lines and "  * users: referenced 3 times" in lines


def test_tidy(spark):
    assert column(spark, ["select a,b , c\n\n\n\nfrom t  \n"], S.tidy_sql) == ["select a, b , c\n\nfrom t;"]


def test_urls(spark):
    canon = {
        "HTTP://Ex.COM//a//b/?q=1#f": "http://ex.com/a/b?q=1",
        "http://ex.com/": "http://ex.com/",
        "http://ex.com": "http://ex.com",
        "http://ex.com/a;p=1/": "http://ex.com/a;p=1",
    }
    assert column(spark, list(canon), U.canon_url) == list(canon.values())
    assert column(spark, list(canon.values()), U.canon_url) == list(canon.values())
    assert column(spark, ["http://a/b", "mailto:x@y", "/a", "//h/x", "javascript:f()"], U.is_valid_url) == [
        True, False, False, False, False
    ]
    tree = {
        "https://docs.site.org/a b/c%20d/e.pdf?x=1": "site/a_b/c_20d/e.pdf",
        "https://x.co.uk/f.pdf": "co/f.pdf",
        "https://localhost/": "localhost/file",
        "https://localhost/?id=a&b": "localhost/id_a_b",
    }
    assert column(spark, list(tree), U.target_path) == list(tree.values())
    assert column(spark, ["http://h/a/b:c.pdf"], lambda c: U.target_path(c, "flat")) == ["h/a_b_c.pdf"]
    assert column(spark, ["http://h/a/b:c.pdf"], lambda c: U.target_path(c, "name")) == ["h/b_c.pdf"]
    suffixes = {"http://h/a.PDF": "pdf", "http://h/a.docx?dl=1": "docx", "http://h/get?f=a.zip": "zip", "http://h/a": ""}
    assert column(spark, list(suffixes), U.file_suffix) == list(suffixes.values())
    assert column(spark, ["http://h/a.pdf?dl=1"], lambda c: U.file_suffix(c, whole_url=True)) == [""]


def test_version_order(spark):
    df = spark.createDataFrame([(["9.2", "12.1", "10.0"],)], "v array<string>")
    row = df.select(join_desc(F.col("v")).alias("text"), join_desc(F.col("v"), numeric=True).alias("number")).first()
    assert row.text == "9.2:12.1:10.0" and row.number == "12.1:10.0:9.2"
