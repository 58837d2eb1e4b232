"""Inputs derived from the given tables, as SELECTs that run unchanged in Spark SQL and in DuckDB.

Groups that a job treats as one value (a file, a project, a site) have a fixed size, so more data means more of them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Fixture:
    tables: list[str]
    sql: str
    spark: str = ""
    text: str = ""  # the derived text column: built once per row, never inside the filters that read it

    @property
    def spark_sql(self) -> str:
        return self.spark or self.sql


O = "cast(o_orderkey as string)"
K = "cast(o_orderkey % 97 as string)"
WIDE_COLUMNS = ", ".join(f"a.col{i:02d}" for i in range(1, 61))

STATEMENT_TEXT = f"""CASE o_orderkey % 16
  WHEN 0 THEN concat('SELECT * FROM orders WHERE o_orderkey = ', {O}, ';')
  WHEN 1 THEN concat('select  *  from orders  where o_orderkey  = ', {O})
  WHEN 2 THEN concat('SELECT c.c_name, COUNT(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey',
    chr(10), 'GROUP BY c.c_name HAVING COUNT(*) > ', {K}, ';')
  WHEN 3 THEN concat('SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = ',
    {K}, ');')
  WHEN 4 THEN concat('WITH t AS (SELECT o_orderkey FROM orders WHERE o_totalprice > ', {K}, ') SELECT * FROM t;')
  WHEN 5 THEN concat('INSERT INTO audit_log (id, action) VALUES (', {O}, ', ''LOGIN;''); ')
  WHEN 6 THEN concat('UPDATE orders SET o_orderstatus = ''F'' WHERE o_custkey = ', {K}, ';')
  WHEN 7 THEN concat('UPDATE stage.t', {K}, ' SET done = 1;')
  WHEN 8 THEN concat('DELETE FROM queue_', {K}, ';')
  WHEN 9 THEN concat('DROP TABLE backup_', {K}, ';')
  WHEN 10 THEN concat('TRUNCATE TABLE stage_', {K}, ';')
  WHEN 11 THEN concat('CREATE OR REPLACE VIEW v_', {K}, ' AS SELECT n_name,n_regionkey FROM nation;')
  WHEN 12 THEN concat('CREATE TABLE t_', {K}, ' (id INT,', chr(10), chr(10), chr(10), chr(10), 'name VARCHAR(20))')
  WHEN 13 THEN concat('-- note ', {O}, chr(10), 'ALTER TABLE customer ADD COLUMN c', {K}, ' INT;')
  WHEN 14 THEN concat('SELECT {WIDE_COLUMNS}, RANK() OVER (ORDER BY a.v_', {K}, ') /* rank; */', chr(10),
    'FROM wide a UNION SELECT * FROM wide_old;')
  ELSE CASE cast(floor(o_orderkey / 16) as bigint) % 4
    WHEN 0 THEN concat('/* one line */ SELECT s_name FROM supplier WHERE s_suppkey = ', {K}, ';')
    WHEN 1 THEN concat('/* several', chr(10), '   lines */', chr(10), 'DELETE FROM /* inner */ log_', {K}, ' WHERE id > 0;')
    WHEN 2 THEN concat('/* only a comment ', {O}, ' */;')
    ELSE concat('GARBAGE TEXT ', {O}, ';') END END"""

F1 = f"""SELECT o_orderkey AS stmt_id,
  concat('src/f', lpad(cast(cast(floor(o_orderkey / 64) as bigint) as string), 10, '0'), '.sql') AS source_file,
  cast(o_orderkey % 64 as int) AS ordinal, cast(o_orderkey % 64 + 1 as int) AS line_start,
  cast(o_orderkey % 64 + 1 as int) AS line_end, {STATEMENT_TEXT} AS raw_sql
FROM orders"""

# One text per file. Every fifth file is a log with prose around a statement that no semicolon ends, so that only the
# line scanner finds it.
_LOG = f"""SELECT concat('src/log', lpad(cast(o_orderkey as string), 10, '0'), '.log') AS source_file,
  concat('started job ', {O}, chr(10), chr(10), 'SELECT count(*) FROM orders', chr(10),
    '  WHERE o_custkey = ', {K}, chr(10), chr(10), 'rows returned ', {K}, chr(10), 'delete from tmp_', {K}) AS content
FROM orders WHERE o_orderstatus = 'P'"""


# Scripts of procedural code: bodies with CASE and nested blocks, a trigger, transactions, a dollar-quoted body, a block that
# nothing closes, and prose that talks of beginnings and ends.
_N = "chr(10)"
_BODIES = f"""SELECT concat('src/proc', lpad(cast(o_orderkey as string), 10, '0'), '.sql') AS source_file,
  concat('SELECT c', {K}, ' FROM t', {O}, ';', {_N}, CASE o_orderkey % 6
    WHEN 0 THEN concat('CREATE OR REPLACE PROCEDURE p', {K}, '(a INT)', {_N}, 'BEGIN', {_N}, '  UPDATE t SET x = CASE WHEN a > ', {K},
      ' THEN 1 ELSE 0 END;', {_N}, '  INSERT INTO log VALUES (a, ''BEGIN;'');', {_N}, 'END;')
    WHEN 1 THEN concat('create trigger trg', {K}, ' after insert on t for each row begin', {_N}, '  if new.x = ', {K},
      ' then begin delete from u where id = 1; end; end if;', {_N}, '  case new.y when 1 then delete from v; end case;', {_N}, 'end;')
    WHEN 2 THEN concat('BEGIN TRANSACTION;', {_N}, 'DELETE FROM q WHERE id = ', {O}, ';', {_N}, 'COMMIT;', {_N}, 'BEGIN;', {_N},
      'UPDATE q SET a = 1;', {_N}, 'END;')
    WHEN 3 THEN concat('CREATE FUNCTION f', {K}, '() RETURNS INT AS $$ BEGIN RETURN 1; END; $$ LANGUAGE plpgsql;')
    WHEN 4 THEN concat('CREATE PROC open', {K}, ' AS BEGIN SELECT a FROM b;', {_N}, 'DELETE FROM c WHERE d = ', {O}, ';')
    ELSE concat('we begin here; the case is open; -- BEGIN', {_N}, 'BEGIN TRY', {_N}, '  DELETE FROM w', {K}, '; BEGIN x; END', {_N},
      'END TRY BEGIN CATCH ROLLBACK; END CATCH;') END,
    {_N}, {_N}, 'DROP TABLE last_', {K}, ';') AS content
FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 4 = 0"""


def _texts(aggregate: str) -> str:
    files = f"SELECT source_file, {aggregate} AS content FROM ({F1}) GROUP BY source_file"
    return f"{files} UNION ALL {_LOG} UNION ALL {_BODIES}"


F2 = _texts("string_agg(raw_sql, chr(10) ORDER BY ordinal)")
F2_SPARK = _texts("string_agg(raw_sql, chr(10)) WITHIN GROUP (ORDER BY ordinal)")

# A listing of documents as files of several kinds, some of them below folders that scans leave out.
FILES = """SELECT concat('corpus/', source, '/',
    CASE WHEN doc_id % 11 = 1 THEN '.git/' WHEN doc_id % 11 = 2 THEN 'node_modules/x/'
      WHEN doc_id % 11 = 3 THEN 'venv/' WHEN doc_id % 11 = 4 THEN '.hidden/' ELSE 'main/' END,
    'd', cast(doc_id as string),
    CASE doc_id % 8 WHEN 0 THEN '.sql' WHEN 1 THEN '.TXT' WHEN 2 THEN '.log' WHEN 3 THEN '.exe' WHEN 4 THEN '.py'
      WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.pyc' ELSE '' END) AS path,
  concat(source, '/',
    CASE WHEN doc_id % 11 = 1 THEN '.git/' WHEN doc_id % 11 = 2 THEN 'node_modules/x/'
      WHEN doc_id % 11 = 3 THEN 'venv/' WHEN doc_id % 11 = 4 THEN '.hidden/' ELSE 'main/' END,
    'd', cast(doc_id as string),
    CASE doc_id % 8 WHEN 0 THEN '.sql' WHEN 1 THEN '.TXT' WHEN 2 THEN '.log' WHEN 3 THEN '.exe' WHEN 4 THEN '.py'
      WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.pyc' ELSE '' END) AS relative_path,
  n_chars AS size, lang, doc_id, text AS content FROM documents"""

# Documents as files whose name repeats: the key of the identical-file job is (name, size).
NAMED = """SELECT concat('docs/', source, '/', cast(doc_id as string), '/', lang, '.txt') AS path,
  concat(lang, '.txt') AS name, n_chars AS size, text AS content FROM documents"""

# Registry-style inventory text per customer; the folder is the nation.
_BS = "chr(92)"


def _version(version: str) -> str:
    return (
        f"concat(chr(10), 'ORACLE_HOME    REG_SZ    C:', {_BS}, 'app', {_BS}, 'product', {_BS}, "
        f"{version}, {_BS}, 'dbhome')"
    )


F3 = f"""SELECT concat('inv/n', cast(c_nationkey as string), '/h', cast(c_custkey as string), '/',
    CASE WHEN c_custkey % 3 = 0 THEN 'Oracle_Info.TXT' WHEN c_custkey % 3 = 1 THEN 'oracle_info.txt'
      ELSE 'readme.txt' END) AS path,
  concat('n', cast(c_nationkey as string), '/h', cast(c_custkey as string), '/x.txt') AS relative_path,
  concat('n', cast(c_nationkey as string)) AS collection,
  concat('report', chr(10),
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('Hostname:  h', cast(c_custkey as string), chr(10)) END,
    CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('IP Address: 10.', cast(c_custkey % 250 as string), '.0.1', chr(10)) END,
    CASE WHEN c_custkey % 4 >= 1 THEN {_version("'9.2.0'")} ELSE '' END,
    CASE WHEN c_custkey % 4 >= 2 THEN {_version("concat('12.', cast(c_custkey % 3 as string))")} ELSE '' END,
    CASE WHEN c_custkey % 4 >= 3 THEN {_version("'9.2.0'")} ELSE '' END, chr(10), 'end') AS content
FROM customer"""

# Sheets: base rows per customer and lookup rows per supplier, with repeated and blank keys.
F4_BASE = """SELECT concat('sheet', cast(c_nationkey % 3 as string)) AS sheet, c_name AS host,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN concat(' k', cast(c_custkey as string), ' ')
    ELSE concat('k', cast(c_custkey as string)) END AS ip FROM customer"""
F4_LOOKUP = """SELECT 'A' AS sheet, l_orderkey * 10 + l_linenumber AS ord,
  CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE concat('k', cast(l_partkey as string)) END AS ip,
  l_returnflag AS status, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END AS note FROM lineitem"""

# Lines with a number marker on every third one, at the places the exploded documents have them.
F5_SPARK = """SELECT doc_id, cast(pos + 1 as int) AS line_no,
  CASE WHEN (pos + 1) % 3 = 0 THEN concat(cast((pos + 1) % 100 as string), CASE WHEN pos % 2 = 0 THEN '. ' ELSE ') ' END,
    line) ELSE line END AS line
FROM (SELECT doc_id, posexplode(split(text, chr(10))) AS (pos, line) FROM documents)"""
F5 = """SELECT doc_id, cast(pos + 1 as int) AS line_no,
  CASE WHEN (pos + 1) % 3 = 0 THEN concat(cast((pos + 1) % 100 as string), CASE WHEN pos % 2 = 0 THEN '. ' ELSE ') ' END,
    line) ELSE line END AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""

# Transcripts: assistant turns carry named code blocks; some projects repeat a path or leave their folder.
F6 = """SELECT conv_id AS project, turn,
  CASE WHEN role <> 'assistant' THEN text ELSE concat(text, chr(10), 'File: ',
    CASE WHEN conv_id % 7 = 0 THEN 'src/main.py' WHEN conv_id % 11 = 0 THEN '../x.py'
      ELSE concat('src/m', cast(turn as string), '.py') END,
    chr(10), '```python', chr(10), 'print(', cast(turn as string), ')', chr(10), chr(10), 'x = ',
    cast(conv_id as string), chr(10), '```', chr(10), 'File: notes.md', chr(10), '```', chr(10), 'turn ',
    cast(turn as string), chr(10), '```', chr(10), '### docs/a-b.txt', chr(10), '```text', chr(10), 'loose ',
    cast(turn as string), chr(10), '```') END AS text FROM conversations"""

# Sites of 40 pages: every page links two others of its site, a document, an image, another site and odd references.
_SITE = "cast(cast(floor(page_id / 40) as bigint) as string)"


def _page(offset: str) -> str:
    return f"concat('<a href=\"/p/', cast({offset} as string), '.html\">n</a>')"


SITES = f"""SELECT page_id, concat('https://www.site', {_SITE}, '.example.com/p/',
    cast(page_id % 40 as string), '.html') AS url,
  concat(html, {_page('(2 * (page_id % 40) + 1) % 40')}, '<A class=x HREF=''',
    cast((3 * (page_id % 40) + 2) % 40 as string), '.html#s''>m</A>',
    '<a href="/files/d', cast(page_id % 40 as string), '.pdf">f</a>',
    '<a href="../files/Report ', cast(page_id % 10 as string), '.DOCX?dl=1&amp;v=2">f</a>',
    '<img alt="i" src="//cdn.example.net/i', cast(page_id % 10 as string), '.PNG">',
    '<a href=mailto:a@b.c>w</a><a href="?q=', cast(page_id % 5 as string), '">q</a><a href="#top">t</a>',
    '<a href="https://www.site', cast(cast(floor(page_id / 40) as bigint) + 1 as string),
    '.example.com/p/0.html">o</a><!-- <a href="/gone.pdf">x</a> -->') AS html FROM pages"""

# Run log lines of downloads, with stack-trace noise.
F8 = """SELECT event_id, CASE
  WHEN event_id % 20 = 7 THEN concat('  File "x.py", line ', cast(event_id as string))
  WHEN event_id % 20 = 8 THEN concat('2024-01-02 03:04:05,', lpad(cast(event_id % 1000 as string), 3, '0'),
    ' - Error fetching https://h', cast(user_id as string), '.example.com/p: timed out')
  WHEN event_id % 20 = 9 THEN concat('2024-01-02 03:04:05,', lpad(cast(event_id % 1000 as string), 3, '0'),
    ' - Failed to download https://h', cast(user_id as string), '.example.com/d', cast(event_id as string), '.pdf - 404')
  WHEN event_id % 20 = 10 THEN concat('2024-01-02 03:04:05,', lpad(cast(event_id % 1000 as string), 3, '0'),
    ' - ERROR - Failed to download https://h', cast(user_id as string), '.example.com/e.pdf: timed out')
  WHEN event_id % 20 = 11 THEN concat('2024-01-02 03:04:05,', lpad(cast(event_id % 1000 as string), 3, '0'),
    ' - INFO - Downloaded https://h', cast(user_id as string), '.example.com/e.pdf -> out/e', cast(event_id as string))
  ELSE concat('2024-01-02 03:04:05,', lpad(cast(event_id % 1000 as string), 3, '0'), ' - Downloaded: https://h',
    cast(user_id as string), '.example.com/d', cast(event_id as string), '.pdf') END AS line FROM events"""

# Four overlapping collections of small text files out of parts; content differs where p_size is even.
_COPY = """SELECT {c} AS collection, concat('part', cast(p_partkey as string), '.txt') AS name,
  concat({c}, '/part', cast(p_partkey as string), '.txt') AS path,
  concat(p_name, chr(10), p_brand, chr(10), p_type, chr(10), cast(p_retailprice as string),
    CASE WHEN p_size % 2 = 0 THEN concat(chr(10), 'copy of ', {c}, chr(10), 'same') ELSE '' END) AS content
FROM part WHERE {m}"""
_HELD = {"main": "true", "old": "p_size > 10", "alt": "p_type <> 'ECONOMY'", "test": "p_size < 40"}
F9 = " UNION ALL ".join(_COPY.format(c=f"'{c}'", m=m) for c, m in _HELD.items())
COLLECTIONS = ["main", "old", "alt", "test"]

# Two versions of every document, a line per sentence: in the new one some lines are gone, changed, repeated or moved down by
# three, and some have a line in front.
def _versions(lines: str, aggregate: str) -> str:
    old = "replace(text, '. ', concat('.', chr(10)))"
    edited = """CASE WHEN (pos + doc_id) % 13 = 5 THEN concat(line, ' (edited)') WHEN (pos + doc_id) % 17 = 6 THEN
      concat('in front ', cast(pos % 3 as string), chr(10), line) WHEN (pos + doc_id) % 23 = 7 THEN concat(line, chr(10), line) ELSE line END"""
    return f"""SELECT concat('d', cast(doc_id as string), '.txt') AS name, 'old' AS collection, {old} AS content
      FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT concat('d', cast(doc_id as string), '.txt') AS name, 'new' AS collection, {aggregate} AS content
      FROM (SELECT doc_id, pos, {edited} AS edit, CASE WHEN (pos + doc_id) % 11 = 2 THEN pos * 10 + 35 ELSE pos * 10 END AS place
        FROM ({lines.format(old=old)}) WHERE (pos + doc_id) % 9 <> 4) GROUP BY doc_id"""


VERSIONS = _versions(
    """SELECT doc_id, unnest(string_split({old}, chr(10))) AS line,
      generate_subscripts(string_split({old}, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL""",
    "string_agg(edit, chr(10) ORDER BY place)",
)
VERSIONS_SPARK = _versions(
    """SELECT doc_id, p + 1 AS pos, line FROM (SELECT doc_id, posexplode(split({old}, chr(10))) AS (p, line) FROM documents
      WHERE text IS NOT NULL)""",
    "string_agg(edit, chr(10)) WITHIN GROUP (ORDER BY place)",
)

# Frames: three channel values per event; three events of a user share one frame time.
F10 = """SELECT user_id AS key, ts, cast(event_id % 3 * 45 + event_id % 11 as int) AS h,
  cast(90 + event_id % 160 as int) AS s, cast(80 + event_id % 170 as int) AS v FROM events"""

# Event types as labels: does each user view, then click, then purchase?
LABELS = """SELECT user_id AS key, ts, event_type AS label,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS label_order
FROM events WHERE event_type IN ('view', 'click', 'purchase')"""

NAMES = """SELECT concat(replace(p_name, ' ', '_'), '_', cast(p_size as string), '.csv') AS name FROM part"""

FIXTURES = {
    "f1": Fixture(["orders"], F1, text="raw_sql"),
    "f2": Fixture(["orders"], F2, F2_SPARK),
    "files": Fixture(["documents"], FILES),
    "named": Fixture(["documents"], NAMED),
    "f3": Fixture(["customer"], F3, text="content"),
    "f4_base": Fixture(["customer"], F4_BASE),
    "f4_lookup": Fixture(["lineitem"], F4_LOOKUP),
    "f5": Fixture(["documents"], F5, F5_SPARK),
    "f6": Fixture(["conversations"], F6, text="text"),
    "sites": Fixture(["pages"], SITES, text="html"),
    "f8": Fixture(["events"], F8, text="line"),
    "f9": Fixture(["part"], F9, text="content"),
    "versions": Fixture(["documents"], VERSIONS, VERSIONS_SPARK),
    "f10": Fixture(["events"], F10),
    "event_labels": Fixture(["events"], LABELS),
    "names": Fixture(["part"], NAMES),
}
