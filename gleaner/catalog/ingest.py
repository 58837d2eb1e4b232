"""Registered queries over file tables: filters, decoding, attributes, metrics, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog import duck as D
from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.catalog.fixtures import FIXTURES
from gleaner.functions import paths as P
from gleaner.session import shared_folder
from gleaner.sources import files as IN

FILES = {"files": "files"}
_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
KEYWORDS = ["Tion", "est"]
_KEYWORD = "(contains(lower(content), 'tion') OR contains(lower(content), 'est'))"


def _hidden(names: str) -> str:
    return f"regexp_matches(relative_path, '(^|/)(?:{names})/')"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Files as bytes: every fifth one in Latin-1, every seventh with a stray byte at its end."""
    plain = F.encode("content", "UTF-8")
    return fixture(spark, d, "files").select(
        "path",
        "doc_id",
        "size",
        F.when(F.col("doc_id") % 5 == 0, F.encode("content", "ISO-8859-1"))
        .when(F.col("doc_id") % 7 == 0, F.concat(plain, F.unhex(F.lit("FF"))))
        .otherwise(plain)
        .alias("raw"),
        F.length("content").alias("chars"),
    )


def _spoiled(spark: SparkSession, d: str) -> DataFrame:
    """Every file with stray bytes in front and at its end."""
    stray = F.unhex(F.lit("FFC3"))
    return fixture(spark, d, "files").select("doc_id", F.concat(stray, F.encode("content", "UTF-8"), stray).alias("raw"))


_NON_ASCII = "regexp_matches(content, '[^\\x00-\\x7F]')"


#: Lines of a file of the tree; a folder has as many files as it takes.
FILE_LINES = 10_000


def document_tree(spark: SparkSession, d: str) -> str:
    """The documents as a tree of text files in the shared folder: a folder per language and source, one line each. A hot
    source is dealt over tasks and files."""
    path = shared_folder(spark, "tree")
    lines = table(spark, d, "documents").select("lang", "source", F.translate("text", "\n", " ").alias("value"))
    lines.hint("rebalance", "lang", "source").write.option("maxRecordsPerFile", FILE_LINES).partitionBy("lang", "source").text(path)
    return path


TREE_SQL = """SELECT concat('lang=', lang, '/source=', source) AS folder, lang, sum(strlen(text) + 1)::BIGINT AS size
  FROM documents GROUP BY lang, source"""
ROOTS = ["lang=en", "lang=fr", "lang=none"]
SIZE_CAP = 20000


def _listed(spark: SparkSession, d: str, roots: list[str] | None = None, contents: bool = False) -> DataFrame:
    """The text files of the tree; what the writer leaves beside them is hidden or has another suffix."""
    tree = document_tree(spark, d)
    listed = IN.list_files(spark, [f"{tree}/{r}" for r in roots] if roots else tree, contents)
    return IN.filter_extension(IN.prune_dirs(listed), [".txt"])


def _folder() -> Column:
    return F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/", 1).alias("folder")


def _tree_failures(spark: SparkSession, d: str) -> DataFrame:
    """(folder, reason): a folder is oversize as a whole; else the reasons of its files count, each once."""
    files = _listed(spark, d, contents=True)
    sizes = files.groupBy(_folder()).agg(F.sum("size").alias("size"))
    whole = IN.scan_failures(sizes.select(F.col("folder").alias("path"), "size", F.lit(b"").alias("raw")), SIZE_CAP)
    whole = whole.withColumnRenamed("path", "folder")
    single = IN.scan_failures(files).select(_folder(), "reason").distinct().join(whole, "folder", "left_anti")
    return whole.unionByName(single)


QUERIES = [
    Query(
        "in1_list_files",
        lambda s, d: _listed(s, d)
        .groupBy(P.parent_dir(F.col("relative_path")).alias("folder"), P.extension(F.col("path")).alias("extension"))
        .agg(F.sum("size").alias("size")),
        f"SELECT folder, '.txt' AS extension, size FROM ({TREE_SQL})",
    ),
    Query(
        "in1_scan_text",
        # Every file ends with a line feed, behind which an empty line counts: once for a folder. "latin-1" sorts first.
        lambda s, d: IN.scan_files(s, document_tree(s, d))
        .groupBy(P.parent_dir(F.col("relative_path")).alias("folder"))
        .agg(
            F.sum("size").alias("size"),
            F.min("encoding").alias("encoding"),
            (F.sum(F.col("line_count") - 1) + 1).cast("int").alias("line_count"),
        ),
        """SELECT concat('lang=', lang, '/source=', source) AS folder, sum(strlen(text) + 1)::BIGINT AS size, 'utf-8' AS encoding,
          (count(*) + 1)::INT AS line_count FROM documents GROUP BY lang, source""",
    ),
    Query(
        "in2_filter_extension",
        lambda s, d: IN.filter_extension(
            fixture(s, d, "files"), IN.DEFAULT_EXTENSIONS, IN.EXCLUDED_EXTENSIONS
        ).select("path"),
        oracle(f"SELECT path FROM files WHERE {_SUFFIX} IN ('.sql', '.txt', '.log', '.bak')", **FILES),
    ),
    Query(
        "in3_prune_dirs",
        lambda s, d: IN.prune_dirs(fixture(s, d, "files")).select("path"),
        oracle(
            f"SELECT path FROM files WHERE NOT {_hidden(chr(92) + '.git|__pycache__|node_modules|' + chr(92) + '.[^/]*')}",
            **FILES,
        ),
    ),
    Query(
        "in4_filter_size",
        lambda s, d: IN.filter_size(fixture(s, d, "files"), 2000).select("path", "size"),
        oracle("SELECT path, size FROM files WHERE size <= 2000", **FILES),
    ),
    Query(
        "in5_decode_fallback",
        lambda s, d: IN.decode_text(_raw(s, d)).select("doc_id", "encoding", F.length("content").alias("chars")),
        oracle(
            f"""SELECT doc_id,
              CASE WHEN doc_id % 5 = 0 AND {_NON_ASCII} THEN 'latin-1' WHEN doc_id % 5 = 0 THEN 'utf-8'
                WHEN doc_id % 7 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
              (CASE WHEN doc_id % 5 = 0 THEN length(content) WHEN doc_id % 7 = 0 THEN strlen(content) + 1
                ELSE length(content) END)::INT AS chars FROM files""",
            **FILES,
        ),
    ),
    Query(
        "in6_decode_ignore",
        lambda s, d: IN.decode_text(_spoiled(s, d), "ignore").select("doc_id", "content"),
        oracle("SELECT doc_id, content FROM files", **FILES),
    ),
    Query(
        "in7_file_attrs",
        lambda s, d: IN.with_file_attrs(fixture(s, d, "files")).select(
            "path", "file_name", "folder", "extension", "size", "line_count"
        ),
        oracle(
            f"""SELECT path, {_NAME} AS file_name, regexp_replace(path, '/?[^/]*$', '') AS folder,
              {_SUFFIX} AS extension, size, {D.n_lines('content')}::INT AS line_count FROM files""",
            **FILES,
        ),
    ),
    Query(
        "in8_filter_keywords",
        lambda s, d: IN.filter_keywords(fixture(s, d, "files"), KEYWORDS).select("path"),
        oracle(f"SELECT path FROM files WHERE {_KEYWORD}", **FILES),
    ),
    Query(
        "in9_roots",
        lambda s, d: _listed(s, d, ROOTS)
        .groupBy(F.regexp_extract("root", "([^/]*)$", 1).alias("root"), _folder())
        .agg(F.sum("size").alias("size"))
        .groupBy("root")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size")),
        f"""SELECT 'lang=' || lang AS root, count(*) AS n_files, sum(size)::BIGINT AS size FROM ({TREE_SQL})
          WHERE lang IN ('en', 'fr') GROUP BY lang""",
    ),
    Query(
        "in10_scan_metrics",
        lambda s, d: IN.scan_metrics(fixture(s, d, "files"), KEYWORDS),
        oracle(
            f"""SELECT count(*) AS found, count(*) AS scanned, count(*) FILTER ({_KEYWORD}) AS matched,
              0::BIGINT AS failed, sum(size) FILTER ({_KEYWORD})::BIGINT AS total_bytes FROM files""",
            **FILES,
        ),
    ),
    Query(
        "in11_scan_failures",
        lambda s, d: IN.scan_failures(_raw(s, d), 20000),
        oracle(
            f"""SELECT * FROM (SELECT path, CASE WHEN size > 20000 THEN 'oversize' WHEN size = 0 THEN 'empty'
              WHEN doc_id % 5 = 0 AND {_NON_ASCII} THEN 'invalid_utf8'
              WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'invalid_utf8' END AS reason FROM files)
              WHERE reason IS NOT NULL""",
            **FILES,
        ),
    ),
    Query(
        "in11_tree_failures",
        _tree_failures,
        f"SELECT folder, 'oversize' AS reason FROM ({TREE_SQL}) WHERE size > {SIZE_CAP}",
    ),
    Query(
        "in12_filter_name",
        lambda s, d: IN.filter_name(fixture(s, d, "f3"), "Oracle_info.txt").select("path"),
        oracle(f"SELECT path FROM f3 WHERE lower({_NAME}) = 'oracle_info.txt'", f3="f3"),
    ),
    Query(
        "in13_collections",
        lambda s, d: IN.with_collection(fixture(s, d, "files")).groupBy("collection").agg(F.count("*").alias("n")),
        oracle("SELECT split_part(relative_path, '/', 1) AS collection, count(*) AS n FROM files GROUP BY 1", **FILES),
    ),
    Query(
        "in14_items",
        lambda s, d: IN.trim_items(fixture(s, d, "f5"), "line").groupBy("item").agg(F.count("*").alias("n")),
        oracle(
            f"SELECT item, count(*) AS n FROM (SELECT {D.trim_ws('line')} AS item FROM f5) WHERE item <> '' GROUP BY 1",
            f5=FIXTURES["f5"].sql,
        ),
    ),
    Query(
        "in15_source_manifest",
        lambda s, d: IN.source_manifest(fixture(s, d, "files"), "corpus"),
        oracle(
            f"""SELECT relative_path, 'corpus_SOURCE/' || relative_path AS target_path, size FROM files
              WHERE {_SUFFIX} IN ('.sql', '.py') AND NOT {_hidden('node_modules|' + chr(92) + '.git|venv')}""",
            **FILES,
        ),
    ),
]
