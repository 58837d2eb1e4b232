"""File trees and file tables as sources.

File frames carry ``path``, ``relative_path``, ``size`` and, once read, ``content``. Spark's own listing skips names that
start with ``_`` or ``.`` and files without any byte; ``list_files`` adds them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import paths as P
from gleaner.functions.text import contains_any, count_lines, trim_ws
from gleaner.session import durable

# Default suffixes, pruned folders, size cap.
DEFAULT_EXTENSIONS = [".sql", ".txt", ".log", ".bak"]
EXCLUDED_EXTENSIONS = [".exe", ".dll", ".bin", ".jpg", ".png"]
EXCLUDED_DIRS = [".git", "__pycache__", "node_modules"]
DUPLICATE_EXCLUDED_DIRS = ["node_modules", ".git", "__pycache__", "venv", "bin", "obj"]
MAX_FILE_BYTES = 100 * 1024 * 1024  # of a sequential tool; no cap here unless asked for
# What counts as source code, and the folders a source export leaves out.
SOURCE_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".cpp", ".c", ".cs", ".java",
    ".php", ".go", ".rs", ".swift", ".kt", ".sql", ".json", ".xml", ".yaml", ".yml", ".md",
]
SOURCE_EXCLUDED_DIRS = [
    "node_modules", ".git", "dist", "build", "__pycache__", ".idea", ".vscode", "bin", "obj", "venv",
]
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class ScanOptions:
    extensions: list[str] | None = field(default_factory=lambda: list(DEFAULT_EXTENSIONS))
    exclude_extensions: list[str] = field(default_factory=lambda: list(EXCLUDED_EXTENSIONS))
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED_DIRS))
    drop_hidden: bool = True
    max_bytes: int | None = None
    keywords: list[str] = field(default_factory=list)


def _exists(spark: SparkSession, root: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    except Py4JJavaError:
        return False


#: Hadoop's names of schemes, and those of pyarrow.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
TREE = "root string, path string, kind string, size long, modified timestamp"


def _arrow_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path within it, what stands in front of that path in names of files)."""
    scheme, found, rest = path.partition("://")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), re.sub("^file:", "", rest if found else path), "file:"
    system, inner = fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")
    # An object store's paths begin with the bucket, others leave the host out.
    return system, inner, f"{scheme}://" + (rest.split("/")[0] if inner.startswith("/") else "")


def _leads_back(path: str) -> bool:
    """A link to one of the folders that it lies in."""
    return os.path.islink(path) and os.path.realpath(os.path.dirname(path)).startswith(os.path.realpath(path))


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of folders (root, path): files, folders, and a row of kind error for a folder that can't be read."""
    names = ["root", "path", "kind", "size", "modified"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    for batch in batches:
        for root, folder in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                system, inner, front = _arrow_system(folder)
                itself = system.get_file_info(inner)
                found = [itself] if itself.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
            except (OSError, ValueError) as error:
                yield made([(root, f"{folder}: {error}"[:1000], "error", None, None)])
                continue
            local = isinstance(system, fs.LocalFileSystem)
            rows = [
                (root, front + e.path, "folder" if e.type == fs.FileType.Directory else "file", e.size, e.mtime)
                for e in found
                if e.type != fs.FileType.NotFound and not (local and _leads_back(e.path))
            ]
            for at in range(0, len(rows), 10_000):
                yield made(rows[at : at + 10_000])


def list_tree(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """(root, path, kind, size, modified) of everything below the roots: files, folders, and folders that can't be read
    (kind error, with the reason in the path).

    Tasks list the folders of one level, which are a table; the folders found are the next one. The driver asks whether there
    is a next level and holds no names. A root that is a file is listed itself; a missing one is an error row. File systems are
    those that pyarrow opens, with its settings of credentials.
    """
    roots = [roots] if isinstance(roots, str) else roots
    level = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, path string")
    whole: DataFrame | None = None
    depth = 0
    while whole is None or not level.isEmpty():
        # Folders are dealt by a hash, so that those of one parent do not stay together.
        found = durable(level.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(_entries, TREE))
        level = found.filter("kind = 'folder'").select("root", "path")
        whole = found if whole is None else whole.unionByName(found)
        depth += 1
        if depth % 16 == 0:
            whole = durable(whole)
    return whole


def _hidden_below(root: Column, path: Column) -> Column:
    """A name below the root that starts with an underscore or a dot, which Spark's own listing skips."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substr(bare(path), F.length(F.regexp_replace(bare(root), "/+$", "")) + 1).rlike(r"/[_.]")


def _unlisted(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, modificationTime, length) of the files that Spark's own listing skips: below or with a name that starts with
    ``_`` or ``.``, and files without bytes."""
    files = list_tree(spark, roots).filter("kind = 'file'")
    skipped = files.filter((F.col("size") == 0) | _hidden_below(F.col("root"), F.col("path")))
    return skipped.select("path", F.col("modified").alias("modificationTime"), F.col("size").alias("length"))


def _unlisted_by_driver(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The same where only the session's own file system can open the roots: their names go through the driver."""
    jvm, found = spark._jvm, []
    for root in roots:
        start = jvm.org.apache.hadoop.fs.Path(root)
        system = start.getFileSystem(spark._jsc.hadoopConfiguration())
        base = system.getFileStatus(start).getPath().toString().rstrip("/")
        entries = system.listFiles(start, True)
        while entries.hasNext():
            entry = entries.next()
            name, size = entry.getPath().toString(), entry.getLen()
            if size == 0 or any(part[:1] in ("_", ".") for part in name[len(base) :].split("/") if part):
                found.append((name, datetime.fromtimestamp(entry.getModificationTime() / 1000, UTC), size))
    return spark.createDataFrame(found, "path string, modificationTime timestamp, length long")


def _opens(root: str) -> bool:
    """Whether pyarrow has a file system for the root."""
    try:
        _arrow_system(root)
    except (OSError, ValueError):
        return False
    return True


@F.pandas_udf(T.BinaryType())
def _bytes_at(paths: pd.Series) -> pd.Series:
    """Bytes of files by path; NULL where a file cannot be opened."""

    def read(path: str) -> bytes | None:
        try:
            system, inner, _ = _arrow_system(path)
            with system.open_input_stream(inner) as stream:
                return stream.read()
        except (OSError, ValueError):
            return None

    return paths.map(read)


def list_files(spark: SparkSession, roots: list[str] | str, contents: bool = True) -> DataFrame:
    """All files below the roots, whatever their names, empty ones included; bytes are read only where ``raw`` is used.
    Missing roots add nothing. A file that vanishes or turns out corrupt during the scan does not end it.

    Without ``contents`` there is no ``raw``, and the listing is that of ``list_tree`` alone: no list of names on the driver.
    """
    roots = [roots] if isinstance(roots, str) else roots
    present = [r for r in roots if _exists(spark, r)]
    by_tasks = all(map(_opens, present))
    if not present:
        files = spark.createDataFrame([], BINARY_SCHEMA)
    elif not contents and by_tasks:
        found = list_tree(spark, present).filter("kind = 'file'")
        files = found.select("path", F.col("modified").alias("modificationTime"), F.col("size").alias("length"))
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        files = reader.option("ignoreMissingFiles", "true").load(present)
        more = _unlisted(spark, present) if by_tasks else _unlisted_by_driver(spark, present)
        raw = F.when(F.col("length") == 0, F.lit(b"")).otherwise(_bytes_at("path"))
        files = files.unionByName(more.withColumn("content", raw))
    relative = F.coalesce(F.lit(None).cast("string"), *[P.strip_root(F.col("path"), r) for r in present])
    root = F.coalesce(
        F.lit(None).cast("string"), *[F.when(P.strip_root(F.col("path"), r).isNotNull(), F.lit(r)) for r in present]
    )
    return files.select(
        "path",
        root.alias("root"),
        relative.alias("relative_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        *([F.col("content").alias("raw")] if contents else []),
    )


def filter_extension(files: DataFrame, allow: list[str] | None, deny: list[str] | None = None) -> DataFrame:
    """The deny list wins, then the allow list; an empty allow list keeps every suffix."""
    suffix = P.extension(F.col("path"))
    kept = files.filter(~suffix.isin(deny)) if deny else files
    return kept.filter(suffix.isin([e.lower() for e in allow])) if allow else kept


def prune_dirs(files: DataFrame, deny: list[str] | None = None, drop_hidden: bool = True) -> DataFrame:
    """Drop files below an excluded or hidden folder; a given list replaces the default one."""
    return files.filter(
        ~P.has_dir(F.col("relative_path"), EXCLUDED_DIRS if deny is None else deny, drop_hidden)
    )


def filter_size(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return files if max_bytes is None else files.filter(F.col("size") <= max_bytes)


def filter_keywords(files: DataFrame, keywords: list[str]) -> DataFrame:
    return files.filter(contains_any(F.col("content"), keywords))


def filter_name(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.lower(P.base_name(F.col("path"))) == name.lower())


def with_collection(files: DataFrame) -> DataFrame:
    """Top folder below the root; files of the root itself belong to none and are dropped."""
    return files.withColumn("collection", P.top_folder(F.col("relative_path"))).filter(
        F.col("collection").isNotNull()
    )


def decode_text(files: DataFrame, errors: str = "fallback") -> DataFrame:
    """Text of ``raw`` bytes as ``content``, and the ``encoding`` used.

    ``fallback``: UTF-8, else Latin-1, which accepts every byte. ``replace``: UTF-8 with replacement characters.
    ``ignore``: bad bytes are dropped.
    """
    as_text = F.col("raw").cast("string")
    lossy = F.make_valid_utf8(as_text)
    if errors == "fallback":
        ok = F.is_valid_utf8(as_text)
        return files.withColumn(
            "content", F.when(ok, as_text).otherwise(F.decode("raw", "ISO-8859-1"))
        ).withColumn("encoding", F.when(ok, "utf-8").otherwise("latin-1"))
    if errors == "replace":
        return files.withColumn("content", lossy).withColumn("encoding", F.lit("utf-8"))
    if errors == "ignore":
        return files.withColumn("content", F.replace(lossy, F.lit("�"), F.lit(""))).withColumn(
            "encoding", F.lit("utf-8")
        )
    raise ValueError(f"unknown errors mode {errors!r}")


def with_file_attrs(files: DataFrame) -> DataFrame:
    """Name, folder, lower-case extension and line count."""
    return files.withColumns(
        {
            "file_name": P.base_name(F.col("path")),
            "folder": P.parent_dir(F.col("path")),
            "extension": P.extension(F.col("path")),
            "line_count": count_lines(F.col("content")),
        }
    )


def scan_files(spark: SparkSession, roots: list[str] | str, options: ScanOptions | None = None) -> DataFrame:
    """Files of one or many trees as decoded text rows; cheap metadata tests come before any byte is read."""
    o = options or ScanOptions()
    listed = filter_extension(list_files(spark, roots), o.extensions, o.exclude_extensions)
    listed = prune_dirs(listed, o.exclude_dirs, o.drop_hidden)
    if o.max_bytes is not None:
        listed = filter_size(listed, o.max_bytes)
    return filter_keywords(with_file_attrs(decode_text(listed).drop("raw")), o.keywords)


def scan_metrics(files: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """found, scanned, matched, failed and bytes over decoded files before the keyword filter.

    ``scanned`` counts every decoded file, ``matched`` and ``total_bytes`` those the keywords keep.
    """
    hit = contains_any(F.col("content"), keywords or [])
    read = F.col("content").isNotNull()
    return files.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(read).alias("scanned"),
        F.count_if(read & hit).alias("matched"),
        F.count_if(~read).alias("failed"),
        F.coalesce(F.sum(F.when(read & hit, F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def scan_failures(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, reason) of raw files that are oversize, empty, unreadable or not valid UTF-8; the scan itself goes on."""
    oversize = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    reason = (
        F.when(oversize, "oversize")
        .when(F.col("size") == 0, "empty")
        .when(F.col("raw").isNull(), "unreadable")
        .when(~F.is_valid_utf8(F.col("raw").cast("string")), "invalid_utf8")
    )
    return files.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def source_manifest(files: DataFrame, project: str = "project") -> DataFrame:
    """Source files with the place each one gets in an export that keeps relative paths."""
    kept = prune_dirs(filter_extension(files, SOURCE_EXTENSIONS), SOURCE_EXCLUDED_DIRS, drop_hidden=False)
    return kept.select(
        "relative_path", F.concat(F.lit(f"{project}_SOURCE/"), "relative_path").alias("target_path"), "size"
    )


def trim_items(lines: DataFrame, column: str = "value") -> DataFrame:
    """One item per line, trimmed, blank lines dropped."""
    return lines.select(trim_ws(F.col(column)).alias("item")).filter(F.col("item") != "")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return trim_items(spark.read.text(path))
