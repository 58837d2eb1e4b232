"""Identical files, similar names, scan history."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import delete_folder, durable, spread

CHUNK_BYTES = 1 << 20

HASHES = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "xxhash64": lambda c: F.lower(F.hex(F.xxhash64(c))),
}


def candidate_files(files: DataFrame, key: str = "name") -> DataFrame:
    """Files that share a cheap key with another one: (name, size), or size alone with ``key="content"``.

    Only metadata is grouped, with map-side counts; the semi join then keeps whole rows.
    """
    keys = {"name": ["name", "size"], "content": ["size"]}[key]
    shared = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    return files.join(shared, keys, "left_semi")


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hash of a text or binary column; NULL stays NULL."""
    return HASHES[algorithm](content)


def hash_paths(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Add ``hash`` and ``error`` to files known by path only, streamed in chunks where the task runs.

    For file trees: metadata decides the candidates first, and only their bytes are ever opened, of any size. A file that
    cannot be read keeps its row, with a NULL hash and the reason in ``error``.
    """

    def opened(path: str):
        scheme, found, rest = path.partition("://")
        if not found or scheme == "file":
            # Bare and file: paths are local or a mounted share; their names are taken as they are.
            return fs.LocalFileSystem(), rest if found else re.sub(r"^file:", "", path)
        scheme = re.sub(r"^s3[an]$", "s3", scheme)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/@:%')}")

    def digest(path: str) -> tuple[str | None, str | None]:
        try:
            system, inner = opened(path)
            hasher = hashlib.new(algorithm)
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    hasher.update(chunk)
            return hasher.hexdigest(), None
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [digest(p) for p in pdf["path"]]
            yield pdf.assign(hash=[h for h, _ in found], error=[e for _, e in found])

    schema = T.StructType([*files.schema.fields, T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())])
    return files.mapInPandas(batches, schema)


def with_hash(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    return files.withColumn("hash", content_hash(F.col("content"), algorithm)).filter(F.col("hash").isNotNull())


def identical_groups(files: DataFrame, key: str = "name", algorithm: str = "sha256") -> DataFrame:
    """(key, hash, number of files, first path) of every group of identical files. Contents that are in the table are
    hashed in the scan and never shuffled; for files known by path only, see ``candidate_files`` and ``hash_paths``."""
    keys = {"name": ["name", "size"], "content": ["size"]}[key]
    return (
        with_hash(files, algorithm)
        .groupBy(*keys, "hash")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))
        .filter("n_files > 1")
    )


def duplicate_rows(files: DataFrame, key: str = "name", algorithm: str = "sha256") -> DataFrame:
    """Flat report: hash, file, path and size of every member of every identical group."""
    keys = {"name": ["name", "size"], "content": ["size"]}[key]
    return duplicate_members(with_hash(files, algorithm), keys)


def duplicate_members(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (keys, hash) occurs more than once. The narrow hash rows are cut, so no content is read twice."""
    hashed = durable(hashed.filter("hash is not null").select("hash", "name", "path", "size"))
    groups = hashed.groupBy(*keys, "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = reduce(and_, [hashed[k].eqNullSafe(groups[k]) for k in [*keys, "hash"]])
    return hashed.join(groups, same, "left_semi")


@F.pandas_udf(T.DoubleType())
def _indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    def ratio(a: str, b: str) -> float:
        # Longest common subsequence with one bit per character of b (Hyyro 2004): zero bits mark its length.
        places: dict[str, int] = {}
        for i, ch in enumerate(b):
            places[ch] = places.get(ch, 0) | 1 << i
        full = (1 << len(b)) - 1
        row = full
        for ch in a:
            hit = row & places.get(ch, 0)
            row = (row + hit | row - hit) & full
        common = len(b) - row.bit_count()
        return 2 * common / (len(a) + len(b)) if a or b else 1.0

    return pd.Series([ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def name_similarity(left: Column, right: Column, metric: str = "levenshtein") -> Column:
    """0 to 100: normalised edit distance, or with ``indel`` the ratio that counts a substitution twice."""
    if metric == "levenshtein":
        longest = F.greatest(F.length(left), F.length(right))
        return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(left, right) / longest))
    if metric == "indel":
        return 100.0 * _indel_ratio(left, right)
    raise ValueError(f"unknown metric {metric!r}")


def is_similar(left: Column, right: Column, threshold: float = 80, metric: str = "levenshtein") -> Column:
    return name_similarity(left, right, metric) >= threshold


def _max_edits(short: Column, long: Column, threshold: float, metric: str) -> Column:
    allowed = (100 - threshold) / 100
    total = long if metric == "levenshtein" else short + long
    return F.floor(total * F.lit(allowed) + F.lit(1e-9)).cast("int")


def similar_names(names: DataFrame, threshold: float = 80, metric: str = "levenshtein") -> DataFrame:
    """Pairs of distinct names with similarity >= threshold, and how many files carry each.

    Names are counted first, so copies never multiply. Candidates come from segments (Li, Deng, Wang, Feng: Pass-Join,
    VLDB 2011): with at most d edits, one of d + 1 even segments of the longer name occurs in the shorter one close to
    its place. The join is an equi-join on (length, segment number, text) and loses no similar pair.
    """
    if not (0 if metric == "levenshtein" else 50) < threshold <= 100:
        raise ValueError("the segment filter needs a threshold above 0 (levenshtein) or 50 (indel)")
    distinct = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # Distinct names are few bytes but expand into many segments: keep them on all cores.
    distinct = spread(distinct.withColumn("size", F.length("name")).filter("size > 0"), force=True)
    allowed = (100 - threshold) / 100
    longest = 1 / (1 - allowed) if metric == "levenshtein" else (1 + allowed) / (1 - allowed)
    # Every length pair (short, long) that can reach the threshold, with its edit bound.
    lengths = F.sequence(F.col("size"), F.floor(F.col("size") * F.lit(longest) + F.lit(1e-9)).cast("int"))
    probe = distinct.select("name", "n", "size", F.explode(lengths).alias("long")).withColumn(
        "edits", _max_edits(F.col("size"), F.col("long"), threshold, metric)
    )
    # The longer side is cut by the bound of each shorter length it may meet, so both sides agree on the cut.
    shortest = F.greatest(F.ceil(F.col("size") / F.lit(longest) - F.lit(1e-9)).cast("int"), F.lit(1))
    index = distinct.select(
        F.col("name").alias("long_name"), F.col("n").alias("long_n"), F.col("size").alias("long"),
        F.explode(F.sequence(shortest, F.col("size"))).alias("size"),
    ).withColumn("edits", _max_edits(F.col("size"), F.col("long"), threshold, metric))

    def segments(df: DataFrame) -> DataFrame:
        cut = df.withColumn("parts", F.least(F.col("edits") + 1, F.col("long")))
        cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        base = F.floor(F.col("long") / F.col("parts")).cast("int")
        extra = F.col("long") - base * F.col("parts")
        start = F.col("part") * base + F.greatest(F.col("part") - (F.col("parts") - extra), F.lit(0))
        width = base + F.when(F.col("part") >= F.col("parts") - extra, 1).otherwise(0)
        return cut.withColumns({"start": start.cast("int"), "width": width.cast("int")})

    indexed = segments(index).select(
        "long_name", "long_n", "long", "size", "part",
        F.substr("long_name", F.col("start") + 1, F.col("width")).alias("segment"),
    )
    probed = segments(probe)
    low = F.greatest(F.col("start") - F.col("edits"), F.lit(0))
    high = F.least(F.col("start") + F.col("edits"), F.col("size") - F.col("width"))
    probed = (
        probed.filter(low <= high)
        .select("name", "n", "long", "size", "part", "width", F.explode(F.sequence(low, high)).alias("at"))
        .select("name", "n", "long", "size", "part", F.substr("name", F.col("at") + 1, F.col("width")).alias("segment"))
        .distinct()
    )
    pairs = (
        probed.join(indexed, ["long", "size", "part", "segment"])
        .filter((F.col("size") < F.col("long")) | (F.col("name") < F.col("long_name")))
        .select(
            F.least("name", "long_name").alias("name_a"),
            F.greatest("name", "long_name").alias("name_b"),
            F.when(F.col("name") < F.col("long_name"), F.col("n")).otherwise(F.col("long_n")).alias("n_a"),
            F.when(F.col("name") < F.col("long_name"), F.col("long_n")).otherwise(F.col("n")).alias("n_b"),
        )
        .distinct()
    )
    scored = pairs.withColumn("similarity", name_similarity(F.col("name_a"), F.col("name_b"), metric))
    return scored.filter(F.col("similarity") >= threshold)


def append_history(files: DataFrame, path: str, scan_date: Column | None = None) -> None:
    """Append (path, hash, scan_date) to a Parquet history partitioned by day."""
    stamped = files.select("path", "hash").withColumn("scan_date", scan_date if scan_date is not None else F.current_timestamp())
    stamped.withColumn("scan_day", F.to_date("scan_date")).write.mode("append").partitionBy("scan_day").parquet(path)


def latest_hash(history: DataFrame) -> DataFrame:
    """Last known hash of every path."""
    last = F.max(F.struct("scan_date", "hash"))
    return history.groupBy("path").agg(last.alias("last")).select("path", "last.hash", "last.scan_date")


HISTORY = "path string, hash string, scan_date timestamp"


class ScanHistory:
    """Hashes of paths over scans, in a folder of batches and a snapshot of the last hash of every path.

    A batch is a folder of its own, written over when the batch is run again, so a second run adds nothing. ``compact`` makes a
    new snapshot from the last one and the batches that it does not cover yet, whose names it keeps; a covered batch is not
    written again. A snapshot counts once it is whole, so an interrupted one changes nothing. The last hash of a path is that
    of the latest scan date, of equal dates the greatest hash. Frames of ``latest`` are to be read before the next ``compact``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, files: DataFrame, batch: str, scan_date: Column | None = None) -> None:
        """Write (path, hash) of one scan; with a ``scan_date`` column of their own, rows keep it."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"a batch is named by letters, digits and hyphens, not {batch!r}")
        if batch in self._covered():
            return
        at = scan_date if scan_date is not None else F.col("scan_date") if "scan_date" in files.columns else F.current_timestamp()
        rows = files.select("path", "hash", at.cast("timestamp").alias("scan_date"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")

    def latest(self) -> DataFrame:
        """(path, hash, scan_date): the snapshot and what batches after it say."""
        return latest_hash(self._known())

    def compact(self) -> None:
        """A new snapshot of all whole batches; the ones before it are deleted."""
        found, before = self._whole("batches"), self._whole("snapshots")
        covered = self._covered()
        path = f"{self.folder}/snapshots/{int(before[-1] if before else 0) + 1:09d}"
        latest_hash(self._known()).write.mode("overwrite").parquet(f"{path}/state")
        names = self.spark.createDataFrame([(b,) for b in sorted(covered | set(found))], "batch string")
        names.coalesce(1).write.mode("overwrite").parquet(path + "/covered")
        for old in before:
            delete_folder(self.spark, f"{self.folder}/snapshots/{old}")
        for batch in found:
            delete_folder(self.spark, f"{self.folder}/batches/{batch}")

    def _known(self) -> DataFrame:
        snapshots, covered = self._whole("snapshots"), self._covered()
        parts = [f"{self.folder}/snapshots/{snapshots[-1]}/state"] if snapshots else []
        parts += [f"{self.folder}/batches/{b}" for b in self._whole("batches") if b not in covered]
        if not parts:
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).parquet(*parts)

    def _covered(self) -> set[str]:
        """Names of all batches that went into the last snapshot; one name per scan ever made."""
        snapshots = self._whole("snapshots")
        if not snapshots:
            return set()
        return {r["batch"] for r in self.spark.read.parquet(f"{self.folder}/snapshots/{snapshots[-1]}/covered").collect()}

    def _whole(self, kind: str) -> list[str]:
        """Names of finished batches or snapshots, in order."""
        mark = {"batches": "*/_SUCCESS", "snapshots": "*/covered/_SUCCESS"}[kind]
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{mark}")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        up = 1 if kind == "batches" else 2
        return sorted(s.getPath().toString().split("/")[-1 - up] for s in system.globStatus(pattern) or [])
