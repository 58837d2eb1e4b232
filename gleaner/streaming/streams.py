"""Structured Streaming forms: arrivals and changes of files, first-wins de-duplication, sequence validation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.sequences import EXPECTED

LISTING = "path string, modified timestamp, size long, listed timestamp"
CHANGES = "path string, change string, modified long, size long, at long"
#: Groups of paths whose last listing is one entry of the state.
BUCKETS = 1 << 14


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query with arbitrary state is started: the state store that such queries need. A running query keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Changes(StatefulProcessor):
    """What the last listing said of every path of a bucket, with times in microseconds. A timer for every time at which one of
    them was last listed tells that those not listed since are gone."""

    def __init__(self, keep: timedelta):
        self.keep = keep // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "path array<string>, modified array<long>, size array<long>, listed array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self._known()
        before, news = self._ends(known), False
        for row in sorted(rows, key=lambda r: (r.listed_us, r.modified_us is not None, r.modified_us or 0, r.size or 0)):
            seen = known.get(row.path)
            if seen is not None and row.listed_us <= seen[2]:
                continue  # a listing that comes late, or says the same path twice
            if seen is None or (row.modified_us, row.size) != seen[:2]:
                yield Row(path=row.path, change="modified" if seen else "created", modified=row.modified_us, size=row.size, at=row.listed_us)
            known[row.path] = (row.modified_us, row.size, row.listed_us)
            news = True
        if news:
            self._remember(known)
            after = self._ends(known)
            for end in before - after:
                self.handle.deleteTimer(end)
            for end in after - before:
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        end, known = expiredTimerInfo.getExpiryTimeInMs(), self._known()
        for path in [path for path, (_, _, listed) in known.items() if self._end(listed) == end]:
            modified, size, _ = known.pop(path)
            yield Row(path=path, change="deleted", modified=modified, size=size, at=end * 1000)
        self._remember(known)

    def _known(self) -> dict[str | None, tuple[int | None, int | None, int]]:
        held = self.last.get()
        return {path: (modified, size, listed) for path, modified, size, listed in zip(*held, strict=True)} if held else {}

    def _remember(self, known: dict[str | None, tuple[int | None, int | None, int]]) -> None:
        if known:
            self.last.update(([*known], *([*column] for column in zip(*known.values(), strict=True))))
        else:
            self.last.clear()

    def _end(self, listed_us: int) -> int:
        return listed_us // 1000 + self.keep

    def _ends(self, known: dict[str | None, tuple[int | None, int | None, int]]) -> set[int]:
        return {self._end(listed) for _, _, listed in known.values()}

    def close(self) -> None:
        pass


def file_changes(listings: DataFrame, keep: timedelta, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """created, modified and deleted files out of a stream of listings (path, modified, size, listed): (path, change,
    modified, size, at).

    ``listed`` is the event time, the same for all rows of a listing. A path is modified when its time or size differs from the
    listing before; it is deleted, and forgotten, when no listing had it for ``keep`` of event time, so the state has an entry
    for every path that still exists. An unchanged path gives nothing, nor does a restart from the same checkpoint. Paths are
    held in ``buckets`` by their hash, since a listing has all paths and a bucket is read and written as one; a checkpoint
    stays with its number of buckets. The query has to be started within ``keyed_state``.
    """
    timed = listings.withWatermark("listed", delay).select(
        F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"),
        "path", "listed", "size", F.unix_micros("modified").alias("modified_us"), F.unix_micros("listed").alias("listed_us"),
    )
    changes = timed.groupBy("bucket").transformWithState(
        _Changes(keep), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("modified", "at")})


def append_listing(files: DataFrame, folder: str, listed: Column) -> None:
    """One listing (path, modified, size) as a new table in the folder that a stream of listings reads."""
    files.select("path", "modified", "size", listed.cast("timestamp").alias("listed")).write.mode("append").parquet(folder)


def listing_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The listings that ``append_listing`` writes, oldest first."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)


def arrivals(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream with one row per new file below ``path``; ``file_changes`` also tells of edits in place and of deletions."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    )


def dedup_stream(statements: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of every fingerprint within the watermark delay; state is bounded by that delay."""
    return statements.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def _valid(times: list[Column]) -> Column:
    ok = times[0].isNotNull()
    for earlier, later in zip(times, times[1:]):
        ok = ok & later.isNotNull() & (earlier <= later)
    return F.coalesce(ok, F.lit(False))


def validate_sequence_stream(labels: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """(key, valid) from the first time of each expected label, in update mode.

    A first time only ever moves earlier, so the aggregate is exact without a watermark; the state is one row per key.
    ``expected`` must list labels in declaration order, which settles equal times as the batch form does. As there, a label
    that is not expected makes the sequence invalid.
    """
    expected = expected or EXPECTED
    firsts = labels.groupBy("key").agg(
        *[F.min(F.when(F.col("label") == label, F.col("ts"))).alias(f"t{i}") for i, label in enumerate(expected)],
        F.min(F.when(~F.col("label").isin(expected), F.col("ts"))).alias("other"),
    )
    valid = _valid([F.col(f"t{i}") for i in range(len(expected))]) & F.col("other").isNull()
    return firsts.select("key", valid.alias("valid"))


def validate_sessions(labels: DataFrame, gap: str, expected: list[str] | None = None) -> DataFrame:
    """(key, first, last, valid) of each run of labels of a key without a pause of ``gap``, in batch and as a stream.

    On a stream with a watermark on ``ts``, in append mode, a run is given out when the watermark has passed its last label by
    ``gap``, and its state is dropped then: the state has a row per open run, however many keys there have been. Validity is
    that of ``validate_sequence``, taken over the labels of the run.
    """
    expected = expected or EXPECTED
    runs = labels.groupBy("key", F.session_window("ts", gap).alias("run")).agg(
        *[F.min(F.when(F.col("label") == label, F.col("ts"))).alias(f"t{i}") for i, label in enumerate(expected)],
        F.min(F.when(~F.col("label").isin(expected), F.col("ts"))).alias("other"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    valid = _valid([F.col(f"t{i}") for i in range(len(expected))]) & F.col("other").isNull()
    return runs.select("key", "first", "last", valid.alias("valid"))
