"""Registered queries over event sequences and arrivals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog.base import Query, fixture, oracle, table
from gleaner.catalog.fixtures import FIXTURES
from gleaner.catalog.ingest import TREE_SQL, document_tree
from gleaner.operators import sequences as SE
from gleaner.session import shared_folder
from gleaner.streaming.streams import (
    append_listing,
    arrivals,
    file_changes,
    keyed_state,
    listing_stream,
    validate_sequence_stream,
    validate_sessions,
)

_BANDS = """SELECT DISTINCT key, ts, b.label_order, b.label FROM f10 JOIN (VALUES
  (0, 'red', 0, 10), (1, 'green', 35, 85), (2, 'blue', 100, 130)) b(label_order, label, low, high)
  ON f10.h BETWEEN b.low AND b.high AND f10.s BETWEEN 100 AND 255 AND f10.v BETWEEN 100 AND 255"""


def _firsts(source: str) -> str:
    return f"SELECT key, label_order, label, min(ts) AS first_ts FROM {source} GROUP BY ALL"


_DETECTED = "SELECT key, string_agg(label, ',' ORDER BY first_ts, label_order) AS detected FROM firsts GROUP BY key"
FRAMES = {"f10": "f10", "labels_seen": _BANDS, "firsts": _firsts("labels_seen"), "found": _DETECTED}
EVENTS = {"event_labels": "event_labels", "firsts": _firsts("event_labels"), "found": _DETECTED}
EXPECTED_EVENTS = ["view", "click", "purchase"]


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    out = shared_folder(spark, "arrivals")
    query = (
        arrivals(spark, document_tree(spark, d))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    arrived = spark.read.schema("path string, modified timestamp, size long").parquet(out)
    folder = F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/", 1).alias("folder")
    return arrived.groupBy(folder).agg(F.sum("size").alias("size"))


def _validated(spark: SparkSession, d: str, expected: list[str]) -> DataFrame:
    """The event table arrives as a stream; every update is written with its batch, the last one of each key is read back."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    source.createOrReplaceTempView("events")
    updates = validate_sequence_stream(spark.sql(FIXTURES["event_labels"].sql), expected)
    out = shared_folder(spark, "sequences")
    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}"))
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema("key long, valid boolean, batch long").parquet(out)
    return found.groupBy("key").agg(F.max_by("valid", "batch").alias("valid"))


# Four hourly listings of the documents as files. Some come with the second, some are edited for the third (half of them to
# the same size), some are missing from the third on and one part of these is back in the fourth.
HOURS, KEEP = 4, timedelta(minutes=90)
_LISTED = """SELECT concat('docs/', source, '/', cast(doc_id as string), '.txt') AS path,
  CASE WHEN {hour} >= 2 AND doc_id % 7 = 1 THEN n_chars + doc_id % 2 ELSE n_chars END AS size,
  CASE WHEN {hour} >= 2 AND doc_id % 7 = 1 THEN {edited} ELSE {written} END AS modified
FROM documents WHERE NOT ({hour} = 0 AND doc_id % 5 = 2) AND NOT ({hour} >= 2 AND doc_id % 11 = 3 AND NOT ({hour} = 3 AND doc_id % 2 = 0))"""
_T = "timestamp '2024-05-01 {h:02d}:00:00'"
_CHANGES = """SELECT path, CASE WHEN before IS NULL THEN 'created' ELSE 'modified' END AS change, size, hour
  FROM (SELECT *, lag(hour) OVER w AS before, lag(size) OVER w AS old_size, lag(modified) OVER w AS old_time
    FROM listed WINDOW w AS (PARTITION BY path ORDER BY hour))
  WHERE before IS NULL OR old_size <> size OR old_time <> modified
UNION ALL SELECT path, 'deleted', arg_max(size, hour), max(hour) FROM listed GROUP BY path HAVING max(hour) = 1"""


def _listing(hour: int) -> str:
    return _LISTED.format(hour=hour, written=_T.format(h=0), edited=_T.format(h=2))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Listing by listing, with a restart of the stream before every one."""
    folder, out = shared_folder(spark, "listings"), shared_folder(spark, "changes")
    table(spark, d, "documents").createOrReplaceTempView("documents")
    for hour in range(HOURS):
        append_listing(spark.sql(_listing(hour)), folder, F.expr(_T.format(h=10 + hour)))
        with keyed_state(spark):
            query = (
                file_changes(listing_stream(spark, folder), KEEP)
                .writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", out + "-state")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    found = spark.read.schema("path string, change string, modified timestamp, size long, at timestamp").parquet(out)
    # A deletion is told 90 minutes after the last listing that had the file.
    hour = F.when(F.col("change") == "deleted", F.col("at") - F.expr("interval 90 minutes")).otherwise(F.col("at"))
    return found.select("path", "change", "size", (F.hour(hour) - 10).alias("hour"))


GAP, DELAY = "2 hours", "10 minutes"
_RUNS = f"""SELECT key, ts, label, label_order, sum(CASE WHEN ts - before < INTERVAL {GAP} THEN 0 ELSE 1 END)
    OVER (PARTITION BY key ORDER BY ts, label_order) AS run
  FROM (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, label_order) AS before FROM event_labels)"""
_SESSIONS = """SELECT key, min(first_ts) AS first, max(last_ts) AS last,
    string_agg(label, ',' ORDER BY first_ts, label_order) = 'view,click,purchase' AS valid
  FROM (SELECT key, run, label, label_order, min(ts) AS first_ts, max(ts) AS last_ts FROM runs GROUP BY ALL) GROUP BY key, run"""
SESSIONS = {"event_labels": "event_labels", "runs": _RUNS, "sessions": _SESSIONS}
_CLOSED = f"""last + INTERVAL {GAP} <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {DELAY} FROM event_labels)"""
_TIMES = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ("first", "last"))


def _with_times(runs: DataFrame) -> DataFrame:
    return runs.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first", "last")})


def _sessions_stream(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    source.createOrReplaceTempView("events")
    labels = spark.sql(FIXTURES["event_labels"].sql).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)
    out = shared_folder(spark, "sessions")
    query = (
        validate_sessions(labels, GAP, EXPECTED_EVENTS)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _with_times(spark.read.schema("key long, first timestamp, last timestamp, valid boolean").parquet(out))


QUERIES = [
    Query(
        "st1_changes",
        _changes,
        "WITH listed AS ("
        + " UNION ALL ".join(f"SELECT *, {h} AS hour FROM ({_listing(h)})" for h in range(HOURS))
        + f") SELECT path, change, size, hour FROM ({_CHANGES})",
    ),
    Query(
        "st4_validate_sessions",
        lambda s, d: _with_times(validate_sessions(fixture(s, d, "event_labels"), GAP, EXPECTED_EVENTS)),
        oracle(f"SELECT key, {_TIMES}, valid FROM sessions", **SESSIONS),
    ),
    Query(
        "st4_validate_sessions_stream",
        _sessions_stream,
        oracle(f"SELECT key, {_TIMES}, valid FROM sessions WHERE {_CLOSED}", **SESSIONS),
    ),
    Query("st1_arrivals", _arrivals, f"SELECT folder, size FROM ({TREE_SQL})"),
    Query(
        "st4_validate_stream",
        lambda s, d: _validated(s, d, EXPECTED_EVENTS),
        oracle("SELECT key, detected = 'view,click,purchase' AS valid FROM found", **EVENTS),
    ),
    Query(
        "st4_validate_stream_part",
        lambda s, d: _validated(s, d, EXPECTED_EVENTS[:2]),
        oracle("SELECT key, detected = 'view,click' AS valid FROM found", **EVENTS),
    ),
    Query(
        "st2_label_bands",
        lambda s, d: SE.label_bands(fixture(s, d, "f10")).withColumn(
            "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        oracle(
            "SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, label_order, label FROM labels_seen", **FRAMES
        ),
    ),
    Query(
        "st3_first_occurrences",
        lambda s, d: SE.first_occurrences(SE.label_bands(fixture(s, d, "f10"))).select(
            "key", F.array_join("detected", ",").alias("detected")
        ),
        oracle("SELECT key, detected FROM found", **FRAMES),
    ),
    Query(
        "st4_validate_frames",
        lambda s, d: SE.validate_sequence(SE.label_bands(fixture(s, d, "f10"))).select("key", "valid"),
        oracle("SELECT key, detected = 'red,green,blue' AS valid FROM found", **FRAMES),
    ),
    Query(
        "st4_validate_events",
        lambda s, d: SE.validate_sequence(fixture(s, d, "event_labels"), EXPECTED_EVENTS).select("key", "valid"),
        oracle("SELECT key, detected = 'view,click,purchase' AS valid FROM found", **EVENTS),
    ),
]
