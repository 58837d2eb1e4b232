"""Token ids as Parquet files made for selective reads.

One row per document, in ascending order over all files: doc_id, n_tokens and start by delta encoding, the ids as a list
column by dictionary encoding (its writer falls back to delta encoding where the dictionary grows too large). Row groups
and pages are small enough that page indexes lead a reader of some documents to their pages, and counts are read without
touching the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.llm.common import by_bytes, memo_tokenizer

END_ID = 2
#: Stretches of text that a worker remembers the ids of, in each of two generations (about 100 MB).
MEMO_ENTRIES = 450_000
#: Bytes of a row group and of a page, and rows of a page: the page index has one entry per page.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000
#: Offsets of partitions are broadcast; there is one row per file.
MAX_BROADCAST_FILES = 1_000_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, special: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the files in ascending doc_id order, null ids
    first, ties by the text's hash; ``special`` as in MemoTokenizer. Only doc_id and text are read of ``docs``. An empty table gives files without rows."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = memo_tokenizer(tokenizer, MEMO_ENTRIES, special)
        at = 0
        for batch in by_bytes(batches, 1):
            ids, ends = coder.encode_column(batch.column(1), end_id)
            n = np.diff(ends, prepend=0)
            flat = pa.array(ids.view("<i4"))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(at + ends - n), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n_tokens", "start_in_file", "ids"],
            )
            at += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "_tie"]
    sorted_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    coded = sorted_docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, start_in_file long, ids array<int>")
    (
        coded.select("doc_id", F.spark_partition_id().alias("file_no"), "n_tokens", "start_in_file", "ids")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#start_in_file", "false")
        .parquet(path)
    )


def read_token_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of all documents; the ids are not read."""
    files = spark.read.parquet(path)
    sums = files.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    small = sums.count() <= MAX_BROADCAST_FILES
    joined = files.join(F.broadcast(offsets) if small else offsets, "file_no")
    return joined.withColumn("start", F.col("before") + F.col("start_in_file")).drop("before", "file_no", "start_in_file")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; a filter on doc_id reads only the row groups and pages that hold it."""
    return read_token_counts(spark, path).select("doc_id", "start", "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
