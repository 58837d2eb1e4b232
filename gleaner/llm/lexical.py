"""Ranked lexical search: every item against all documents, by dense blocked multiplication.

The terms of a block of items are its vocabulary. One pass over the documents counts them (and every document's length); the
counts give document frequencies and, with them, weights. A second pass over these counts takes 1024 documents at a time: the
terms that occur among them are cut into tiles, the impacts and the item weights of a tile are laid out densely, multiplied in
float64, and added up as 64-bit integers. A tile is as wide as keeps every partial sum below 2^53, so all products are exact.
Each task keeps its best documents of every item, with ties at the cut decided by document id; a window decides between tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from gleaner.llm.common import remade
from gleaner.operators.skew import number_rows
from gleaner.session import durable, release

#: Items are ranked in blocks whose texts have at most so many bytes together (a longer item is a block of its own).
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 1_000
DOCUMENT_TILE = 1024
TERM_TILE = 2048
EXACT = 2**53
IMPACT_SCALE, IMPACT_TF, IMPACT_LENGTH = 1_000_000_000, 1_000, 20
TOP = 50

#: Bytes of terms: ASCII letters and digits (A-Z in lower case) and whatever is not ASCII; all others are blanks.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text as UTF-8, with repeats; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def impact(tf: np.ndarray, scaled_length: np.ndarray) -> np.ndarray:
    return IMPACT_SCALE * tf // (IMPACT_TF * tf + IMPACT_LENGTH * scaled_length)


def scaled_length(n: int, documents: int, terms: int) -> int:
    """Half of it is fixed, half the length in per cent of the mean."""
    return 100 - 50 + (50 * n * documents) // terms


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


@dataclass(frozen=True)
class ItemBlock:
    """Items of one block: their row numbers, the numbers of their terms, and for each term the items that hold it."""

    rows: np.ndarray
    vocabulary: dict[bytes, int]
    holders: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(rows: list[int], texts: list[str | None]) -> ItemBlock:
        vocabulary: dict[bytes, int] = {}
        numbers = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(x))] for x in texts]
        terms = np.array([t for own in numbers for t in own], np.int64)
        items = np.repeat(np.arange(len(rows)), [len(own) for own in numbers])
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(vocabulary)))])
        return ItemBlock(np.array(rows, np.int64), vocabulary, items[np.argsort(terms, kind="stable")], starts)

    def tile(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Items x terms, dense: the weight of each term in the items that hold it."""
        dense = np.zeros((len(self.rows), len(terms)))
        sizes = self.starts[terms + 1] - self.starts[terms]
        column = np.repeat(np.arange(len(terms)), sizes)
        within = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        dense[self.holders[np.repeat(self.starts[terms], sizes) + within], column] = np.repeat(weights[terms], sizes)
        return dense


def tile_width(weights: np.ndarray) -> int:
    """Terms of a tile: no sum over so many weights, each times the largest impact, reaches 2^53."""
    most = max(int(weights.max(initial=1)), 1) * (IMPACT_SCALE // IMPACT_TF)
    return max(1, min(TERM_TILE, (EXACT - 1) // most))


def count_terms(docs: DataFrame, block: Broadcast, key: str, text: str) -> DataFrame:
    """(key, n, terms, counts): the length of each document and how often it holds each term of the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = block.value.vocabulary.get
        for batch in remade(batches, 256):
            n, terms, counts, ends = [], [], [], [0]
            for value in batch.column(1):
                words = terms_of(value.as_py())
                held = Counter(map(find, words))
                held.pop(None, None)
                n.append(len(words))
                terms += held.keys()
                counts += held.values()
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["key", "n", "terms", "counts"])

    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def tile_scores(block: ItemBlock, weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, owner: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores (items x documents, 64-bit integers) of a tile of documents given as (term, count, document) triples."""
    value, width = impact(counts, m[owner]), tile_width(weights)
    by = np.argsort(terms, kind="stable")
    terms, value, owner = terms[by], value[by], owner[by]
    held, first = np.unique(terms, return_index=True)
    ends = np.append(first, len(terms))
    scores = np.zeros((len(block.rows), len(m)), np.int64)
    for at in range(0, len(held), width):
        part = held[at : at + width]
        low, high = ends[at], ends[at + len(part)]
        impacts = np.zeros((len(part), len(m)))
        impacts[np.searchsorted(part, terms[low:high]), owner[low:high]] = value[low:high]
        scores += (block.tile(part, weights) @ impacts).astype(np.int64)
    return scores


def best_of(scores: np.ndarray, order: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) of the ``top`` largest positive scores of each row; among equal ones the first by ``order``."""
    if scores.shape[1] > top:
        cut = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top, None]
    else:
        cut = np.zeros((len(scores), 1), np.int64)
    items, docs = np.nonzero((scores >= cut) & (scores > 0))
    # Rows with many ties at the cut are brought down to ``top`` here.
    by = np.lexsort((order[docs], -scores[items, docs], items))
    items, docs = items[by], docs[by]
    place = np.arange(len(items)) - np.searchsorted(items, items)
    return items[place < top], docs[place < top]


def best_rows(found: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows of each item out of the best of several tiles; null keys come last."""
    found = found.sort_by([("row", "ascending"), ("score", "descending"), ("key", "ascending")])
    rows = found.column("row").to_numpy()
    return found.filter(pa.array(np.arange(len(rows)) - np.searchsorted(rows, rows) < top))


def ranked_block(counted: DataFrame, shared: Broadcast, weights: Broadcast, documents: int, terms: int, top: int) -> DataFrame:
    """(row, key, score): of every task's documents the best of each item of the block."""

    def rank(batch: pa.RecordBatch) -> pa.Table:
        block, key, lists = shared.value, batch.column(0), batch.column(2)
        m = np.array([scaled_length(n, documents, terms) for n in batch.column(1).to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy(zero_copy_only=False))
        held, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        scores = tile_scores(block, weights.value, held, counts, owner, m)
        order = np.empty(len(m), np.int64)
        order[pc.array_sort_indices(key, null_placement="at_end").to_numpy()] = np.arange(len(m))
        items, docs = best_of(scores, order, top)
        return pa.table({"row": block.rows[items], "key": key.take(pa.array(docs)), "score": scores[items, docs]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in remade(batches, DOCUMENT_TILE):
            fresh = rank(batch)
            best = fresh if best is None else pa.concat_tables([best, fresh])
            if best.num_rows > 4 * top * len(shared.value.rows):
                best = best_rows(best, top)
        if best is not None:
            yield from best_rows(best, top).combine_chunks().to_batches()

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", counted.schema["key"].dataType), T.StructField("score", T.LongType())])
    return counted.select("key", "n", "terms", "counts").mapInArrow(run, schema)


def item_blocks(items: DataFrame, text: str) -> Iterator[ItemBlock]:
    """Blocks of items by row number, one at a time: the driver holds the texts of one block."""
    sized = items.select("row", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("size"))
    # Blocks are runs of rows within a fixed number of rows, cut where the bytes before them pass a multiple of the limit.
    run = F.floor(F.col("row") / BLOCK_ITEMS)
    before = F.sum("size").over(W.partitionBy(run).orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    bounds = (
        sized.withColumn("run", run)
        .withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_BYTES))
        .groupBy("run", "part")
        .agg(F.min("row").alias("low"), F.max("row").alias("high"))
        .orderBy("low")
    )
    for low, high in bounds.select("low", "high").toLocalIterator():
        rows = items.where(F.col("row").between(low, high)).select("row", F.col(text).alias("text")).orderBy("row").collect()
        yield ItemBlock.of([r["row"] for r in rows], [r["text"] for r in rows])


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP
) -> DataFrame:
    """Each item's ``top`` documents by score, (item_id, rank, doc_id, score), best first, equal scores by ascending id.

    Documents with a score above 0 take part, however many there are; an item without terms, or with terms that no document
    holds, has no rows, as has a null text on either side. Repeated items are ranked each; repeated documents take a rank each;
    a null document id comes last among equal scores, and a null item id is returned as it is. Empty tables give no rows, and
    other columns are not read. All counts are those of the whole table of documents.
    """
    spark = docs.sparkSession
    numbered = number_rows(items.select(F.col(item_id).alias("item"), F.col(text).alias("text")), [], ["item", "text"], "row")
    numbered = durable(numbered.select("row", "item", "text"))
    found: DataFrame | None = None
    for block in item_blocks(numbered, "text"):
        shared = spark.sparkContext.broadcast(block)
        counted = durable(count_terms(docs, shared, doc_id, text))
        totals = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
        documents, terms = totals["documents"], totals["terms"] or 0
        frequency = np.zeros(len(block.vocabulary), np.int64)
        # At most one row per term of the block.
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequency[term] = n
        weights = np.array([weight(documents, f) if f else 0 for f in frequency.tolist()], np.int64)
        if frequency.any():
            best = durable(ranked_block(counted, shared, spark.sparkContext.broadcast(weights), documents, terms, top))
            found = best if found is None else found.unionByName(best)
        release(counted)
    if found is None:
        nothing = docs.select(F.col(doc_id).alias("key")).where(F.lit(False))
        found = nothing.select(F.lit(0).cast("long").alias("row"), "key", F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(numbered.select("row", "item"), "row").select(
        F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("key").alias(doc_id), "score"
    )
