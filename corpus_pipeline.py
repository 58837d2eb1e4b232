"""The corpus pipeline: quality rules, quality classifier, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns the columns of documents; the
last returns the packing plan. ``run`` writes each result to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import mixing, near_dups, packing, quality_model, quality_rules
from gleaner.llm.common import table, tokenizer_path
from gleaner.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words and go; a null in another column changes
    nothing; repeated rows are judged alike; an empty table stays empty."""
    return quality_rules.judge(docs).where("kept").select(COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. Nulls in other columns change nothing, rows without an id are
    scored but not learnt from; where no label says good all scores are 0.5, so that nothing is kept; an empty table stays
    empty."""
    return quality_model.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, of equal ids one row. Texts of fewer than five words are near only to equal
    ones; null texts count as empty; an empty table stays empty."""
    return near_dups.near_duplicates(docs).where("stays").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source like others; null and empty texts have
    size 0 and are never taken; an empty table stays empty."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place. Null and empty texts are their end id alone; rows with equal or
    null ids are packed each; an empty table stays empty."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), special="token")


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_model", classifier_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier, the signatures and the packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        kept = spark.read.parquet(path)
        if kept.isEmpty() and not docs.isEmpty():
            warnings.warn(f"stage {name} kept nothing of its input", RuntimeWarning, stacklevel=2)
        docs = kept
    return docs
