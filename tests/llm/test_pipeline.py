"""Each stage of the pipeline on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.test_near_dups import sets

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas().set_index("doc_id")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        from gleaner.session import durable

        after = durable(stage(spark, before, SF_DIR))
        if name != "packing":
            assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes)
        kept[name] = after.toPandas()
        before = after
    for name in ("quality_rules", "quality_model"):
        found = labels.loc[[d for d in kept[name].doc_id if d in labels.index]]
        assert (found.quality == 1).mean() > 0.95
    texts = kept["near_duplicates"].text.tolist()
    assert len(set(texts)) == len(texts)
    shingled = [sets(t) for t in texts]
    holders = {}
    for i, s in enumerate(shingled):
        near = Counter(j for x in s for j in holders.get(x, ()))
        assert not any(n >= 0.8 * len(s | shingled[j]) for j, n in near.items())
        for x in s:
            holders.setdefault(x, []).append(i)
    assert kept["mixing"].groupby("doc_id").size().max() <= 3
    packed = kept["packing"]
    assert Counter(packed[packed.piece == 0].doc_id) == Counter(kept["mixing"].doc_id)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
