"""Targets, balance and repeatability of the mix."""

from __future__ import annotations

import numpy as np
import pytest

from gleaner.llm import mixing
from gleaner.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_query(spark):
    got = QUERIES["op6_mixing"](spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both["size"] == both.text.map(lambda t: len(t.encode().split()))).all()
    sizes = both.groupby("source")["size"].sum().to_dict()
    want = plain_targets(sizes)
    assert np.allclose(both.target, both.source.map(want)) and (both.source_size == both.source.map(sizes)).all()
    assert (both.taken % both["size"].clip(lower=1) == 0).all() and (both.taken <= 3 * both["size"]).all()
    taken = both.groupby("source").taken.sum()
    largest = both.groupby("source")["size"].max()
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    again = QUERIES["op6_mixing"](spark, SF_DIR).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_capped_sources_hot_source_and_nulls(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "big", int(rng.integers(1, 50))) for i in range(6000)] + [(i, "a", 3) for i in range(30)] + [(i, "B", 4) for i in range(20)]
    rows += [(None, None, 5)] * 4 + [(7, "zero", 0), (7, "zero", 0), (None, "big", 9)]
    units = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(units).toPandas()
    assert len(got) == len(rows)
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}
    want = plain_targets(sizes)
    for s, part in got.groupby(got.source.fillna("~")):
        s = None if s == "~" else s
        assert part.target.iloc[0] == pytest.approx(want[s]) and (part.taken <= 3 * part["size"]).all()
        assert abs(part.taken.sum() - want[s]) <= 2 * part["size"].max()
    again = mixing.mix(units.repartition(7)).toPandas()
    order = ["source", "doc_id", "size", "row"]
    assert got.sort_values(order).taken.tolist() == again.sort_values(order).taken.tolist()
    assert mixing.mix(units.limit(0)).count() == 0


def test_flight_keeps_both_totals_and_the_probabilities():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 2000, 300)
    hits = np.zeros(300)
    for seed in range(300):
        p = mixing.fly(np.full(300, 0.37), size, np.random.default_rng(seed))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(0.37 * 300, abs=1e-6) and (p * size).sum() == pytest.approx(0.37 * size.sum(), abs=1e-3)
        landed = mixing.land(p, size, np.random.default_rng(seed))
        assert set(landed) <= {0.0, 1.0}
        hits += landed
    assert abs(hits / 300 - 0.37).mean() < 0.04 and hits.sum() / 300 == pytest.approx(0.37 * 300, abs=1)


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "s" if i % 3 else None, "x") for i in range(60)] + [(None, None, "s", "y")], "doc_id long, text string, source string, _row string")
    got = mixing.mixed_documents(docs).toPandas()
    assert list(got.columns) == docs.columns and got.groupby("doc_id").size().max() <= 3 and 0.9 <= len(got) / 60 <= 1.1
