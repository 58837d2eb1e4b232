"""Quality rules against a plain definition, and the positive-unlabelled classifier on held-out rows."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

from gleaner.llm import quality_model, quality_rules
from gleaner.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_measures(text):
    words = (text or "").encode().split()
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if n < 500 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        n,
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_rules_on_odd_texts(spark):
    texts = [None, "", "  \n\t", "one", "a b c d e a b c d e", "x y\nx y\n\n \nx y", "a b c\x0bd", "ü# |é| <b> $%&*", "w " * 300, " ".join(f"w{i % 7}" for i in range(100)), "the of and " * 20]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "p q r s t u v w x y z", "en", "s", 1)] * 2
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in got:
        assert tuple(r[n] for n in names) == plain_measures(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (not r["failed_rules"])


def test_rules_keep_other_columns_and_replace_results(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 5)], "doc_id long, text string, _words string, N_WORDS int")
    got = quality_rules.judge(docs).first()
    assert got["_words"] == "mine" and got["n_words"] == 2 and "N_WORDS" not in got.asDict()
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_rules_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.execute(SQL["op3_quality_rules"]).df().sort_values("doc_id", ignore_index=True)
    got = QUERIES["op3_quality_rules"](spark, SF_DIR).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.equals(want[got.columns].astype(got.dtypes))


def test_rules_keep_good_and_drop_bad(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = quality_rules.judge(docs).join(labels, "doc_id").select("kept", "quality", "n_words").toPandas()
    assert judged[(judged.quality == 1) & (judged.n_words >= 10)].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.1


def test_classifier_on_held_out_rows(spark):
    got = QUERIES["op9_quality_model"](spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert ((both.predicted == 1) == (both.quality == 1)).mean() > 0.9
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.95


def test_classifier_reads_the_text_alone_and_takes_odd_rows(spark):
    good = [(i, f"the cat and dog of house number {i} went to the sea. " * 3, "en", "a", 1) for i in range(40)]
    odd = [(None, None, None, None, None), (50, "", "fr", "b", 0), (50, "", "fr", "b", 0), (51, "### $$$ %%% " * 50, "en", "a", 3)]
    docs = spark.createDataFrame(good + odd, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, None), (51, 0, 0), (51, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs.selectExpr("*", "5 AS SCORE"), labels).toPandas()
    assert len(got) == 44 and "SCORE" not in got and got.score.notna().all()
    assert got[got.doc_id == 50].score.nunique() == 1
    empty = quality_model.classify(docs.limit(0), labels)
    assert empty.count() == 0
    unlabelled = quality_model.classify(docs, labels.limit(0)).toPandas()
    assert (unlabelled.score == 0.5).all()


def test_learning_uses_no_label_of_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    flipped = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(quality_model.held_out(), 1 - labels.quality).otherwise(labels.quality))
    a, b = (quality_model.learn(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


@pytest.mark.parametrize("rows", [30, 200, 2000, 8000])
@pytest.mark.parametrize("prior", [0.5, 0.9, 0.99])
def test_features_without_meaning_give_the_prior_at_any_size(rows, prior):
    rng = np.random.default_rng(rows)
    positive, unlabelled = (rng.random((rows, 24)).astype(np.float32) for _ in range(2))
    model = quality_model.fit(positive, unlabelled, prior)
    assert model.score(unlabelled).mean() == pytest.approx(prior, abs=0.02)


def test_fit_is_the_least_non_negative_risk():
    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, (400, 3)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1, 1, (600, 3)), rng.normal(-1, 1, (300, 3))]).astype(np.float32)
    model = quality_model.fit(positive, unlabelled, 2 / 3)

    def risk(weights, bias):
        z_p, z_u = ((m - model.center) / model.scale @ weights + bias for m in (positive, unlabelled))
        soft = lambda z: np.logaddexp(0, z).mean()
        rest = soft(z_u) - 2 / 3 * soft(z_p)
        return 2 / 3 * soft(-z_p) + max(0, rest) + 0.5 * model.ridge * (weights**2).sum()

    least = risk(model.weights, model.bias)
    for _ in range(300):
        assert risk(model.weights + rng.normal(0, 0.05, 3), model.bias + rng.normal(0, 0.05)) >= least - 1e-6
    assert (model.score(unlabelled[:600]) > 0.5).mean() > 0.9 and (model.score(unlabelled[600:]) < 0.5).mean() > 0.9


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", SF_DIR])
def test_labels_that_are_all_good_keep_nearly_all(spark, sf_dir):
    docs = quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert len(got) and got.predicted.mean() >= 0.95


def test_sample_by_hash_is_that_of_the_whole_order(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    some = {r[0] for r in quality_model.least_hashes(ids, 5, 300).collect()}
    assert len(some) == 300 and {r[0] for r in quality_model.least_hashes(ids, 5, 50000).collect()} == set(range(20000))
    assert some < {r[0] for r in quality_model.least_hashes(ids, 5, 600).collect()}


def test_prior_estimate():
    rng = np.random.default_rng(0)
    n = quality_model.SCORE_BINS
    p = np.bincount((rng.beta(8, 2, 20000) * n).astype(int), minlength=n + 1)
    u = np.bincount((np.concatenate([rng.beta(8, 2, 14000), rng.beta(2, 8, 6000)]) * n).astype(int), minlength=n + 1)
    assert quality_model.prior_from_bins([(i, int(p[i]), int(u[i])) for i in range(n + 1)]) == pytest.approx(0.7, abs=0.05)


def test_features_of_a_batch_equal_those_of_each_text():
    texts = ["Aa bb aa bb.", None, "", "x\ny\nx", "äö # 12", "one two three one two three " * 5]
    whole = quality_model.feature_matrix(texts)
    alone = np.concatenate([quality_model.feature_matrix([t]) for t in texts])
    assert np.allclose(whole, alone) and not whole[1].any() and not whole[2].any()


def test_stop_words_alone_reject_nothing(spark):
    polish = " ".join(f"słowo{i} dom{i} ogród{i} miasto{i}" for i in range(20))
    menu = " ".join(f"słowo{i} dom{i} | ogród{i} miasto{i}" for i in range(20))
    rows = [(1, polish, True), (2, menu + " | | |", False), (3, polish + " the and of", True)]
    got = quality_rules.judge(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(d, kept) for d, _, kept in rows}
    assert [r.failed_rules for r in got if r.doc_id == 2] == [["no_stop_words"]]
