"""Language model, nearest neighbours, archives and languages against plain definitions."""

from __future__ import annotations

import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark import RDD
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from gleaner.llm import ann, language, lm_scoring, warc
from gleaner.llm.common import tokenizer_path, word_bytes
from gleaner.llm.queries import QUERIES, SQL
from gleaner.session import shared_folder

SF_DIR = "/root/testdata/sf0.001"
WORD = tokenizer_path("word_bpe_49k.json")


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.start(rng.integers(0, 50, lm_scoring.CLASSES * lm_scoring.MEMBERS).astype(float)).items()}
    inputs, goals = (rng.integers(0, 1024, (3, lm_scoring.WINDOW)) for _ in range(2))
    real = rng.random(inputs.shape) < 0.8
    _, g = lm_scoring.gradients(p, inputs, goals, real)
    for name in p:
        flat = np.abs(g[name]).ravel().argsort()[-2:]
        for i in flat:
            at = np.unravel_index(i, p[name].shape)
            losses = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                losses.append(lm_scoring.gradients(moved, inputs, goals, real)[0])
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-2, abs=1e-7), name


def test_gradients_fill_a_given_buffer():
    """As training does it: one flat array for all gradients, also of classes and entries that do not occur."""
    rng = np.random.default_rng(4)
    p = lm_scoring.start(np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS))
    inputs, goals = (rng.integers(0, 40, (5, lm_scoring.WINDOW)) for _ in range(2))
    for real in (rng.random(inputs.shape) < 0.5, np.ones(inputs.shape, bool), np.zeros(inputs.shape, bool)):
        flat = np.zeros(len(lm_scoring.packed(p)), np.float32)
        loss, g = lm_scoring.gradients(p, inputs, goals, real, lm_scoring.views(flat))
        alone, plain = lm_scoring.gradients(p, inputs, goals, real)
        assert loss == alone and np.isfinite(flat).all() and (flat == lm_scoring.packed(plain)).all()
        assert not g["E"][40:].any() and not g["Um"][2:].any() and real.any() == flat.any()


def test_steps_are_those_of_adam():
    rng = np.random.default_rng(6)
    p = lm_scoring.start(np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS))
    block = np.stack([*(rng.integers(0, 1024, (150, lm_scoring.WINDOW)) for _ in range(2)), rng.random((150, lm_scoring.WINDOW)) < 0.9], 1).astype(np.int16)
    got, weight = lm_scoring.train(p, [block], 0.01, 3)
    want = {k: v.astype(np.float64) for k, v in p.items()}
    m, v = ({k: np.zeros(x.shape) for k, x in p.items()} for _ in range(2))
    order = np.random.default_rng(3).permutation(len(block))
    for step, at in enumerate(range(0, len(order), lm_scoring.BATCH), 1):
        part = block[order[at : at + lm_scoring.BATCH]].astype(np.int64)
        _, g = lm_scoring.gradients(want, part[:, 0], part[:, 1], part[:, 2] > 0)
        for k in want:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] ** 2 - v[k])
            want[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    assert weight == block[:, 2].sum()
    for k in want:
        assert np.quantile(np.abs(got[k] - want[k]), 0.99) < 1e-4, k


def test_exponentials_out_of_range():
    rng = np.random.default_rng(5)
    q, k = (rng.standard_normal((3, lm_scoring.WINDOW, 4)).astype(np.float32) * 40 for _ in range(2))
    cells = np.tril(np.ones((lm_scoring.WINDOW, lm_scoring.WINDOW), np.float32))
    s = np.where(cells > 0, np.matmul(q.astype(np.float64), k.transpose(0, 2, 1)), -np.inf)
    want = np.exp(s - s.max(-1, keepdims=True))
    assert lm_scoring.open_weights(q, k, cells) == pytest.approx(want / want.sum(-1, keepdims=True), abs=1e-3)
    x = np.array([[1000.0, 999.0], [-1000.0, -1000.0], [0.0, 1.0]])
    assert lm_scoring.log_sum(x.copy()) == pytest.approx([1000 + math.log(1 + math.exp(-1)), math.log(2) - 1000, math.log(1 + math.e)])


def test_each_token_is_scored_once_in_its_window():
    rng = np.random.default_rng(1)
    p = lm_scoring.start(np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS))
    p["E"] *= 5
    sequences = [rng.integers(1, 1024, n) for n in (0, 1, 5, 31, 32, 33, 55, 56, 57, 200)]
    sequences = [np.append(s, 0) for s in sequences]
    got = lm_scoring.token_scores(p, sequences)
    w, s = lm_scoring.WINDOW, lm_scoring.STRIDE
    for line, score in zip(sequences, got):
        total = 0.0
        for t in range(len(line)):
            number = 0 if t < w else (t - w) // s + 1
            window = np.concatenate([[0], line])[number * s : t + 1]
            padded = np.zeros((1, w), np.int64)
            padded[0, : len(window)] = window
            goal, real = np.zeros((1, w), np.int64), np.zeros((1, w), bool)
            goal[0, len(window) - 1], real[0, len(window) - 1] = line[t], True
            total -= lm_scoring.gradients(p, padded, goal, real)[0]
        assert score == pytest.approx(total, rel=1e-4)


def test_entry_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 1000, 5000) * (rng.random(5000) < 0.5)
    to_entry, by_entry, share = lm_scoring.entries(counts, 10)
    assert by_entry.sum() == counts.sum() + 10 and to_entry.max() < 1024
    assert np.exp(share[to_entry == 1]).sum() == pytest.approx(1) and (share[to_entry > 1] == 0).all()
    assert len(np.unique(to_entry[to_entry > 1])) == (to_entry > 1).sum()


def test_lm_query(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 300)  # so that the join has work
    got = QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs.itertuples()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert (got.train_tokens == n).all() and len(got) == len(docs)
    for d, ws in words.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[d], len(ws), sum(w in c for w in ws))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_lm_takes_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MIN_TOKENS", 1000)
    docs = spark.createDataFrame([(None, None), (None, "a"), (1, ""), (1, "b B b"), (1, "b B b"), (2, "\U0001f600 " * 200)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS row")
    got = lm_scoring.score_documents(docs, WORD).toPandas()
    assert len(got) == 6 and np.isfinite(got.score).all() and sorted(got.n_tokens) == [1, 1, 2, 4, 4, 201]
    assert lm_scoring.score_documents(docs.limit(0), WORD).count() == 0


def test_every_window_is_learned_from(spark, monkeypatch):
    """Also where the input is above the floor: each window of each text in just one round."""
    monkeypatch.setattr(lm_scoring, "MIN_TOKENS", 1000)
    monkeypatch.setattr(lm_scoring, "HELD_WINDOWS", 40)
    goals = spark.sparkContext.accumulator(0)
    whole = lm_scoring.train

    def counted(p, blocks, rate, seed):
        p, weight = whole(p, blocks, rate, seed)
        goals.add(int(weight))
        return p, weight

    monkeypatch.setattr(lm_scoring, "train", counted)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 31, 32, 900, 5000)]
    learning = spark.createDataFrame([(i, b) for i, b in enumerate(ids)], "row long, ids binary")
    to_entry, by_entry, _ = lm_scoring.entries(np.ones(5000), len(ids))
    lm_scoring.fit(learning, to_entry, by_entry)
    assert goals.value == sum(len(b) // 4 + 1 for b in ids)


def test_training_takes_rows_of_any_partition(spark):
    rows = [0, 1073 << 33, 1074 << 33, (5000 << 33) + 7, 2**63 - 1]
    learning = spark.createDataFrame([(r, np.arange(100, dtype="<u4").tobytes()) for r in rows], "row long, ids binary")
    to_entry, by_entry, _ = lm_scoring.entries(np.ones(100), len(rows))
    params = lm_scoring.fit(learning, to_entry, by_entry)
    assert all(np.isfinite(v).all() for v in params.values())


def test_training_takes_one_python_process_a_task(spark, monkeypatch):
    """Rows of mapInArrow() that go on into functions of an RDD are piped to a second one."""

    def piped(*args, **kw):
        raise AssertionError("a function of an RDD")

    learning = spark.createDataFrame([(i, np.arange(100, dtype="<u4").tobytes()) for i in range(8)], "row long, ids binary").repartition(4)
    to_entry, by_entry, _ = lm_scoring.entries(np.ones(100), 8)
    monkeypatch.setattr(RDD, "mapPartitionsWithIndex", piped)
    params = lm_scoring.fit(learning, to_entry, by_entry)
    assert any((params[k] != v).any() for k, v in lm_scoring.start(by_entry).items())


def test_steps_reuse_memory():
    """In a process of its own, as freeing large arrays changes what the C library keeps."""
    code = """if True:
        import resource
        import numpy as np
        from gleaner.llm import lm_scoring
        p = lm_scoring.start(np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS))
        rng = np.random.default_rng(0)
        blocks = [np.stack([*(rng.integers(0, 1024, (10 * lm_scoring.BATCH, lm_scoring.WINDOW)) for _ in range(2)), np.ones((10 * lm_scoring.BATCH, lm_scoring.WINDOW))], 1).astype(np.int16) for _ in range(3)]
        def watched():
            yield blocks[0]
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            yield blocks[1]
            print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 10)
        lm_scoring.train(p, watched(), 0.01, 1)
    """
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join(sys.path)}
    faults = float(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, check=True, text=True).stdout)
    assert faults < 100  # pages a step


@pytest.mark.parametrize("rows", [0, 1, 511, 512, 513, 1500])
def test_products_in_parts(rows):
    rng = np.random.default_rng(rows)
    x, y, w = (rng.standard_normal(s) for s in ((rows, 5), (rows, 3), (5, 4)))
    out = np.full((5, 3), 7.0)
    lm_scoring.crossed(x, y, out)
    assert lm_scoring.times(x, w) == pytest.approx(x @ w) and out == pytest.approx(x.T @ y)


def test_windows_are_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(3)
    entry_of = rng.integers(0, 1024, 1300)
    ids = [rng.integers(0, 1500, n).astype("<u4") for n in (0, 1, 30, 31, 32, 33, 64, 0, 5000)]
    rows = np.array([5, -3, 2**62, 1 << 33, 4, 5, 6, 7, 8])
    batch = pa.record_batch([pa.array(rows), pa.array([x.tobytes() for x in ids], pa.binary())], names=["row", "ids"])
    w = lm_scoring.WINDOW
    for held, turn, share in ((8192, 0, 1.0), (40, 1, 0.5), (8192, 3, 0.25)):
        monkeypatch.setattr(lm_scoring, "HELD_WINDOWS", held)
        want = [[]]  # blocks: a text, or a part of a long one, ends a block that it fills
        for row, x in zip(rows, ids):
            line = np.concatenate([[0], entry_of[np.minimum(x, 1299)], np.zeros(w, int)])
            own = []
            for number in range(-(-(len(x) + 1) // w)):
                mixed = (int(row) * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64
                if ((mixed >> 48) / 65_536 + turn / lm_scoring.ROUNDS) % 1.0 < share:
                    cells = number * w + np.arange(w)
                    own.append([line[cells], [line[c + 1] if c < len(x) else 0 for c in cells], cells <= len(x)])
            for at in range(0, len(own), held):
                want[-1] += own[at : at + held]
                if len(want[-1]) >= held:
                    want.append([])
        want = [np.array(block, int) for block in want if block]
        got = list(lm_scoring.windows_of([batch], entry_of, turn, share))
        assert len(got) == len(want) and all(a.dtype == np.int16 and np.array_equal(a, b) for a, b in zip(got, want))


def test_words_by_column():
    texts = ["", " ", "Ab c\x0b\x0cAB\r\n\td ", "\x1c\x1d x\x85y\xa0Z\u2003Ä", "\u0130 K", "a" * 5000, "x\0Y z"]
    owner, words = lm_scoring.words_in(pa.array(texts))
    want = [(i, w) for i, text in enumerate(texts) for w in word_bytes(text)]
    assert list(zip(owner.tolist(), words.to_pylist())) == want and words.type == pa.binary()
    owner, words = lm_scoring.words_in(pa.array(texts).slice(2, 2))
    assert list(zip((owner + 2).tolist(), words.to_pylist())) == [x for x in want if x[0] in (2, 3)]
    assert len(lm_scoring.words_in(pa.array([], pa.string()))[1]) == 0


@pytest.mark.parametrize("tasks", [1, 2, 11])
def test_means_of_tasks(spark, tasks):
    values = np.random.default_rng(0).standard_normal((20, 50))
    weights = np.arange(1.0, 21)
    sent = spark.createDataFrame([(float(w), (x * w).tobytes()) for w, x in zip(weights, values)], "w double, p binary").repartition(tasks)
    assert lm_scoring.averaged(sent, tasks) == pytest.approx(np.average(values, axis=0, weights=weights), rel=1e-12)
    assert lm_scoring.averaged(sent.limit(0), tasks) is None


def test_texts_come_to_python_in_small_batches(spark, monkeypatch):
    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    most = spark.sparkContext.accumulator(0, Most())
    whole = lm_scoring.by_bytes

    def noted(batches, column, size):
        def each():
            for batch in batches:
                most.add(batch.nbytes)
                yield batch

        return whole(each(), column, size)

    monkeypatch.setattr(lm_scoring, "by_bytes", noted)
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd ', 20000) AS text")
    assert lm_scoring.coded(docs, WORD).count() == 60
    assert 0 < most.value < 3 << 20


def brute(rows, every, k):
    out = {}
    for q in range(len(rows)):
        if rows[q][0] % every == 0:
            d = sorted((float(np.sqrt(((rows[q][1] - x) ** 2).sum())), i) for j, (i, x) in enumerate(rows) if j != q and len(x) == len(rows[q][1]))
            out[rows[q][0]] = d[:k]
    return out


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).standard_normal((5, 48))
    for t in range(3):
        y = ann.rotated(x, t)
        assert y.shape == (5, 64) and np.allclose((y**2).sum(1), (x**2).sum(1))
    assert np.allclose(ann.hadamard(np.eye(4)) @ ann.hadamard(np.eye(4)), np.eye(4))


def test_neighbours_recall_and_order(spark):
    got = QUERIES["op8_nearest_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rows = [(int(i), np.array(v, np.float64)) for i, v in zip(table.vec_id, table.embedding)]
    want = brute(rows, 100, 10)
    found = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and part.score.is_monotonic_increasing
        found += len(set(part.vec_id) & {i for _, i in want[q]})
    assert set(got.query_id) == set(want) and found >= 0.9 * 10 * len(want)
    vectors = dict(rows)
    assert all(np.isclose(r.score, np.linalg.norm(vectors[r.query_id] - vectors[r.vec_id]), rtol=1e-12) for r in got.itertuples())


@pytest.mark.parametrize("sigma", [0.3, 0.7])
def test_neighbours_recall_where_norms_vary(spark, sigma):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    x *= np.exp(sigma * rng.standard_normal((2000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(frame, every=20).toPandas().groupby("query_id").vec_id.agg(set)
    want = brute(list(enumerate(x)), 20, 10)
    assert set(got.index) == set(want) and sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_cells_of_any_scale():
    rng = np.random.default_rng(0)
    x, pivots = rng.standard_normal((50, 8)), rng.standard_normal((6, 8))
    want = np.argsort(((x[:, None] - pivots) ** 2).sum(-1), axis=1)
    for scale in (1e-250, 1.0, 1e250):
        assert (ann.cells(x * scale, pivots * scale, 6) == want).all()
    assert (ann.cells(x, None, 6) == 0).all() and np.isfinite(ann.cells(x * 1e300, pivots * 1e-300, 6)).all()


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (100, [0.0, 1.0, 1e-3]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (9, []), (200, [5.0, 5.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS dim")
    got = ann.neighbours(frame, every=100, k=10).toPandas()
    clean = [(i, np.array(v)) for i, v in vectors if i in (0, 1, 2, 100, 8, 200)]
    want = brute(clean, 100, 10)
    for q in want:
        part = got[got.query_id == q].sort_values("rank")
        assert list(zip(part.score, part.vec_id)) == [(pytest.approx(s), i) for s, i in want[q]]
    assert set(got.query_id) == {0, 100, 200}
    assert ann.neighbours(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    ties = ann.neighbours(same).toPandas()
    assert ties[ties.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 11))


def test_warc_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    want = con.execute(SQL["op5_warc"]).df().sort_values("page_id", ignore_index=True)
    got = QUERIES["op5_warc"](spark, SF_DIR).toPandas().sort_values("page_id", ignore_index=True)
    assert got.astype(object).where(got.notna(), None).equals(want[got.columns].astype(object).where(want[got.columns].notna(), None))


def test_archives_round_trip(spark):
    big, other = "<p>" + "x" * 2000, "<p>ü\n\r\n\r\n" + "y" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (None, "v", other), (None, "w", other), (7, "u", "z\u0000" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS first").repartition(2)
    path = shared_folder(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).toPandas()
    kind = lambda i: sorted(got.record_type[got.page_id == i])
    assert len(got) == len(rows) and kind(1) == ["revisit"] and kind(2) == ["response"] * 2 and kind(5) == kind(6) == ["response"]
    assert got.refers_to.dropna().tolist() == [2, 2]
    unnamed = got[got.page_id.isna()]
    assert sorted(unnamed.record_type) == ["response", "response", "revisit"]
    payloads = Counter(bytes(p).decode() for p in got.payload.dropna())
    assert payloads[big] == 2 and payloads[other] == 2 and payloads["z\u0000" * 70000] == 1 and payloads[""] == 2
    empty = shared_folder(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_are_plain_zstandard_with_a_leading_dictionary(spark):
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), path)
    content = spark.read.format("binaryFile").load(path).first()["content"]
    assert content[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(content[4:8], "little")
    assert size > 1000
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(content[8 : 8 + size])))
    rest, records = bytes(content[8 + size :]), []
    while rest:  # one frame at a time, by the library's own decoder
        if rest[1:4] == b"\x2a\x4d\x18":
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        one = whole.decompressobj()
        records.append(one.decompress(rest))
        rest = one.unused_data
    assert all(r.startswith(b"WARC/1.1\r\n") and r.count(b"WARC/1.1\r\n") == 1 for r in records)
    assert records == [bytes(r) for r in warc.frames_of(bytes(content))] and len(records) > 1


def test_visible_text_equals_the_plain_pattern():
    hidden = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    rng = random.Random(4)
    parts = ["<!--", "-->", "<script", "</SCRIPT >", "<style>", "</style>", ">", "<", "a", " b ", "<p>", "</p", "&amp;", "\n", "<scripted>", "<!-->", "İ"]
    for _ in range(5000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language.visible(html) == language.ENTITY.sub(" ", hidden.sub(" ", html)), html


def test_unclosed_marks_of_a_long_page_take_no_time():
    start = time.perf_counter()
    for mark in ("<!--", "<script>", "<", "<style ", "</script ", "<html "):
        language.visible(mark * ((10 << 20) // len(mark)))
    assert time.perf_counter() - start < 60  # seconds in a quadratic scan: days


def test_declared_language_of_a_long_page(spark):
    pages = [("<html " * 500_000,), ("<html " * 9 + ' lang="de">',), ("<p><HTML x=1\nlang = 'FR-ca'>",), ("<html></html><p lang=en>",), (None,)]
    found = spark.createDataFrame(pages, "html string").select(language.declared_in(F.col("html")).alias("d")).collect()
    assert [r.d for r in found] == ["", "de", "fr", "", ""]


@pytest.mark.parametrize("harm", ["cut", "magic", "late dictionary", "length", "digest", "version"])
def test_broken_archives_are_refused(harm):
    raw = warc.record(1, "u", b"payload", "ab" * 20, "response", None)
    import hashlib

    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    change = {"length": (b"Content-Length: 7\r\n", b"Content-Length: 9\r\n"), "digest": (b"payload\r\n", b"pay10ad\r\n"), "version": (b"WARC/1.1", b"WARK/1.1")}.get(harm)
    if change:
        raw = raw.replace(*change)
    data = zstandard.ZstdCompressor().compress(raw)
    data = {"cut": data[:-5], "magic": b"abcdefgh" + data, "late dictionary": data + b"\x5d\x2a\x4d\x18\x00\x00\x00\x00"}.get(harm, data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for r in warc.frames_of(data):
            warc.parse_record(r)


def test_languages(spark):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    got = language.identify(pages, docs).toPandas().merge(pages.toPandas(), on="page_id")
    path = got.url.str.extract(r"/(en|de|fr|es)/")[0]
    assert len(got) == pages.count() and (got.lang == path)[path.notna()].mean() > 0.97
    assert got.probability.between(0, 1).all()


def test_languages_fuse_weak_evidence(spark):
    docs = spark.createDataFrame([("en", "the house and the garden of the town " * 20), ("de", "das haus und der garten der stadt " * 20), (None, "x"), ("en", None)], "lang string, text string")
    rows = [(i, f"http://www.ort.example.de/{i}", '<html lang="de"><script>the the</script>das haus und der garten</html>') for i in range(20)]
    rows += [(100 + i, f"http://a.example.com/{i}", "<html lang=en-GB>the house and the garden") for i in range(20)]
    rows += [(200, "http://www.ort.example.de/x", "<p>1234</p>"), (201, "http://new.other.net/", '<html lang="de"> 99 '), (202, None, None), (None, "nonsense", ""), (None, "nonsense", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS lang", "2 AS host")
    got = language.identify(pages, docs).toPandas().drop_duplicates("page_id").set_index("page_id")
    assert got.lang[0] == "de" and got.lang[100] == "en" and got.lang[200] == "de" and got.lang[201] == "de" and len(language.identify(pages, docs).collect()) == len(rows)
    assert language.identify(pages.limit(0), docs).count() == 0
    assert language.identify(pages, docs.limit(0)).where("lang IS NULL").count() == len(rows)
