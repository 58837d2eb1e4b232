"""Signatures estimate similarity, classes equal those of all pairs compared."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import near_dups as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    """Class of every row by all pairs: equal texts, or similarity of at least 0.8."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingled = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingled[i], shingled[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def classes_of(spark, rows):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = N.near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got.itertuples():
        groups[r.class_id].append(None if np.isnan(r.doc_id) else int(r.doc_id))
    assert got.groupby("class_id", dropna=False).stays.sum().eq(1).all()
    return sorted(sorted(map(str, g)) for g in groups.values())


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_classes_equal_all_pairs(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(rng.choice([1, 3, 8])):
            rows.append((n, " ".join(edited(rng, base, rng.randrange(1 + len(base) // 30)))))
            n += 1
    # A family around a middle text whose copies are often below the threshold among themselves.
    middle = [f"m{i}" for i in range(300)]
    for k in range(25):
        rows.append((n, " ".join(edited(rng, middle, 4 + k % 4))))
        n += 1
    rows.append((n, " ".join(middle)))
    rows += [(900, ""), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (906, "Ä b c d e f"), (906, "Ä b c d e f")]
    assert classes_of(spark, rows) == plain_classes(rows)


def test_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, None, "x", 1), (None, "", "y", 2), (3, "a b", None, 3), (3, "a b", None, 3)], "doc_id long, text string, _row string, CLASS_ID int")
    got = N.near_duplicates(docs).toPandas()
    assert len(got) == 4 and got.stays.sum() == 2 and sorted(got.class_size) == [2] * 4 and list(got.columns).count("class_id") == 1
    assert set(got["_row"].dropna()) == {"x", "y"}
    assert N.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    x, y = np.arange(0, 300), np.arange(60, 400)
    wx, wy = (rng.integers(1, 9, len(a)).astype(float) if weighted else np.ones(len(a)) for a in (x, y))
    full_x, full_y = np.zeros(400), np.zeros(400)
    full_x[x], full_y[y] = wx, wy
    truth = np.minimum(full_x, full_y).sum() / np.maximum(full_x, full_y).sum()
    k = 4000
    agree = (N.signature(ids[x], wx, k) == N.signature(ids[y], wy, k)).mean()
    assert agree == pytest.approx(truth, abs=5 * np.sqrt(truth * (1 - truth) / k))


def test_signatures_of_fractional_weights():
    ids = np.arange(1, 101, dtype=np.uint64)
    a, b = np.full(100, 0.5), np.full(100, 0.25)
    agree = (N.signature(ids, a, 4000) == N.signature(ids, b, 4000)).mean()
    assert agree == pytest.approx(0.5, abs=0.05)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def test_components_by_rounds_with_hubs(spark, monkeypatch):
    """Chunks and hubs so small that tasks join little and the star rounds do the rest."""
    monkeypatch.setattr(N, "CONTRACT_EDGES", 5)
    monkeypatch.setattr(N, "HUB", 3)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of four values only the second tells texts apart."""
    real = N.F.xxhash64
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 or isinstance(c[0], str) else N.F.pmod(real(*c), N.F.lit(4)))
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(12)]
    rows += [(100 + k, t) for k, t in rows[:6]]
    assert classes_of(spark, rows) == plain_classes(rows)
