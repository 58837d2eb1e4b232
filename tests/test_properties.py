"""Distributed operators against plain sequential definitions, on random small inputs."""

from __future__ import annotations

import difflib
import random
import re
from collections import Counter
from itertools import combinations
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleaner.functions import urls as U
from gleaner.operators import compare as CP
from gleaner.operators import dedup as DD
from gleaner.operators import files as FD
from gleaner.operators import findings as A
from gleaner.operators import hunks as HU
from gleaner.operators import language as LG
from gleaner.operators import lines as TX
from gleaner.operators import snapshots as SN
from gleaner.operators import statements as ST
from gleaner.operators import web as WB
from gleaner.operators.neardup import near_dup, pair_similarity
from gleaner.operators.skew import number_rows
from gleaner.session import scratch


def random_statements(seed, n, words, length):
    rng = random.Random(seed)
    base = [[rng.choice(words) for _ in range(length + rng.randint(-3, 3))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((f"f{rng.randrange(10 ** 6):06d}", i, rng.choice(["SELECT", "UPDATE"]), " ".join(text)))
    return rows


def leader_rule(rows, similar):
    """Row by row in order: join the first leader that is similar, else lead."""
    leaders, out = {}, {}
    for source, ordinal, kind, text in sorted(rows):
        tokens = re.findall(r"\w+", text.upper())
        for leader, leader_tokens in leaders.setdefault(kind, []):
            if similar(tokens, leader_tokens):
                out[source, ordinal] = leader
                break
        else:
            leaders[kind].append(((source, ordinal), tokens))
            out[source, ordinal] = (source, ordinal)
    return out


def jaccard_at(threshold):
    return lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold


def difflib_at(threshold):
    def similar(a, b):
        if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.5:
            return False
        return difflib.SequenceMatcher(None, " ".join(a), " ".join(b)).ratio() >= threshold

    return similar


@pytest.mark.parametrize(
    ("metric", "threshold", "length", "pivots"),
    [("jaccard", 0.95, 45, 1), ("jaccard", 0.8, 25, 2), ("jaccard", 0.7, 8, 1), ("difflib", 0.95, 25, 2), ("difflib", 0.85, 9, 1)],
)
def test_near_dup_is_the_leader_rule(spark, metric, threshold, length, pivots):
    words = [f"w{i}" for i in range(60)]
    rows = random_statements(length, 160, words, length)
    df = spark.createDataFrame(rows, "source_file string, ordinal int, query_type string, raw_sql string")
    tagged = near_dup(df, threshold=threshold, metric=metric, pivots=pivots).collect()
    got = {(r.source_file, r.ordinal): (r.survivor.source_file, r.survivor.ordinal) for r in tagged}
    want = leader_rule(rows, (jaccard_at if metric == "jaccard" else difflib_at)(threshold))
    assert got == want
    assert len(set(want.values())) < len(rows)


def test_pair_scores(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [r[3] for r in random_statements(21, 60, words, 40)]
    pairs = list(zip(texts, texts[1:])) + [("a b", "a b c d e"), ("", "a"), ("x = 'v' and y = 1", "x = 'w' and y = 2")]
    df = spark.createDataFrame(pairs, "l string, r string")

    def key(text):
        return re.findall(r"\w+", re.sub(r"\b\d+\b", "?", re.sub(r"'[^']*'", "'?'", text.upper())))

    for row in pair_similarity(df, "l", "r", "difflib").collect():
        a, b = key(row.l), key(row.r)
        short = not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.5
        want = 0.0 if short else difflib.SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()
        assert abs(row.similarity - want) < 1e-12
    for row in pair_similarity(df, "l", "r", "levenshtein").collect():
        a, b = " ".join(key(row.l)), " ".join(key(row.r))
        if row.similarity:
            assert abs(row.similarity - (1 - edit_distance(a, b, 1) / max(len(a), len(b)))) < 1e-12


def test_hot_cluster_needs_no_pair_table(spark):
    """A third of all rows are copies with one changed token; they collapse onto the first of them."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(f"a{i:05d}", i, "SELECT", f"{common} x{i}") for i in range(1000)]
    rows += [(f"b{i:05d}", i, "SELECT", " ".join(f"r{rng.randrange(9999)}" for _ in range(30))) for i in range(2000)]
    df = spark.createDataFrame(rows, "source_file string, ordinal int, query_type string, raw_sql string")
    counts = near_dup(df).groupBy("survivor.source_file").count().filter("count > 1").collect()
    assert [(r.source_file, r["count"]) for r in counts] == [("a00000", 1000)]


def test_key_tier_with_hot_keys(spark):
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(50):02d}", i, 0, "hot" if rng.random() < 0.4 else f"k{rng.randrange(80)}") for i in range(900)]
    df = spark.createDataFrame(rows, "source_file string, ordinal int, line_start int, fingerprint string")
    tagged = DD.dedup_by_key(df, "fingerprint", ["source_file", "ordinal"], rows_per_slice=20).collect()
    first, size = {}, Counter()
    for source, ordinal, _, key in sorted(rows):
        first.setdefault(key, (source, ordinal))
        size[key] += 1
    assert len(tagged) == len(rows)
    for r in tagged:
        assert (r.survivor.source_file, r.survivor.ordinal) == first[r.fingerprint]
        assert r.is_duplicate == ((r.source_file, r.ordinal) != first[r.fingerprint])
        assert r.group_size == size[r.fingerprint]


def test_number_rows_is_row_number(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(3), i, rng.random()) for i in range(2000)], "g int, k int, x double")
    window = W.partitionBy("g").orderBy("x", "k")
    want = {(r.k): (r.n, r.t) for r in df.select("k", F.row_number().over(window).alias("n"), F.count("*").over(W.partitionBy("g")).alias("t")).collect()}
    got = {(r.k): (r.number, r.number_total) for r in number_rows(df, ["g"], ["x", "k"]).collect()}
    assert got == want


def test_tiers_partition_the_input(spark):
    rows = random_statements(3, 200, [f"w{i}" for i in range(20)], 25)
    df = spark.createDataFrame(rows, "source_file string, ordinal int, query_type string, raw_sql string")
    tagged = DD.dedup(ST.with_normal_form(df.withColumn("line_start", F.lit(1)))).collect()
    keys = [(r.source_file, r.ordinal) for r in tagged]
    assert sorted(keys) == sorted((s, o) for s, o, _, _ in rows)
    kept = {(r.source_file, r.ordinal): r.tier for r in tagged}
    assert all(r.tier == "UNIQUE" or (r.original_file, r.original_ordinal) in kept for r in tagged)


def scan_runs(text, close_on_first):
    """Line by line: a starter opens a block, a semicolon or blank line closes it."""
    starter = re.compile(r"\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE|ALTER|DROP|TRUNCATE|EXEC|EXECUTE|WITH|BEGIN|DECLARE|CALL)\b", re.I)
    blocks, block = [], []
    for number, line in enumerate(text.split("\n"), 1):
        opening = not block and starter.match(line)
        if opening or block:
            block.append((number, line))
            if (close_on_first or not opening) and (";" in line or not line.strip()):
                blocks.append(block)
                block = []
    return [(b[0][0], b[-1][0], "\n".join(x for _, x in b).strip()) for b in [*blocks, block] if b]


@pytest.mark.parametrize("mode", ["default", "compat"])
def test_line_runs(spark, mode):
    rng = random.Random(7)
    parts = ["select a from t", "where b = 1;", "", "some prose", "  update t set a = 1;", "delete from t", "drop table t;", "x ; y"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    files = spark.createDataFrame([(f"f{i:02d}", t) for i, t in enumerate(texts)], "source_file string, content string")
    got = {}
    for r in ST.extract_line_runs(files, mode).collect():
        got.setdefault(r.source_file, []).append((r.line_start, r.line_end, r.raw_sql))
    for i, text in enumerate(texts):
        want = [b for b in scan_runs(text, mode == "default") if len(b[2]) >= 10]
        assert sorted(got.get(f"f{i:02d}", [])) == want, text


def test_carry_across_blocks(spark):
    rng = random.Random(4)
    lines = [(d, n, str(rng.randrange(99)) if rng.random() < 0.05 else None) for d in range(4) for n in range(1, 200)]
    df = spark.createDataFrame(lines, "doc_id int, line_no int, marker string")
    got = {(r.doc_id, r.line_no): r.number for r in TX.carry_marker(df, lines_per_block=10).collect()}
    last = {}
    for doc, number, marker in sorted(lines, key=lambda x: (x[0], x[1])):
        last[doc] = marker if marker is not None else last.get(doc)
        assert got[doc, number] == last[doc]
    assert len(got) == len(lines)


def edit_distance(a, b, substitution):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (0 if x == y else substitution))
    return row[-1]


@pytest.mark.parametrize(("metric", "threshold"), [("levenshtein", 80), ("levenshtein", 60), ("indel", 80), ("indel", 70)])
def test_similar_names_are_all_found(spark, metric, threshold):
    rng = random.Random(11)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(90)}
    got = {(r.name_a, r.name_b) for r in FD.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), threshold, metric).collect()}
    want = set()
    for a, b in combinations(sorted(names), 2):
        if metric == "levenshtein":
            score = 1 - edit_distance(a, b, 1) / max(len(a), len(b))
        else:
            score = 1 - edit_distance(a, b, 2) / (len(a) + len(b))
        if 100 * score >= threshold - 1e-9:
            want.add((a, b))
    assert got == want


def test_resolution_matches_the_standard_library(spark):
    bases = ["http://a.com/b/c/d;p?q", "http://a.com", "http://a.com/b/", "https://h/x/y?z#f"]
    refs = ["g", "./g", "g/", "/g", "//h2/g", "?y", "g?y", "#s", "g#s", ";x", "", ".", "./", "..", "../", "../g", "../..",
            "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "mailto:a@b", "http://o/x", "x//y", "#"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", U.resolve_url(F.col("b"), F.col("r")).alias("got")).collect():
        assert row.got == urljoin(row.b, row.r), (row.b, row.r)


def test_line_changes_balance(spark):
    rng = random.Random(9)
    texts = {c: "\n".join(rng.choice("abcde") for _ in range(30)) for c in ("x", "y", "z")}
    files = spark.createDataFrame([("n.txt", c, t) for c, t in texts.items()], "name string, collection string, content string")
    files = files.withColumn("hash", F.sha2("content", 256))
    pairs = CP.collection_pairs(files, list(texts))
    rows = CP.line_changes(files, pairs).collect()
    assert len(rows) == 3
    for r in rows:
        left, right = Counter(texts[r.left_collection].split("\n")), Counter(texts[r.right_collection].split("\n"))
        assert (r.added, r.removed) == ((right - left).total(), (left - right).total())
    for r in CP.diff_hunks(files, pairs).collect():
        want = difflib.unified_diff(
            texts[r.left_collection].split("\n"), texts[r.right_collection].split("\n"),
            f"{r.left_collection}/n.txt", f"{r.right_collection}/n.txt", lineterm="",
        )
        assert r.diff == "\n".join(want)


def test_language_by_grams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = LG.learn_languages(docs.filter("doc_id % 5 <> 0"))
    asked = docs.filter("doc_id % 5 = 0").withColumnRenamed("lang", "told")
    found = LG.text_language(asked, ["doc_id", "told"], model).filter("lang IS NOT NULL").toPandas()
    assert len(found) > 150 and (found.lang == found.told).mean() > 0.95


def test_language_of_odd_texts(spark):
    known = spark.createDataFrame([("aa", "xyx xyx"), ("bb", "ééé zz"), (None, "qq"), ("cc", None)], "lang string, text string")
    model = LG.learn_languages(known)
    texts = ["xyx", "ÉÉÉ!", None, "", "12 -", "qqq", "xyx xyx zz"]
    asked = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = {r.k: r.lang for r in LG.text_language(asked, ["k"], model).collect()}
    assert found == {0: "aa", 1: "bb", 2: None, 3: None, 4: None, 5: "bb", 6: "aa"}
    nothing = LG.learn_languages(known.limit(0))
    assert {r.lang for r in LG.text_language(asked, ["k"], nothing).collect()} == {None}


@pytest.mark.parametrize("kind", ["heavy", "even", "few", "none"])
def test_heavy_tables_are_the_top_tables(spark, kind):
    rng = random.Random(4)
    draw = {
        "heavy": lambda: f"T{min(int(rng.paretovariate(0.7)), 5000)}",
        "even": lambda: f"t{rng.randrange(3000)}",
        "few": lambda: f"t{rng.randrange(3)}",
        "none": None,
    }[kind]
    rows = [([draw() for _ in range(rng.randrange(4))],) for _ in range(6000)] if draw else [([],)]
    df = spark.createDataFrame(rows, "table_names array<string>").repartition(7)
    for tracked in (64, 10_000):
        got = [tuple(r) for r in A.heavy_tables(df, 5, tracked).collect()]
        assert got == [tuple(r) for r in A.top_tables(df, 5).collect()]


def test_increasing_run_is_longest():
    rng = random.Random(0)
    for _ in range(200):
        places = rng.sample(range(40), rng.randrange(9))
        run = [places[i] for i in HU.increasing_run(places)]
        assert run == sorted(run) and len(run) == max(
            n for n in range(len(places) + 1) if n == 0 or any(list(c) == sorted(c) for c in combinations(places, n))
        )


def test_hunks_turn_one_side_into_the_other(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(40):
        a = [rng.choice("abcdefgh{}") + rng.choice(["", "1", "2"]) for _ in range(rng.randrange(0, 25))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = [rng.choice("xyz{}ab") for _ in range(rng.randrange(3))]
        texts[f"n{i}"] = ("\n".join(a), "\n".join(b if i % 8 else rng.sample(b, len(b))))
    texts |= {"empty": ("", "a\nb"), "gone": ("a\nb", ""), "same": ("q", "q"), "none": ("a\nb", "x\ny\nz")}
    rows = [(n, side, t) for n, both in texts.items() for side, t in zip(("l", "r"), both)] + [("alone", "l", "x")]
    files = spark.createDataFrame(rows, "name string, collection string, content string").withColumn("hash", F.sha2("content", 256))
    found = HU.hunks(files, CP.collection_pairs(files, ["l", "r"]))
    patched = {r.name: r.patched for r in HU.apply_hunks(files, found).collect()}
    assert patched == {n: r for n, (l, r) in texts.items() if l != r}
    for name, group in found.toPandas().groupby("name"):
        left, right = (t.split("\n") for t in texts[name])
        group = group.sort_values("hunk")
        kept, at, on = [], 0, 0
        for h in group.itertuples():
            assert list(h.removed) == left[h.left_start - 1 : h.left_start - 1 + len(h.removed)]
            assert list(h.added) == right[h.right_start - 1 : h.right_start - 1 + len(h.added)]
            assert left[at : h.left_start - 1] == right[on : h.right_start - 1] and len(h.removed) + len(h.added)
            kept += left[at : h.left_start - 1]
            at, on = h.left_start - 1 + len(h.removed), h.right_start - 1 + len(h.added)
        assert left[at:] == right[on:]
        # A line that is unique on both sides and in order with all others like it is kept.
        once = [x for x in left if left.count(x) == 1 and right.count(x) == 1]
        if once == [x for x in right if x in once]:
            assert set(once) <= set(kept + left[at:])


def test_hunks_move_texts_once(spark):
    """Nothing is written between rounds, and the texts of a name meet in one shuffle."""
    rows = [(f"n{i}", side, "\n".join(f"{(j * j * (side == 'r') + j) % 7}{i}" for j in range(30))) for i in range(20) for side in "lr"]
    files = spark.createDataFrame(rows, "name string, collection string, content string").withColumn("hash", F.sha2("content", 256))
    with scratch(spark) as cuts:
        found = HU.hunks(files, CP.collection_pairs(files, ["l", "r"]))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert HU.apply_hunks(files, found).count() == 20 and not cuts
    assert plan.count("Exchange hashpartitioning") <= 2


def test_snapshot_statuses_partition_the_union(spark):
    old = spark.createDataFrame([(f"p{i}", str(i % 3)) for i in range(40)], "path string, hash string")
    new = spark.createDataFrame([(f"p{i}", str(i % 2)) for i in range(20, 60)], "path string, hash string")
    counts = {r.status: r["count"] for r in SN.snapshot_diff(old, new).groupBy("status").count().collect()}
    same = sum(i % 3 == i % 2 for i in range(20, 40))
    assert counts == {"removed": 20, "added": 20, "unchanged": same, "modified": 20 - same}
    assert SN.dirty(SN.snapshot_diff(old, old)).first().dirty is False


def reach(edges, seeds, depth, cap, same_host):
    want = {}
    for seed in seeds:
        host, level, seen, at = seed.split("/")[2], {seed}, {seed: 0}, 0
        while level and (depth is None or at < depth):
            at += 1
            level = {b for a, b in edges if a in level and (b.split("/")[2] == host or not same_host) and b not in seen}
            seen.update({b: at for b in level})
            if cap:
                kept = sorted(seen.items(), key=lambda x: (x[1], x[0]))[:cap]
                level &= {u for u, _ in kept}
                seen = dict(kept)
        want.update({(seed, u): d for u, d in seen.items()})
    return want


@pytest.mark.parametrize(
    ("depth", "cap", "n_seeds", "same_host"),
    [(2, None, 4, True), (3, 7, 4, True), (None, None, 4, True), (2, None, 70, False), (None, 5, 80, True), (1, 3, 90, False)],
)
def test_frontier_is_breadth_first(spark, depth, cap, n_seeds, same_host):
    rng = random.Random(13)
    urls = [f"http://h{i % 3}.com/p{i}" for i in range(90)]
    edges = {(a, rng.choice(urls)) for a in urls for _ in range(3)} | {(urls[0], u) for u in urls[::2]}
    rows = WB.expand_frontier(
        spark.createDataFrame(list(edges), "src string, dst string"),
        spark.createDataFrame([(s,) for s in urls[:n_seeds] + urls[:2]], "url string"), depth, cap, same_host, links_per_slice=10,
    ).collect()
    got = {(r.seed, r.url): r.depth for r in rows}
    assert len(got) == len(rows) and got == reach(edges, urls[:n_seeds], depth, cap, same_host)


def test_frontier_without_seeds_or_links(spark):
    none = spark.createDataFrame([], "src string, dst string")
    seeds = spark.createDataFrame([("http://a.com/x",)], "url string")
    assert [tuple(r) for r in WB.expand_frontier(none, seeds, None).collect()] == [("http://a.com/x", "http://a.com/x", 0)]
    assert WB.expand_frontier(none, seeds.limit(0)).count() == 0


def test_a_level_moves_each_page_once(spark):
    """64 seeds of a host that reach the same pages are one row per page; links are not moved again."""
    pages = [f"http://h.com/p{i}" for i in range(64)]
    edges = spark.createDataFrame([(a, f"http://h.com/q{i}") for a in pages for i in range(5)], "src string, dst string")
    from gleaner.session import laid_out

    numbered = WB._numbered_seeds(spark.createDataFrame([(p,) for p in pages], "url string"), True)
    assert numbered.select("block").distinct().count() == 1 and numbered.select("bit").distinct().count() == 64
    with laid_out(edges, ["src"]) as links:
        joined = numbered.join(links.hint("merge"), links["src"] == numbered["seed"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(src" not in plan
    assert WB.expand_frontier(edges, spark.createDataFrame([(p,) for p in pages], "url string")).count() == 64 * 6


@pytest.mark.parametrize("scan", [ST.extract_line_runs, ST.extract_statements])
def test_lines_are_sorted_once(spark, scan):
    """All windows of the line scanner run in the order of the file; cells need no order of their own."""
    text = "noise\nselect a from b\nwhere c = 1\n\nx\ndelete from t where\nupdate u set a = 1\n b = 2;\ninsert into v values (1);\ny"
    files = spark.createDataFrame([("f", text), ("g", "select 1 from x\n\n" + text)], "source_file string, content string")
    found = scan(files)
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    if scan is ST.extract_line_runs:
        got = sorted((r.source_file, r.line_start, r.line_end) for r in found.collect())
        assert got == [("f", 2, 4), ("f", 6, 8), ("f", 9, 9), ("g", 1, 2), ("g", 4, 6), ("g", 8, 10), ("g", 11, 11)]
