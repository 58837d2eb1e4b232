import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import byte_pairs, conversations, lexical, queries
from gleaner.llm.common import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


# Conversations


def cheapest(rows):
    """All edits of few rows, one by one."""
    wanted, best = re.compile(r"(s?(ua)+)?"), None
    options = []
    for r in rows:
        stays = [("K", r.stays_at, r.initial or "_"), ("R", 2 + r.stays_at, "u"), ("R", 2 + r.stays_at, "a")]
        options.append([("D", 3, "")] + ([] if r.must_go else stays))
    for chosen in itertools.product(*options):
        for added in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles, edits, cost = added[0], "I" * len(added[0]), 2 * len(added[0])
            for (edit, c, role), more in zip(chosen, added[1:]):
                roles, edits, cost = roles + role + more, edits + edit + "I" * len(more), cost + c + 2 * len(more)
            if wanted.fullmatch(roles) and (best is None or (cost, edits) < best):
                best = cost, edits
    return best


def random_rows(rng, n, roles=("system", "user", "user", "assistant", "assistant", "tool", "", " ")):
    faults = [None, None, None, "truncated", "blank", "duplicate"]
    return [conversations.Row(rng.choice(roles), f"t{i}", rng.choice(faults)) for i in range(n)]


def repaired(rows):
    state = conversations.Repair()
    edits = [e for r in rows for e in state.add(None, r)] + list(state.close())
    return state.summary(), edits


@pytest.mark.parametrize("block", [1, 2, 64])
def test_search_finds_the_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(4))
        summary, edits = repaired(rows)
        assert (summary["cost"], summary["audit"]) == cheapest(rows)
        assert "".join(e for e, _, _ in edits) == summary["audit"]
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for e, role, _ in edits if e != "D"))


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(5)
    for _ in range(10):
        rows, found = random_rows(rng, rng.randrange(20, 120)), []
        for block in (5, 33, 1000):
            monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
            found.append(repaired(rows))
        assert found[0] == found[1] == found[2]


def plain_repair(rows):
    """One conversation (turn, role, text) after damage by a plain forward pass over states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append(conversations.Row(role, text, fault))
    ways = {0: (0, "", ())}
    for r in [*marked, None]:
        for _ in range(3):
            for s, (cost, edits, out) in list(ways.items()):
                more = cost + 2, edits + "I", (*out, (conversations.DUE[s], ""))
                ways[conversations.AFTER[s]] = min(ways.get(conversations.AFTER[s], more), more)
        if r is None:
            break
        after = {}
        for s, (cost, edits, out) in ways.items():
            steps = [(s, (cost + 3, edits + "D", out))]
            if not r.must_go:
                due = conversations.DUE[s]
                edit = "K" if r.role[:1] == due[0] else "R"
                role = r.role if edit == "K" else due
                steps.append((conversations.AFTER[s], (cost + 2 * (edit == "R") + r.stays_at, edits + edit, (*out, (role, r.text)))))
                if s == 0 and r.role[:1] == "s":
                    steps.append((1, (cost + r.stays_at, edits + "K", (*out, (r.role, r.text)))))
            for s2, way in steps:
                after[s2] = min(after.get(s2, way), way)
        ways = after
    cost, audit, out = min(ways[s] for s in (0, 3) if s in ways)
    turns = [t for t, _, _ in rows if t is not None]
    faults = [r.fault for r in marked]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def plain_damage(rows):
    by_key = {}
    for key, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        left = by_key.setdefault(key, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        left += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return by_key


def as_tuples(rows):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_conversation_query_against_a_plain_pass(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = as_tuples(queries.op11_conversation_repair(spark, SF_DIR).collect())
    assert found == {k: plain_repair(v) for k, v in plain_damage(rows).items()}


def test_odd_conversations(spark):
    rng = random.Random(2)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "ünder"], ["a.", "a.", "b", "", None, " \n", "c!\n ", "d?"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(99, t, "user" if t % 2 else "assistant", f"long {t}.") for t in range(700)] + [(98, 2**63 - 1, "user", "x."), (98, -(2**63), "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("KIND", F.lit(1)).withColumn("step", F.lit("s"))
    found = conversations.repair_damaged(df.repartition(5))
    plain = {k: plain_repair(v) for k, v in plain_damage(rows).items()}
    plain = {k: (min(v[0], 2**63 - 1), *v[1:]) for k, v in plain.items()}
    assert as_tuples(found.collect()) == plain
    assert conversations.repair_damaged(df.limit(0)).count() == 0
    edits = conversations.repair(df.where("conv_id = 99")).where("edit <> 'D'").orderBy("step").collect()
    assert [e["role"][0] for e in edits] == ["u", "a"] * (len(edits) // 2)


# Lexical search


def plain_search(docs, items, top=50):
    find = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: find.findall((t or "").translate(lower))
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, w) for d, w in counted if w]
    total, df = sum(len(w) for _, w in counted), {}
    for _, w in counted:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    found = []
    for item, text in items:
        scored = []
        for d, w in counted:
            m = 50 + (50 * len(w) * len(counted)) // total
            score = 0
            for x in set(terms(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[x] + 1)))
                score += weight * ((1000000000 * w.count(x)) // (1000 * w.count(x) + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return found


def test_search_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCUMENT_TILE", 16)
    monkeypatch.setattr(lexical, "TERM_TILE", 8)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    rng = random.Random(1)
    words = ["a", "B", "é", "Él", "x1", "中", "the", "THE", "zz", "q"]
    text = lambda: rng.choice([None, "", "--", *[" ".join(rng.choices(words, k=rng.randrange(1, 30))) + rng.choice(["", "\n,x;y"]) for _ in range(6)]])
    docs = [(rng.choice([None, *range(60)]), text()) for _ in range(150)] + [(i, "the same") for i in range(80)]
    items = [(i, text()) for i in range(7)] + [(None, "the zz"), (3, "the"), (4, "unseen words")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("r")).withColumn("row", F.lit(1)).repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("k")).withColumn("score", F.lit(1))
    none_last = lambda rows: sorted(map(tuple, rows), key=str)
    assert none_last(lexical.search(d, q).collect()) == none_last(plain_search(docs, items))
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0


def test_tiles_are_exact():
    rng = np.random.default_rng(0)
    weights = np.full(5000, 26_000)
    width = lexical.tile_width(weights)
    assert width * 26_000 * (lexical.IMPACT_SCALE // lexical.IMPACT_TF) < 2**53
    assert lexical.tile_width(np.full(3, 2**50)) == 1
    block = lexical.ItemBlock.of([0, 1], [" ".join(f"w{i}" for i in range(5000)), "w1 w2"])
    counts, owner = rng.integers(1, 10**6, 20000), rng.integers(0, 9, 20000)
    pairs = np.unique(np.stack([rng.integers(0, 5000, 20000), owner]), axis=1)
    counts, m = counts[: pairs.shape[1]], rng.integers(50, 10**6, 9)
    got = lexical.tile_scores(block, weights, pairs[0], counts, pairs[1], m)
    want = np.zeros((2, 9), object)
    for t, d, c in zip(*pairs.tolist(), counts.tolist()):
        value = 26_000 * ((10**9 * c) // (1000 * c + 20 * int(m[d])))
        want[0, d] += value
        want[1, d] += value if t in (1, 2) else 0
    assert (got == want.astype(np.int64)).all()


def test_ties_at_the_cut_of_a_tile():
    scores = np.array([[5, 7, 5, 5, 0], [0, 0, 0, 0, 0]])
    items, docs = lexical.best_of(scores, np.array([4, 3, 2, 1, 0]), 2)
    assert items.tolist() == [0, 0] and docs.tolist() == [1, 3]


# Byte-level BPE


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path(request.param)
    library = tiktoken.Encoding(request.param, pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(path), special_tokens={})
    return byte_pairs.encoder(path, public_tokenizers.PATTERN), library


def test_ids_are_those_of_the_library(both):
    own, library = both
    rng = random.Random(4)
    kinds = ["abcdefghijklmnopqrstuvwxyz ABC  \n\t0123456789.,'é中\U0003efe2\U00012580\x1c\x85  😀ß", "abcdst", "etaoin ", " \n\t"]
    texts = ["", " ", "<|endoftext|>", "it's I'll we'd", "a" * 5000, " " * 5000 + "x", "ab" * 5000]
    texts += ["".join(rng.choices(kinds[i % 4], k=rng.randrange(200))) for i in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode_ordinary(text)


def test_ids_back_to_bytes(both):
    own, library = both
    table = byte_pairs.TokenBytes.of(own.pairs.ranks)
    ids = np.array(random.Random(1).choices(sorted(own.pairs.bytes_of), k=5000), np.int32)
    assert table.decode(ids) == library.decode_bytes(ids.tolist()) and table.decode(ids[:0]) == b""
    for wrong in (-1, len(table.size)):
        with pytest.raises(ValueError):
            table.decode(np.array([0, wrong], np.int32))


def test_every_token_comes_from_its_parts(both):
    own, _ = both
    assert len(own.pairs.parts) == len(own.pairs.ranks) - 256
    with pytest.raises(ValueError):
        byte_pairs.BytePairs({bytes([b]): b for b in range(255)})
    with pytest.raises(ValueError):
        byte_pairs.BytePairs({bytes([b]): b for b in range(256)} | {b"abc": 256})


def test_long_pieces_take_time_in_proportion(both):
    import time

    own, _ = both
    rng = random.Random(0)
    for letters in ("ab", "etaoinshr"):
        piece = "".join(rng.choices(letters, k=400_000))
        began = time.time()
        own.pairs.encode(piece)
        assert time.time() - began < 30


def test_byte_pair_query_and_odd_rows(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op13_byte_pairs(spark, SF_DIR).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())
    rows = [(None, None, 1), (1, "", None), (1, "same text", 2), (1, "same text", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS long")
    coded = byte_pairs.encode(df, path, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = byte_pairs.decode(coded, path).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == ["", "", "same text", "same text"]
    assert [len(r["ids"]) for r in back[:2]] == [0, 0]
    assert byte_pairs.encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_lexical_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    want = con.execute(queries.OP12_SQL).fetchall()
    found = queries.op12_lexical_search(spark, SF_DIR).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, found)) == sorted(want)
