"""Memoised tokenizers, token files and packing against plain encodes."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gleaner.llm import packing, token_files
from gleaner.llm.common import MemoTokenizer, by_bytes, tokenizer_path
from gleaner.llm.queries import QUERIES
from gleaner.session import shared_folder

SF_DIR = "/root/testdata/sf0.001"
BYTE, WORD = (tokenizer_path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n\n", "a", "  two  spaces \n\n\n lines  ", "tab\there and\tthere", "a b  c d", "é café x́", "\x1c \x85   end ",
    "it's we'll  they'RE 's 't", "12345 3.14 1,000", "<|endoftext|> <|startoftext|>a", "\U0001f600\U0001f600 中文 text", "x" * 5000, "  " * 300 + "z", "word " * 2000, "A\nB \nC\n D",
]
SCHEMA = "doc_id long, text string"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_ids_of_whole_texts(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("ab '\n\t1.,é#  ") for _ in range(rng.randrange(60))) for _ in range(400)]
    memo = MemoTokenizer(path, max_entries=50)
    for _ in range(2):
        for text, ids in zip(texts, memo.encode(texts)):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_hands_the_library_few_texts_at_a_time(path):
    """What a call returns takes a hundred bytes and more a token."""
    memo = MemoTokenizer(path)
    plain, sizes = memo.tokenizer, []

    class Noted:
        def encode_batch_fast(self, texts, **kw):
            sizes.append(sum(map(len, texts)))
            return plain.encode_batch_fast(texts, **kw)

    memo.tokenizer = Noted()
    text = " ".join(f"{'abcdefghij'[i % 10]}w{i}" for i in range(60_000))
    assert memo.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 0 < max(sizes) < 50_000


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_ids_of_the_plain_library_call(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [*ODD, "x <|endoftext|> y", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x", "it's <|endoftext|>\n\n  two", "x <|endoftext|>\u0338"]
    memo = MemoTokenizer(path, max_entries=5, special="token")
    for _ in range(2):
        for text, ids in zip(texts, memo.encode(texts)):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_queries_take_special_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.createDataFrame([(1, "x <|endoftext|> y")], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    word, byte = ([*Tokenizer.from_file(p).encode("x <|endoftext|> y", add_special_tokens=False).ids, 2] for p in (WORD, BYTE))
    assert QUERIES["op10_token_files"](spark, str(tmp_path)).first()["ids_crc32"] == crc(word)
    assert QUERIES["op4_packing"](spark, str(tmp_path)).first()["ids_crc32"] == crc(byte)
    assert corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).first()["ids_crc32"] == crc(byte)


def test_token_files_round_trip(spark):
    rows = [(i * 7 % 19, t) for i, t in enumerate(ODD)] + [(None, "none"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ids", "2 AS file_no").repartition(3)
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(docs, path, WORD)
    got = token_files.read_tokens(spark, path).toPandas().sort_values("start")
    key = got.doc_id.fillna(-1).tolist()
    assert key == sorted(key) and len(got) == len(rows)
    assert got.start.tolist() == np.concatenate([[0], got.n_tokens.cumsum()[:-1]]).tolist()
    plain = MemoTokenizer(WORD)
    want = Counter((-1 if d is None else d, tuple([*plain.encode([t])[0].tolist(), 2])) for d, t in rows)
    assert Counter((int(k), tuple(ids)) for k, ids in zip(key, got.ids)) == want
    crcs = token_files.with_crc(token_files.read_tokens(spark, path)).toPandas().sort_values("start")
    assert crcs.ids_crc32.tolist() == [crc(ids) for ids in got.ids]
    empty = shared_folder(spark, "tokens")
    token_files.write_token_files(docs.limit(0), empty, WORD)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_file_format(spark):
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1), path, WORD)
    file = spark.read.parquet(path).inputFiles()[0].removeprefix("file://").removeprefix("file:")
    meta = pq.ParquetFile(file).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert meta.row_group(0).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
    one = token_files.read_tokens(spark, path).where("doc_id = 500")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,500)" in one._jdf.queryExecution().toString()


def test_token_query(spark):
    got = QUERIES["op10_token_files"](spark, SF_DIR).toPandas().set_index("doc_id")
    plain, at = MemoTokenizer(WORD), 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain.encode([r["text"]])[0].tolist(), 2]
        assert tuple(got.loc[r["doc_id"]]) == (at, len(ids), crc(ids))
        at += len(ids)


def fits(pdf, capacity):
    """Sequences hold at most the capacity and have no gaps."""
    last = pdf.sort_values(["sequence_id", "offset", "length"])
    ends = last.offset + last.length
    first = last.sequence_id != last.sequence_id.shift()
    assert (last.offset[first] == 0).all() and (last.offset[~first] == ends.shift()[~first]).all() and ends.max() <= capacity


def test_packing_query(spark):
    got = QUERIES["op4_packing"](spark, SF_DIR).toPandas()
    fits(got, 1024)
    plain = MemoTokenizer(BYTE)
    n = 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = [*plain.encode([r["text"]])[0].tolist(), 2]
        own = got[got.doc_id == r["doc_id"]].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
        assert (own.length[1:] == 1024).all() and (len(own) == 1 or len(ids) > 1024)
        assert own.ids_crc32.tolist() == [crc(ids[a : a + k]) for a, k in zip(own.start, own.length)]
        n += len(ids)
    assert got.sequence_id.nunique() <= 1.02 * packing.lower_bound(dict(Counter(got.length.tolist())), 1024)


def test_packing_of_odd_rows(spark):
    rows = [(None, None), (None, "a"), (1, "b"), (1, "b"), (2, "word " * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS length", "8 AS sequence_id", "9 AS rank")
    got = packing.pack(docs, BYTE).toPandas()
    fits(got, 1024)
    assert got[got.doc_id.isna()].shape[0] == 2 and got[got.doc_id == 1].shape[0] == 2
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def used(plan):
    total = Counter()
    for times, filling in plan:
        for size, n in filling:
            total[size] += n * times
    return dict(total)


@pytest.mark.parametrize("seed", range(30))
def test_fillings_place_every_item_and_are_few(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 24, 100, 1024])
    counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.choice([5, 12, 400]))))
    plan = packing.fill(counts, capacity)
    assert used(plan) == counts and all(sum(s * n for s, n in f) <= capacity for _, f in plan)
    bins, bound = sum(t for t, _ in plan), packing.lower_bound(counts, capacity)
    assert bound <= bins <= sum(t for t, _ in packing.best_fit(counts, capacity))
    if sum(counts.values()) <= 12:
        assert bins == fewest(sorted(Counter(counts).elements(), reverse=True), capacity)


def fewest(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_search_beats_best_fit():
    counts = {6: 1, 5: 1, 4: 2, 3: 2, 2: 0, 7: 1}
    assert sum(t for t, _ in packing.fill({44: 1, 24: 1, 24: 2, 22: 1, 21: 1, 17: 2, 8: 2, 6: 2}, 61)) == 4
    assert sum(t for t, _ in packing.fill(counts, 16)) == 2


def test_search_reaches_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 0.8, 3000).astype(int) + 1, 1, 1024)
    counts = dict(Counter(lengths.tolist()))
    plan = packing.fill(counts, 1024)
    bound, plain = packing.lower_bound(counts, 1024), sum(t for t, _ in packing.best_fit(counts, 1024))
    assert bound == sum(t for t, _ in plan) < plain
    used = Counter()
    for times, filling in plan:
        assert sum(s * n for s, n in filling) <= 1024
        used.update({s: n * times for s, n in filling})
    assert used == Counter(counts)


def test_exact_search_equals_brute_force():
    rng = random.Random(5)

    def least(items, rooms):
        if not items:
            return len(rooms)
        s, rest = items[0], items[1:]
        ways = [least(rest, [*rooms, 30 - s])]
        for i in {r: i for i, r in enumerate(rooms) if r >= s}.values():
            ways.append(least(rest, [*rooms[:i], rooms[i] - s, *rooms[i + 1 :]]))
        return min(ways)

    for _ in range(150):
        items = sorted((rng.randrange(4, 24) for _ in range(rng.randrange(1, 9))), reverse=True)
        plan = packing.fill(dict(Counter(items)), 30, None, None)
        assert sum(t for t, _ in plan) == least(items, []), items


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("special", ["text", "token"])
def test_columns_give_the_ids_of_whole_texts(path, special):
    """All neighbours of kinds of characters, in columns that are slices and hold nulls, with the memo in two generations."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = special == "text"
    rng = random.Random(3)
    parts = [*" \n\n  '.,#(<=_|1290abZ\t\r\x0b\x1c\x85\xa0 　’̸́é中Σ\U0001f600\x00\x7f", "'s", "'LL", "word", "<|endoftext|>", "<|ENDOFTEXT|>", "x" * 300]
    plainer = [*" \n'.,#(<=_|19abZé", "̸", "'s", " word", "\n\n"]
    texts = [*ODD, *("".join(rng.choices(p, k=rng.randrange(12))) for p in (parts, plainer) for _ in range(1500)), None, ""]
    rng.shuffle(texts)
    memo = MemoTokenizer(path, max_entries=300, special=special)
    for at in range(0, len(texts), 97):
        flat, ends = memo.encode_column(pa.array(["cut off", *texts[at : at + 97], None], pa.string())[1:], end_id=2)
        for text, ids in zip([*texts[at : at + 97], None], np.split(flat, ends[:-1])):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_are_encoded_once_whatever_marks_follow(path):
    memo = MemoTokenizer(path, special="token")
    seen = []
    whole = memo.many
    memo.many = lambda pieces, *a, **k: seen.extend(pieces) or whole(pieces, *a, **k)
    texts = [f"some {word}{mark} (other) {n}{mark}\nnext" for word in ("alpha", "beta") for mark in ".,;:!?" for n in (1, 2)]
    memo.encode(texts)
    memo.encode(texts)
    assert len(seen) == len(set(seen)) <= 20


def test_batches_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 95, "c" * 300, "d"])], names=["t"])
    got = [b.column(0).to_pylist() for b in by_bytes([batch, batch.slice(0, 0)], 0, 100)]
    assert [x for part in got for x in part] == batch.column(0).to_pylist()
    assert len(got) == 3 and all(sum(len(x or "") for x in part[1:]) <= 100 for part in got)
