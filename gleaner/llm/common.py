"""What the operators of this subpackage share: row keys, words, memoised tokenizers, Arrow batches."""

from __future__ import annotations

import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import durable, release  # noqa: F401  release is part of what operators share

#: Words of the contracts: runs of anything but the six ASCII blanks.
WORD_BREAKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have yet (names differ without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def with_row_key(df: DataFrame, wish: str = "_row") -> tuple[DataFrame, str]:
    """The frame as a written table with a unique long per row, so that null or repeated ids lose no row. The table is
    what makes the number stable: later stages read it, they do not number again."""
    name = free_name(df, wish)
    return durable(df.withColumn(name, F.monotonically_increasing_id())), name


def placed(df: DataFrame, wish: str = "_row") -> tuple[DataFrame, str]:
    """The frame with a unique key per row, without a copy of it where it is read from files that number their rows: file
    and row index. A frame whose rows don't stand for one row of a file each (counted) is written with numbers instead."""
    name = free_name(df, wish)
    place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    try:
        found = df.withColumn(name, place)
    except AnalysisException:
        return with_row_key(df, wish)
    once = found.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (found, name) if once else with_row_key(df, wish)


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; an input column of the same name (in any case) gives way."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_BREAKS}]+"), lambda w: w != "")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words, A-Z in lower case, as UTF-8: bytes.split() cuts at exactly these six blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While a written cut is made: hand rows to Python in batches of so many bytes, since buffers on both sides of the pipe
    hold whole batches. The session's own value comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remade(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, to bound what a task holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts in a column, but for the first, hold at most so many bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: 0 is cut from nothing, letters, digits and punctuation are cut from each other. LEAD may begin a blank
#: outside ASCII.
LETTER, DIGIT, MARK, BLANK, ODD, LEAD = range(1, 7)
WIDE_BLANKS = np.array([i for i in range(0x80, 0x10000) if chr(i).isspace()])
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (LETTER, string.ascii_letters.encode()),
    (DIGIT, string.digits.encode()),
    (MARK, string.punctuation.replace("'", "").encode()),
    (BLANK, b" \n"),
    (ODD, b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"),
    (LEAD, {chr(i).encode()[0] for i in WIDE_BLANKS.tolist()}),
):
    KINDS[list(_bytes)] = _kind
#: Where blanks are dropped, all that both str.split() and the tokenizer drop.
WORD_KINDS = KINDS.copy()
WORD_KINDS[list(b"\t\r\x0b\x0c")] = BLANK


class MemoTokenizer:
    """Token ids of whole texts by a file of the tokenizers library.

    Both pre-tokenizers in use always cut between a character that is no blank and a following space or line feed, so the
    stretches `blanks + non-blanks` of a text are encoded apart (``cut`` makes them shorter still), and equal ones once. A
    text with any other blank is encoded whole. The memo holds two generations of at most ``max_entries`` stretches: the older one is dropped when the
    younger is full, and what is used again moves to the younger one. That changes no id. Where the tokenizer drops blanks,
    the stretches are the words alone, whatever the blanks between them.

    ``special`` says what becomes of the string of a special token within a text: "text" encodes it like other characters,
    "token" gives its id, as the library's plain call does; such texts are encoded whole.
    """

    PIECE = re.compile(r"[ \n]*\S+")
    #: Blanks to str.split(), symbols to the tokenizers.
    SEPARATORS = re.compile("[\\x1c-\\x1f]")
    LONGEST = 200
    JOINED = 256
    #: Texts in a call of the library, whose results take a hundred bytes and more a token.
    CALLED = 16

    def __init__(self, path: str, max_entries: int = 250_000, special: str = "text"):
        if special not in ("text", "token"):
            raise ValueError(f"unknown special {special!r}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special == "text"
        # Without case, as some tokenizers fold it before they look for tokens; a text too many is only encoded whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(added), re.IGNORECASE) if added and special == "token" else None
        first = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # What tells by its first byte that a text may hold a special token; None: nothing does.
        self.first_bytes = np.array([ord(c) for c in first], np.uint8) if all(c.isascii() and not c.isalpha() for c in first) else None
        self.max_entries = max_entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Bytes that each token stands for (a byte-level vocabulary has one character per byte), to tell which ids of a
        # joined text belong to which stretch.
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix)) if suffix else len(token)
        self.keeps_blanks = int(self.sizes[self.tokenizer.encode(" a", add_special_tokens=False).ids].sum()) == 2

    def pieces(self, text: str) -> list[str]:
        if self.whole and self.whole.search(text):
            return [text]
        if not self.keeps_blanks and not self.SEPARATORS.search(text):
            return text.split()
        found = self.PIECE.findall(text)
        rest = len(text) - sum(map(len, found))
        if rest:
            tail = text[-rest:]
            if tail.strip(" \n"):
                return [text]
            found.append(tail)
        return found

    def called(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), self.CALLED):
            for coded in self.tokenizer.encode_batch_fast(texts[at : at + self.CALLED], add_special_tokens=False):
                yield np.array(coded.ids, dtype="<u4")

    def plain(self, pieces: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.called(pieces)]

    def size_in_tokens(self, pieces: list[str]) -> list[int]:
        """Bytes of stretches as their tokens hold them."""
        if not self.keeps_blanks:
            pieces = [p if p.isascii() else unicodedata.normalize("NFC", p).lower() for p in pieces]
        return [len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces]

    def many(self, pieces: list[str], special: bool = True) -> list[bytes]:
        """Ids of stretches: words, or in a tokenizer that keeps blanks those that start with a single space, are encoded as
        joined texts and told apart by the bytes of their tokens; the rest, and a text whose ends do not fit exactly, one by
        one. ``special``: some may hold the string of a special token."""
        if self.keeps_blanks:
            fits, glue = [len(p) > 1 and p[0] == " " and p[1] not in " \n" for p in pieces], ""
        else:
            fits, glue = [p != "" and p.strip() == p for p in pieces], " "
        if special and self.whole:
            fits = [fit and not self.whole.search(p) for fit, p in zip(fits, pieces)]
        joined = list(compress(pieces, fits))
        groups = [joined[at : at + self.JOINED] for at in range(0, len(joined), self.JOINED)]
        coded: list[bytes] = []
        for group, ids in zip(groups, self.called([glue.join(g) for g in groups])):
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(self.size_in_tokens(group))
            at = np.searchsorted(ends, wanted)
            if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == wanted).all():
                raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                coded += map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))
            else:
                coded += self.plain(group)
        if len(joined) == len(pieces):
            return coded
        rest = iter(self.plain([p for p, fit in zip(pieces, fits) if not fit]))
        return [next(part) for part in map((rest, iter(coded)).__getitem__, fits)]

    def ids_of(self, pieces: list[str], special: bool = True) -> list[bytes]:
        """Ids of distinct stretches, remembered or new."""
        if len(self.young) > self.max_entries:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if self.old and missing:
            again = [i for i in missing if pieces[i] in self.old]
            for i in again:
                found[i] = self.young[pieces[i]] = self.old[pieces[i]]
            missing = [i for i in missing if found[i] is None]
        if missing:
            new = list(map(pieces.__getitem__, missing))
            ids = self.many(new, special)
            for i, x in zip(missing, ids):
                found[i] = x
            if max(map(len, new)) <= self.LONGEST:
                self.young.update(zip(new, ids))
            else:
                self.young.update((p, x) for p, x in zip(new, ids) if len(p) <= self.LONGEST)
        return found

    def odd(self, data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts hold a blank that the cuts by bytes don't know, or the string of a special token."""
        at = np.flatnonzero(kinds == ODD)
        lead = np.flatnonzero(kinds == LEAD)
        if len(lead):
            first, second, third = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3))
            point = np.where(first == 0xC2, second, (first & 15) << 12 | (second & 63) << 6 | third & 63)
            at = np.append(at, lead[np.isin(point, WIDE_BLANKS)])
        found = np.zeros(len(texts), bool)
        found[np.searchsorted(offsets, at, "right") - 1] = True
        if self.whole:
            some = range(len(texts))
            if self.first_bytes is not None:
                some = np.unique(np.searchsorted(offsets, np.flatnonzero(np.isin(data, self.first_bytes)), "right") - 1).tolist()
            for i in some:
                found[i] = found[i] or bool(self.whole.search(texts[i].as_py()))
        return found

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The stretches of texts (large strings without nulls) one after another, where each text's end, and which texts
        are odd: those have none. Besides the cuts before blanks, ASCII letters, digits and punctuation (but no apostrophe)
        are cut from each other, and a single line feed from what follows: the pre-tokenizers always do."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = (KINDS if self.keeps_blanks else WORD_KINDS)[data]
        odd = self.odd(data, kinds, offsets, texts)
        if odd.any():
            texts = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
            return *self.cut(texts)[:2], odd
        blank = kinds == BLANK
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets[:-1]] = True
        starts[-1] = False
        begins = starts[:-1].copy()
        classed = kinds - np.uint8(1) < 3
        starts[1:-1] |= classed[1:] & classed[:-1] & (kinds[1:] != kinds[:-1])
        if self.keeps_blanks:
            starts[1:-1] |= blank[1:] & ~blank[:-1]
            single = (data == 10) & starts[:-1]
            starts[1:-1] |= single[:-1] & ~blank[1:]
            at = np.flatnonzero(starts)
        else:
            starts[1:-1] |= blank[:-1]
            at = np.flatnonzero(starts[:-1] & ~blank)
            # A text's leading blanks hide its first cut.
            if (begins & blank).any():
                at = np.union1d(at, np.flatnonzero(~blank[1:] & blank[:-1]) + 1)
            kept = np.concatenate([[0], np.cumsum(~blank)])
            data, at, offsets = data[~blank], kept[at], kept[offsets]
        ends = np.searchsorted(at, offsets[1:])
        buffers = [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.LargeStringArray.from_buffers(len(at), *buffers[1:]), ends, odd

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one text after another, and each text's end among them; null is empty. A stretch is
        looked up once for the whole column. ``end_id`` follows every text."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        pieces, last, odd = self.cut(texts)
        coded = pieces.dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), special=False)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, code = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        each = sizes[code]
        done = np.concatenate([[0], np.cumsum(each)])
        flat = pool[np.arange(done[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - done[:-1], each)]
        ends = done[last]
        if odd.any():
            parts = np.split(flat, ends[:-1])
            for i in np.flatnonzero(odd).tolist():
                own = self.pieces(texts[i].as_py())
                known = dict.fromkeys(own)
                known.update(zip(known, self.ids_of(list(known))))
                parts[i] = np.frombuffer(b"".join([known[p] for p in own]), "<u4")
            flat, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        if end_id is not None:
            flat, ends = np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)
        return flat, ends

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1])


@lru_cache(maxsize=1)
def memo_tokenizer(path: str, max_entries: int = 250_000, special: str = "text") -> MemoTokenizer:
    """One per Python worker, kept between its tasks."""
    return MemoTokenizer(path, max_entries, special)
