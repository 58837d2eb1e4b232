"""Byte-level BPE by longest matches and backtracking, and its inverse.

A sequence of tokens is what the merges give for its bytes exactly if every two neighbours are (``BytePairs.follows``). So a
piece of text is covered from the left with the longest tokens that an Aho-Corasick automaton finds; where a token does not go
with the one before it, the next shorter prefix is tried, and where none is left the last token is taken back. Places that
lead nowhere are marked, so that each is left once, and the work grows with the length of the piece. Bytes are Latin-1 characters
to the automaton. What neighbours go together is remembered, as are whole stretches of text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import free_name, remade

#: Entries of the two memos of a Python worker. A full one of pairs is emptied; one of stretches becomes the older one, from
#: which what is used again is taken over. That changes no result.
MAX_STRETCHES = 250_000
MAX_PAIRS = 1_000_000
LONGEST_STRETCH = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class BytePairs:
    """Tokens of pieces of bytes. The rank of a token is its id; all 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks))
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        if min(self.bytes_of) < 0 or max(self.bytes_of) >= 2**31 or len(self.bytes_of) < len(ranks):
            raise ValueError("ranks must be distinct and below 2^31")
        self.matches = ahocorasick.Automaton()
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        for token, rank in self.whole.items():
            self.matches.add_word(token, rank)
        self.matches.make_automaton()
        self.widest = max(map(len, ranks))
        self.size = dict(zip(ranks.values(), map(len, ranks)))
        self.shorter = {rank: self._longest_prefix(token) for token, rank in ranks.items()}
        #: The two tokens that each token is merged from, and the other way round.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        for rank in sorted(self.bytes_of):
            if len(self.bytes_of[rank]) > 1 and not self._learn(rank):
                raise ValueError(f"token {rank} is no merge of two tokens of lower rank")
        self.known.clear()

    def _longest_prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, -1 for a single byte."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _learn(self, rank: int) -> bool:
        token, left = self.bytes_of[rank], self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[len(self.bytes_of[left]) :], -1)
            if 0 <= right < rank and left < rank and self._follows(left, right):
                self.parts[rank], self.merged[left, right] = (left, right), rank
                return True
            left = self.shorter[left]
        return False

    def _follows(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens along the border between them, the latest first. If two tokens that lie there
        at the same time merge before the next merge that was made, the border would not have stayed."""
        until = 2**31
        while True:
            if self.merged.get((left, right), until) < until:
                return False
            inner = self.parts.get(left, (-1, -1)), self.parts.get(right, (-1, -1))
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if left > right and inner[0][0] >= 0 or inner[1][0] < 0:
                if inner[0][0] < 0:
                    return True
                until, left = left, inner[0][1]
            else:
                until, right = right + 1, inner[1][0]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are, one after the other."""
        pair = left << 32 | right
        if pair not in self.known:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            self.known[pair] = self._follows(left, right)
        return self.known[pair]

    def encode(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1. A piece that is a token is that token."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        size, shorter, known = self.size, self.shorter, self.known.get
        # Longest matches one after the other are the answer if all neighbours among them go together.
        out: list[int] = []
        at, last = 0, -1
        for _, token in self.matches.iter_long(text):
            if last >= 0:
                good = known(last << 32 | token)
                if not good and (good is not None or not self.follows(last, token)):
                    break
            out.append(token)
            at += size[token]
            last = token
        else:
            return out
        # Up to here this is what backtracking would have found as well.
        closed: set[int] = set()
        token = shorter[token]
        while True:
            while token >= 0:
                if at + size[token] not in closed:
                    good = last < 0 or known(last << 32 | token)
                    if good or good is None and self.follows(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == len(text):
                    return out
                # The automaton copies what it is given, so a long piece is handed over in parts.
                last, token = token, next(self.matches.iter_long(text[at : at + self.widest]))[1]
            else:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                last, token = out[-1] if out else -1, shorter[token]


class TextPattern:
    """Matches of the pattern of a rank file as the tiktoken library finds them.

    The letters and numbers of the ``regex`` module may be those of another Unicode version. What tiktoken takes for them is
    asked from it once, and texts with a character that is seen differently are cut by a pattern that lists such characters.
    """

    CLASSES = (r"\p{L}", r"\p{N}", r"\s")

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        characters = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        self.plain = regex.compile(pattern, regex.V1)
        odd: set[str] = set()
        listed = pattern
        for name in self.CLASSES:
            library = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks=single, special_tokens={})
            theirs = set(library.decode(library.encode_ordinary(characters)))
            ours = set(regex.findall(name, characters))
            if theirs != ours:
                odd |= theirs ^ ours
                more, fewer = self.listed(theirs - ours), self.listed(ours - theirs)
                members = rf"[[{name}{more}]--[{fewer}]]" if fewer else f"[{name}{more}]"
                # A set may stand inside another one.
                listed = listed.replace(name, members)
        self.odd = regex.compile(f"[{self.listed(odd)}]") if odd else None
        self.by_list = regex.compile(listed, regex.V1)

    @staticmethod
    def listed(characters: set[str]) -> str:
        """Ranges of a regular expression."""
        codes = np.array(sorted(map(ord, characters)))
        if not len(codes):
            return ""
        cut = np.flatnonzero(np.diff(codes) != 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, cut + 1)], codes[np.append(cut, len(codes) - 1)]))

    def pieces(self, text: str) -> list[str]:
        odd = self.odd and not text.isascii() and self.odd.search(text)
        return (self.by_list if odd else self.plain).findall(text)


class BytePairEncoder:
    """Ids of whole texts. Stretches of blanks and the characters up to the next blank are cut apart by every match of the
    pattern and encoded once, long ones every time."""

    CONTROLS = re.compile("[\\x1c-\\x1f]")

    def __init__(self, path: str, pattern: str):
        import regex

        self.pairs = BytePairs(read_ranks(path))
        self.pattern = TextPattern(pattern)
        stretch = r"\s*+\S++|\s++"
        # Faster, but it takes four more controls for blanks.
        self.quick, self.stretch = re.compile(stretch), regex.compile(stretch)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fresh(self, stretches: list[str]) -> Iterator[bytes]:
        """Ids of stretches of one text. They are cut by the pattern as one text, in which no match goes from one to the next:
        all begin with a blank but one that may be first, all end otherwise but one that may be last."""
        pieces, encode = iter(self.pattern.pieces("".join(stretches))), self.pairs.encode
        for stretch in stretches:
            ids, left = array("i"), len(stretch)
            while left:
                piece = next(pieces)
                left -= len(piece)
                ids.extend(encode(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")))
            yield ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null is empty."""
        text = text or ""
        stretches = (self.stretch if self.CONTROLS.search(text) else self.quick).findall(text)
        if len(self.memo) > MAX_STRETCHES:
            self.older, self.memo = self.memo, {}
        # In the order of the text, each once.
        missing = dict.fromkeys(filterfalse(self.memo.__contains__, stretches))
        again = [s for s in missing if s in self.older]
        for s in again:
            self.memo[s] = self.older[s]
            del missing[s]
        self.memo.update(zip(missing, self.fresh(list(missing))))
        ids = b"".join(map(self.memo.__getitem__, stretches))
        for s in missing:
            if len(s) > LONGEST_STRETCH:
                del self.memo[s]
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One per Python worker, kept between its tasks."""
    return BytePairEncoder(path, pattern)


@dataclass(frozen=True)
class TokenBytes:
    """The bytes of all tokens in one array, and where those of each id lie."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(ranks: dict[bytes, int]) -> TokenBytes:
        size = np.full(max(ranks.values()) + 1, -1)
        by_rank = sorted(ranks, key=ranks.__getitem__)
        size[[ranks[t] for t in by_rank]] = [len(t) for t in by_rank]
        return TokenBytes(np.frombuffer(b"".join(by_rank), np.uint8), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0:
            raise ValueError("an id is no token")
        size = self.size[ids]
        first = self.start[ids] - (np.cumsum(size) - size)
        return self.data[np.repeat(first, size) + np.arange(size.sum())].tobytes()


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes.of(read_ranks(path))


def _column(df: DataFrame, source: str, name: str, kind: T.DataType, run) -> DataFrame:
    """The frame with a column made from ``source``, 256 rows at a time; one of that name gives way."""
    kept = [c for c in df.columns if c.lower() != name.lower()]

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in remade(parts, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], run(batch.column(batch.num_columns - 1))], names=[*kept, name])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])
    handed = F.col(f"`{source}`").alias(free_name(df, "_from"))
    return df.select(*[F.col(f"`{c}`") for c in kept], handed).mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with the ids of its whole text as an array, without special tokens: those that merging the neighbours of
    lowest rank gives in each match of ``pattern``.

    Null and empty texts have no ids. Rows are worked one by one, whatever their keys, so nulls elsewhere and repeated rows
    change nothing; an empty table stays empty; an input column with the name of the result gives way. A text of any
    length is worked in time in proportion to it.
    """

    def run(column: pa.Array) -> pa.Array:
        coded = [encoder(path, pattern).encode(t.as_py()) for t in column]
        ends = np.cumsum([0, *map(len, coded)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))

    return _column(docs, text, ids, T.ArrayType(T.IntegerType()), run)


def decode(coded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the bytes that its ids stand for: the text in UTF-8 if they are those of a whole text. No ids (or
    null) are no bytes; an id that is no token, or null, is an error."""

    def run(column: pa.Array) -> pa.Array:
        back = token_bytes(path).decode
        if column.flatten().null_count:
            raise ValueError("an id is null")
        return pa.array([back(i.values.to_numpy()) if i.is_valid else b"" for i in column], pa.binary())

    return _column(coded, ids, decoded, T.BinaryType(), run)
