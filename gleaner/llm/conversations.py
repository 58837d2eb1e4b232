"""Repair of conversations by depth-first branch and bound.

Roles are to follow each other as an optional system turn and then pairs of user and assistant. Rows may be kept (K, 0), given
the role that is due (R, 2) or deleted (D, 3), and a turn without text may be inserted anywhere (I, 2). A row that is blank or
repeats an earlier one has to go; one without an end mark costs 1 more if it stays. Of the cheapest ways the one with the least
string of edits is taken.

``search`` walks a stack of partial repairs. A partial repair is dropped if its cost and a lower bound for the rows left exceed
the incumbent, or if the table of its node (rows done, what is due) has one with less (cost, edits). Equal costs make neither
string of edits a prefix of the other, since every edit without a row costs something, so the lesser one stays the lesser one
whatever follows. For the same reason a long conversation may be searched in blocks of rows: of every block the best way from
each state to each state is enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from gleaner.llm.common import remade

#: Rows and characters of a block of the search. They bound what a task holds; the result does not depend on them.
BLOCK_ROWS = 64
BLOCK_CHARACTERS = 8 << 20
BLANKS = " \t\n\v\f\r"
END_MARKS = ".!?"

#: What may come next: anything, a user after the system turn, an assistant, a user after an assistant.
START, OPENED, ASKED, ANSWERED = range(4)
DUE = {START: "user", OPENED: "user", ASKED: "assistant", ANSWERED: "user"}
AFTER = {START: ASKED, OPENED: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
ENDS = {START, ANSWERED}
LEGAL = {"su", "ua", "au"}
KEEP, RENAME, DELETE, INSERT, UNENDED = 0, 2, 3, 2, 1
#: No two states differ by more than this in what any continuation costs: a system row deleted and a turn inserted.
SLACK = DELETE + INSERT


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    fault: str | None

    @property
    def initial(self) -> str:
        return self.role[:1]

    @property
    def must_go(self) -> bool:
        return self.fault in ("blank", "duplicate")

    @property
    def stays_at(self) -> int:
        return UNENDED if self.fault == "truncated" else 0


def suffix_bounds(rows: list[Row], last: bool) -> list[list[int]]:
    """For every number of rows done and every state, what the rest costs at least, edits as strings left aside: worked from
    the end, a row at a time, with up to two turns inserted before each."""
    inserted = lambda costs: [min(costs[s], INSERT + costs[AFTER[s]], 2 * INSERT + costs[AFTER[AFTER[s]]]) for s in DUE]
    far = 10**18
    bounds = [inserted([0 if not last or s in ENDS else far for s in DUE])]
    for row in reversed(rows):
        rest = bounds[-1]
        bounds.append(inserted([min(more + rest[after] for more, edit, _, after in children([row], 0, s) if edit != "I") for s in DUE]))
    return bounds[::-1]


def children(rows: list[Row], i: int, state: int) -> list[tuple[int, str, int, int]]:
    """(cost, edit, rows done, state) of every edit that a node allows."""
    found = [(INSERT, "I", i, AFTER[state])]
    if i < len(rows):
        row = rows[i]
        found.append((DELETE, "D", i + 1, state))
        if not row.must_go:
            if row.initial == DUE[state][0]:
                found.append((KEEP + row.stays_at, "K", i + 1, AFTER[state]))
            else:
                found.append((RENAME + row.stays_at, "R", i + 1, AFTER[state]))
            if state == START and row.initial == "s":
                found.append((KEEP + row.stays_at, "K", i + 1, OPENED))
    return found


def search(rows: list[Row], entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, edits) from ``entry`` to every state behind the rows; with ``last`` only the best of the states in
    which a conversation may end. Turns are inserted behind the rows of the last block only, elsewhere the next block does."""
    bounds, n = suffix_bounds(rows, last), len(rows)
    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    incumbent: tuple[int, str] | None = None
    end = entry
    stack = [(0, "", 0, entry)]
    while stack:
        cost, edits, i, state = stack.pop()
        if best[i, state] != (cost, edits):
            continue  # a better one has come to this node since
        if incumbent is not None:
            least = cost + bounds[i][state]
            if last and (least > incumbent[0] or least == incumbent[0] and edits > incumbent[1][: len(edits)]):
                continue
            if not last and least > incumbent[0] + SLACK:
                continue
        if i == n:
            if (not last or state in ENDS) and (incumbent is None or (cost, edits) < incumbent):
                incumbent, end = (cost, edits), state
            if not last:
                continue
        # The most promising child comes from the stack first, of equal ones the one with the least edit.
        for more, edit, j, after in sorted(children(rows, i, state), key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True):
            fresh = cost + more, edits + edit
            if (j, after) not in best or fresh < best[j, after]:
                best[j, after] = fresh
                stack.append((*fresh, j, after))
    if last:
        return {end: incumbent} if incumbent is not None else {}
    return {state: found for (i, state), found in best.items() if i == n}


def applied(rows: list[Row], state: int, edits: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every edit; those of deleted rows are their own."""
    left = iter(rows)
    for edit in edits:
        if edit == "I":
            yield edit, DUE[state], ""
        else:
            row = next(left)
            if edit == "K" and state == START and row.initial == "s":
                yield edit, row.role, row.text
                state = OPENED
                continue
            yield edit, DUE[state] if edit == "R" else row.role, row.text
        if edit != "D":
            state = AFTER[state]


@dataclass
class Way:
    """The best repair so far that leads to one state; ``pending`` are blocks whose edits are not settled yet."""

    cost: int = 0
    edits: str = ""
    pending: list[tuple[list[Row], int, str]] = field(default_factory=list)


class Repair:
    """One conversation, row by row. Edits are given out as soon as all ways agree on them."""

    def __init__(self) -> None:
        self.ways = {START: Way()}
        self.rows: list[Row] = []
        self.characters = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.initial: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, row: Row) -> Iterator[tuple[str, str, str]]:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if row.fault:
            self.counts[row.fault] += 1
        if self.initial is not None and self.initial + row.initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = row.initial
        self.rows.append(row)
        self.characters += len(row.text)
        if len(self.rows) >= BLOCK_ROWS or self.characters >= BLOCK_CHARACTERS:
            yield from self.close_block(last=False)

    def close_block(self, last: bool) -> Iterator[tuple[str, str, str]]:
        rows, self.rows, self.characters = self.rows, [], 0
        found: dict[int, Way] = {}
        for entry, way in self.ways.items():
            for state, (cost, edits) in search(rows, entry, last).items():
                state = ANSWERED if last else state
                key = way.cost + cost, way.edits + edits
                if state not in found or key < (found[state].cost, found[state].edits):
                    found[state] = Way(*key, [*way.pending, (rows, entry, edits)])
        self.ways = found
        lists = [way.pending for way in found.values()]
        while all(lists) and all(x[0][0] is lists[0][0][0] and x[0][1:] == lists[0][0][1:] for x in lists):
            yield from applied(*lists[0][0])
            for x in lists:
                x.pop(0)

    def close(self) -> Iterator[tuple[str, str, str]]:
        yield from self.close_block(last=True)

    def summary(self) -> dict[str, int | str]:
        (way,) = self.ways.values()
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, 2**63 - 1)
        return {"gaps": gaps, **self.counts, "cost": way.cost, "audit": way.edits}


SUMMARY = T.StructType(
    [*[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType())]
)
EDITS = [("step", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("summary", SUMMARY)]


def arrow_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def faults(rows: DataFrame, key: str, gone: str | None = None) -> DataFrame:
    """(key, gone, turn, role, text, fault): the first fault of every row, if any. Nulls of role and text are one space."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    gone_now = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    own = rows.select(F.col(key).alias("key"), gone_now.alias("gone"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # One shuffle: rows equal in role and text lie in the partition of their conversation.
    same = W.partitionBy("key", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    numbered = own.repartition("key").withColumn("_nth", F.row_number().over(same)).withColumn("_last", last)
    fault = (
        F.when(F.col("_last") == "", "blank")
        .when(F.col("_nth") > 1, "duplicate")
        .when(~F.contains(F.lit(END_MARKS), F.col("_last")), "truncated")
    )
    return numbered.withColumn("fault", fault).drop("_nth", "_last")


def repair(rows: DataFrame, key: str = "conv_id", gone: str | None = None) -> DataFrame:
    """The edits that repair each conversation, (key, step, edit, role, text, summary), in order.

    ``rows`` have the key, turn, role and text; they are taken by turn, nulls first, and by role and text where turns are
    equal. Repaired conversations are the rows with an edit other than D. A last row per conversation, without an edit, has
    a summary: gaps between the turns, the rows by their first fault, neighbours that may not follow each other, the cost and
    the edits as one string. Rows that ``gone`` marks only make their conversation known; one without rows has a summary of
    zeros. Null keys are one conversation; null roles and texts are one space; an empty table gives no rows; other columns
    are not read. A role counts by its first character, an empty or unknown one is never due.

    A conversation is a sequence, so one task reads its rows as a stream; it holds a block of them and those blocks on which
    the ways still differ, however long the conversation is.
    """
    ordered = faults(rows, key, gone).sortWithinPartitions(F.asc_nulls_first("key"), F.asc_nulls_first("turn"), "role", "text")
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *[T.StructField(*f) for f in EDITS]])
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[dict]:
            now, open_key, step = None, None, 0

            def numbered(found: Iterable[tuple[str, str, str]]) -> Iterator[dict]:
                nonlocal step
                for edit, role, text in found:
                    step += 1
                    yield {key: open_key, "step": step, "edit": edit, "role": role, "text": text}

            def closing() -> Iterator[dict]:
                yield from numbered(now.close())
                yield {key: open_key, "step": step + 1, "summary": now.summary()}

            for batch in batches:
                for part in remade([batch], 1024):
                    for k, is_gone, turn, role, text, fault in zip(*[c.to_pylist() for c in part.columns]):
                        if now is None or k != open_key:
                            if now is not None:
                                yield from closing()
                            now, open_key, step = Repair(), k, 0
                        if not is_gone:
                            yield from numbered(now.add(turn, Row(role, text, fault)))
            if now is not None:
                yield from closing()

        out, size = [], 0
        for row in edits():
            out.append(row)
            size += len(row.get("text") or "")
            if len(out) >= 1024 or size >= BLOCK_CHARACTERS:
                yield arrow_rows(out, arrow)
                out, size = [], 0
        if out:
            yield arrow_rows(out, arrow)

    return ordered.mapInArrow(run, schema)


def digests(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation out of ``repair``: the fields of its summary and the SHA-256 of the repaired turns, as
    ``role:text`` joined by line feeds. The edits must lie as ``repair`` gives them; they are hashed as they pass."""
    schema = T.StructType([T.StructField(key, edits.schema[key].dataType), *SUMMARY.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, started = sha256(), False
        for batch in batches:
            out = []
            for k, _, edit, role, text, summary in zip(*[c.to_pylist() for c in batch.columns]):
                if summary is not None:
                    out.append({key: k, **summary, "repaired_sha256": digest.hexdigest()})
                    digest, started = sha256(), False
                elif edit != "D":
                    digest.update((("\n" if started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    started = True
            yield arrow_rows(out, arrow)

    return edits.select(key, *[n for n, _ in EDITS]).mapInArrow(run, schema)


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Damage by the crc32 of ``key:turn`` (a null is one space there, as it is in role and text), mod 20: 0 drops a row (it
    stays here, marked as gone), 1 empties its text, 2 takes its end marks away, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(key), F.lit(":"), part("turn")).cast("binary")) % 20
    marked = rows.select(key, "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", END_MARKS, "")).otherwise(F.col("text"))
    copies: Column = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select(
        key,
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_kind") == 0).alias("gone"),
        copies.alias("_copy"),
    ).drop("_copy")


def repair_damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every conversation of ``rows`` after damage, with the counts, the cost and the edits of its repair and the hash of the
    repaired turns. One without rows after damage has zeros, no edits and the hash of nothing."""
    return digests(repair(damaged(rows, key), key, "gone"), key)
