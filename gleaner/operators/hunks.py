"""Line diffs as hunks: a patience diff of the two texts of every pair.

One shuffle by name brings the two sides of a pair together, as one row; tasks work on Arrow batches of such rows, with lines
as numbers. A round matches equal lines at the two ends of every block, then the lines that occur once on either side, as far
as they keep their order (a longest increasing run of places), and cuts the blocks at what it has matched. Rounds end when
nothing new is matched. Lines between matched ones are the hunks. A block lies within one file, which is one text value, so no
row outgrows the two values.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.frames import pinned
from gleaner.operators.compare import pair_status

PAIR = ["name", "left_collection", "right_collection"]
LEFT, RIGHT = 0, 1


def increasing_run(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of distinct numbers."""
    ends: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        pile = bisect_left(ends, place)
        before.append(tops[pile - 1] if pile else -1)
        ends[pile:pile + 1] = [place]
        tops[pile:pile + 1] = [i]
    run, i = [], tops[-1] if tops else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


#: A line of one side: (place, code of its text); of a block, the lines of both sides.
Line = tuple[int, int]
Block = tuple[list[Line], list[Line]]


def _sides(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, texts) with the texts of both sides of every different pair."""
    different = pair_status(pairs).filter("status = 'different'").select(*PAIR)
    met = different.join(files.select("name", "collection", "content").filter("content IS NOT NULL"), "name")
    is_left, is_right = F.col("collection") == F.col(PAIR[1]), F.col("collection") == F.col(PAIR[2])
    text = F.struct(F.when(is_left, F.lit(LEFT)).otherwise(F.lit(RIGHT)).alias("side"), "content")
    # Rows lie by name already, so this groups where they are.
    return met.filter(is_left | is_right).groupBy(*PAIR).agg(F.collect_list(text).alias("texts"))


def _equal_ends(block: Block, backwards: bool) -> list[tuple[int, int]]:
    """Places of equal lines from one end of a block on."""
    left, right = (side[::-1] if backwards else side for side in block)
    found = []
    for (place, a), (partner, b) in zip(left, right):
        if a != b:
            break
        found.append((place, partner))
    return found


def _unique_lines(block: Block) -> list[tuple[int, int]]:
    """Places of lines that occur once on both sides of a block, the most that keep their order."""
    left, right = block
    seen, there = Counter(a for _, a in left), Counter(b for _, b in right)
    partners = {b: partner for partner, b in right if there[b] == 1}
    once = [(place, partners[a]) for place, a in left if seen[a] == 1 and a in partners]
    return [once[i] for i in increasing_run([partner for _, partner in once])]


def _cut(blocks: list[Block], found: list[list[tuple[int, int]]]) -> list[Block]:
    """The blocks that are left: lines with the same number of matched ones before them on their own side."""
    left, steps = [], [0, 0]
    for block, pairs in zip(blocks, found, strict=True):
        cut: dict[int, Block] = defaultdict(lambda: ([], []))
        for side, lines in enumerate(block):
            marks = Counter(pair[side] for pair in pairs)
            for line in lines:
                if marks[line[0]]:
                    steps[side] += marks[line[0]]
                else:
                    cut[steps[side]][side].append(line)
        left += [cut[step] for step in sorted(cut)]
    # Lines of one side alone meet nothing.
    return [block for block in left if block[LEFT] and block[RIGHT]]


def matched_places(left: list[Line], right: list[Line]) -> list[tuple[int, int]]:
    """(place, partner) of the lines that stay; both sides are in the order of their places."""
    ways = (lambda b: _equal_ends(b, False), lambda b: _equal_ends(b, True), _unique_lines)
    blocks, matched, before = [(left, right)], [], -1
    while len(matched) > before:
        before = len(matched)
        for way in ways:
            found = [way(block) for block in blocks]
            if any(found):
                matched += [pair for pairs in found for pair in pairs]
                blocks = _cut(blocks, found)
    return matched


def _runs(lines: tuple[list[Line], list[Line]], matched: list[tuple[int, int]]) -> list[tuple[int, list[int], int, list[int]]]:
    """(left_start, places in the left lines, right_start, places in the right lines) of every hunk, in order."""
    changed: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, of_side in enumerate(lines):
        marks = Counter(pair[side] for pair in matched)
        kept = 0
        for i, (place, _) in enumerate(of_side):
            if marks[place]:
                kept += marks[place]
            else:
                changed[kept][side].append(i)
    runs, earlier = [], [0, 0]
    for kept in sorted(changed):
        # Without lines of its own a side starts behind the lines kept and those changed in the hunks before.
        starts = [lines[s][run[0]][0] if run else kept + earlier[s] + 1 for s, run in enumerate(changed[kept])]
        runs.append((starts[LEFT], changed[kept][LEFT], starts[RIGHT], changed[kept][RIGHT]))
        earlier = [n + len(run) for n, run in zip(earlier, changed[kept], strict=True)]
    return runs


def _hunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hunks of a batch of pairs. Equal lines of the batch have equal codes; no line becomes a Python object."""
    for batch in batches:
        texts = batch.column("texts")
        flat = texts.flatten()
        split = pc.split_pattern(pc.struct_field(flat, "content"), "\n")
        lines, sides = split.flatten(), pc.struct_field(flat, "side").to_pylist()
        codes = lines.dictionary_encode().indices.to_numpy()
        lengths = pc.list_value_length(split).to_numpy()
        ends = np.cumsum(lengths)
        row, hunk, starts, taken, sizes = [], [], ([], []), ([], []), ([0], [0])
        text = 0
        for i, n_texts in enumerate(pc.list_value_length(texts).to_pylist()):
            # A name that comes twice in a collection has each of its lines twice.
            of_side: tuple[list, list] = ([], [])
            for t in range(text, text + n_texts):
                first = int(ends[t] - lengths[t])
                of_side[sides[t]].extend(zip(range(1, int(lengths[t]) + 1), codes[first:ends[t]].tolist(), range(first, int(ends[t]))))
            text += n_texts
            for one in of_side:
                one.sort(key=lambda line: line[0])
            both = tuple([line[:2] for line in one] for one in of_side)
            for number, run in enumerate(_runs(both, matched_places(*both)), 1):
                row.append(i)
                hunk.append(number)
                for s in (LEFT, RIGHT):
                    starts[s].append(run[2 * s])
                    taken[s].extend(of_side[s][place][2] for place in run[2 * s + 1])
                    sizes[s].append(len(taken[s]))
        number = lambda values: pa.array(values, pa.int32())
        pairs = [batch.column(c).take(pa.array(row, pa.int64())) for c in PAIR]
        changed = [pa.ListArray.from_arrays(number(sizes[s]), lines.take(pa.array(taken[s], pa.int64()))) for s in (LEFT, RIGHT)]
        columns = [*pairs, number(hunk), number(starts[LEFT]), changed[LEFT], number(starts[RIGHT]), changed[RIGHT]]
        yield pa.RecordBatch.from_arrays(columns, names=[*PAIR, "hunk", "left_start", "removed", "right_start", "added"])


def hunks(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, hunk, left_start, removed, right_start, added) for every different pair.

    ``removed`` are the lines from ``left_start`` on that the right side does not have, ``added`` those from ``right_start``
    on that it has instead; either may be empty, and a start is then the place of the line behind. Lines end at line feeds,
    so a text has one line more than it has line feeds. Pairs that are equal or lack a side have no rows.
    """
    sides = _sides(files, pairs)
    lines = T.ArrayType(T.StringType())
    fields = {"hunk": T.IntegerType(), "left_start": T.IntegerType(), "removed": lines, "right_start": T.IntegerType(), "added": lines}
    schema = [sides.schema[c] for c in PAIR] + [T.StructField(name, kind) for name, kind in fields.items()]
    return sides.mapInArrow(_hunk_batches, T.StructType(schema))


def apply_hunks(files: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, patched): the left side of every pair that has hunks, with its removed lines replaced by the added ones.
    Only the left sides need be among ``files``."""
    changes = found.groupBy(*PAIR).agg(F.collect_list(F.struct("left_start", F.size("removed").alias("n"), "added")).alias("hunks"))
    left = files.groupBy("name", F.col("collection").alias("left_collection")).agg(F.collect_list("content").alias("texts"))
    met = changes.join(left, ["name", "left_collection"], "left")
    gone = F.flatten(F.transform(F.filter("hunks", lambda h: h["n"] > 0), lambda h: F.sequence(h["left_start"], h["left_start"] + h["n"] - 1)))
    texts = F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.split(t, "\n"))
    met = pinned(met, {"gone": gone, "lines": texts})
    entry = lambda place, after, n, line: F.struct(
        place.alias("place"), F.lit(after).alias("after"), n.alias("n"), line.alias("line")
    )
    stays = lambda lines: F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone")), lambda p: entry(p, 1, F.lit(0), F.get(lines, p - 1))
    )
    # Added lines come before the line that they push back.
    new = lambda h: F.transform(h["added"], lambda line, n: entry(h["left_start"], 0, n, line))
    ordered = F.array_sort(F.concat(F.flatten(F.transform("lines", stays)), F.flatten(F.transform("hunks", new))))
    # A text whose lines are all gone is empty.
    return met.select(*PAIR, F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("patched"))


def unified() -> Column:
    """A hunk as text: its places, then removed lines with a minus and added ones with a plus."""
    head = F.format_string("@@ -%d,%d +%d,%d @@", "left_start", F.size("removed"), "right_start", F.size("added"))
    signed = F.concat(F.transform("removed", lambda x: F.concat(F.lit("-"), x)), F.transform("added", lambda x: F.concat(F.lit("+"), x)))
    return F.array_join(F.concat(F.array(head), signed), "\n")
