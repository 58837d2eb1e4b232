"""Packing documents into sequences of a fixed number of tokens by bin completion.

Documents are tokenised where they lie; what moves is one narrow row per piece. Pieces of one length are
interchangeable, so the packing problem is the histogram of lengths, at most ``capacity`` numbers whatever the input.
It is solved once on the driver and gives a bounded list of fillings; every piece then finds its place by its rank among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import by_bytes, memo_tokenizer, small_batches
from gleaner.operators.skew import number_rows
from gleaner.session import durable

CAPACITY = 1024
END_ID = 2
#: Stretches of text that a worker remembers the ids of, in each of two generations (about 100 MB).
MEMO_ENTRIES = 450_000
#: Nodes of the branch-and-bound before the best filling plan found so far is taken, and fillings tried at a node, least
#: waste first. None for both makes the search exact.
MAX_NODES = 4000
MAX_BRANCHES = 8

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
Plan = list[tuple[int, Filling]]  # (times, filling)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello-Toth L2 bound: for each threshold k, items over capacity - k stand alone, those over a half take a bin
    each, and items from k up must fit into what the latter leave."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    number = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    many, load = upto(number), upto(number * sizes)
    k = np.concatenate([[0], sizes[2 * sizes <= capacity]])
    low, middle, high = np.searchsorted(sizes, k), np.searchsorted(2 * sizes, capacity, "right"), np.searchsorted(sizes, capacity - k, "right")
    high = np.maximum(high, middle)
    room = capacity * (many[high] - many[middle]) - (load[high] - load[middle])
    more = -((room - (load[middle] - load[low])) // capacity)
    return int(max(-(-load[-1] // capacity), (many[-1] - many[middle] + np.maximum(0, more)).max()))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: bins with equal contents are one entry with a multiplicity."""
    open_bins: dict[int, dict[Filling, int]] = {}

    def put(room: int, filling: Filling, times: int) -> None:
        group = open_bins.setdefault(room, {})
        group[filling] = group.get(filling, 0) + times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                put(capacity - each * size, ((size, each),), left // each)
                left %= each
                continue
            filling, times = open_bins[room].popitem()
            if not open_bins[room]:
                del open_bins[room]
            each = max(1, min(room // size, left // times))
            used = min(times, left // each)
            if used < times:
                put(room, filling, times - used)
            put(room - each * size, (*filling, (size, each)), used)
            left -= each * used
    plan = [(times, filling) for group in open_bins.values() for filling, times in group.items()]
    return sorted(plan, key=lambda x: (x[1], x[0]), reverse=True)


def completions(counts: dict[int, int], first: int, capacity: int, limit: int | None = MAX_BRANCHES, most_waste: int | None = None) -> list[Filling]:
    """The undominated fillings around the longest item ``first`` that waste at most ``most_waste``, least waste first and
    longer items first among equals; at most ``limit`` of them.

    Which totals the shorter lengths reach is worked out first, as bits, so the search for fillings of a total has no dead
    ends. A filling is dominated if an unused length x could take the place of some of its items with sum(items) <= x <=
    sum(items) + waste: the freed items are then easier to place than x.
    """
    room = capacity - first
    have = {s: n - (s == first) for s, n in counts.items() if s <= room}
    sizes = [s for s in sorted(have, reverse=True) if have[s]]
    reach, bits, whole = [1], 1, (1 << (room + 1)) - 1
    for s in reversed(sizes):
        left, step = min(have[s], room // s), 1
        while left:
            step = min(step, left)
            bits |= (bits << (s * step)) & whole
            left -= step
            step *= 2
        reach.append(bits)
    reach.reverse()  # reach[i]: totals of sizes[i:]

    def fillings(at: int, total: int) -> Iterator[Filling]:
        if not total:
            yield ()
            return
        for i in range(at, len(sizes)):
            if not reach[i] >> total & 1:
                return
            s = sizes[i]
            for each in range(min(have[s], total // s), 0, -1):
                if reach[i + 1] >> (total - each * s) & 1:
                    for rest in fillings(i + 1, total - each * s):
                        yield ((s, each), *rest)

    free = sum(1 << s for s in sizes)

    def dominated(filling: Filling, waste: int) -> bool:
        unused = free & ~sum(1 << s for s, n in filling if n == have[s])
        if unused & ((1 << (waste + 1)) - 1):
            return True  # one more fits
        sums = {(0, 0)}
        for s in [s for s, n in filling for _ in range(n)][:8]:
            sums |= {(a + s, min(n + 1, 2)) for a, n in sums}
        # Lengths from a sum (for one item: above it) to the sum and the waste.
        return any(n and unused >> (a + (n == 1)) & ((1 << (waste + (n > 1))) - 1) for a, n in sums)

    kept: list[Filling] = []
    tried = 0
    for waste in range(0, min(room, room if most_waste is None else most_waste) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for filling in fillings(0, room - waste):
            tried += 1
            if not dominated(filling, waste):
                used = dict(filling)
                kept.append(((first, used.pop(first, 0) + 1), *sorted(used.items(), reverse=True)))
                if len(kept) == limit:
                    return kept
            if limit and kept and tried >= 8 * limit:
                return kept
    return kept


def fill(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_branches: int | None = MAX_BRANCHES) -> Plan:
    """Fewest bins for a histogram of lengths: bin completion with best-fit solutions as incumbents.

    Branches on the undominated fillings around the longest item left, least waste first, each used as often as its
    contents allow and also once; a branch ends when its waste so far, added to the content, or the bound of what is left
    cannot beat the incumbent. Best fit completes the root, the nodes whose number is a power of two and those with few
    lengths left; a better total becomes the incumbent. The search stops at the lower bound, when nothing is left to
    try, or after ``max_nodes``; with both limits None the result is the least number.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(t for t, _ in best)
    content = sum(s * n for s, n in counts.items())
    nodes = 0
    # Plans are chains (times, filling, earlier), so that a node costs no copy of what leads to it.
    stack: list[tuple[dict[int, int], tuple | None, int, int]] = [(counts, None, 0, 0)]

    def chained(plan: tuple | None) -> Plan:
        out = []
        while plan:
            out.append(plan[:2])
            plan = plan[2]
        return out

    while stack and best_bins > bound and (max_nodes is None or nodes < max_nodes):
        left, plan, bins, waste = stack.pop()
        if not left:
            if bins < best_bins:
                best, best_bins = chained(plan), bins
            continue
        slack = (best_bins - 1) * capacity - content - waste
        if slack < 0 or bins + lower_bound(left, capacity) >= best_bins:
            continue
        nodes += 1
        if nodes & (nodes - 1) == 0 or len(left) <= 16:
            rest = best_fit(left, capacity)
            total = bins + sum(t for t, _ in rest)
            if total < best_bins:
                best, best_bins = chained(plan) + rest, total
                slack = (best_bins - 1) * capacity - content - waste
                if slack < 0:
                    continue
        branches = []
        for filling in completions(left, max(left), capacity, max_branches, slack):
            most = min(left[s] // n for s, n in filling)
            for times in dict.fromkeys((most, 1)):
                after = dict(left)
                for s, n in filling:
                    after[s] -= n * times
                    if not after[s]:
                        del after[s]
                lost = (capacity - sum(s * n for s, n in filling)) * times
                branches.append((after, (times, filling, plan), bins + times, waste + lost))
        stack.extend(reversed(branches))
    merged: dict[Filling, int] = {}
    for times, filling in best:
        key = tuple(sorted(filling, reverse=True))
        merged[key] = merged.get(key, 0) + times
    return [(times, filling) for filling, times in sorted(merged.items(), reverse=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, special: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``capacity`` tokens are cut; their
    first piece takes the remainder. Null text is empty: a document of the end id alone."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = memo_tokenizer(tokenizer, MEMO_ENTRIES, special)
        for batch in by_bytes(batches, 1):
            flat, ends = coder.encode_column(batch.column(1), end_id)
            n = np.diff(ends, prepend=0)
            first = np.where(n <= capacity, n, (n - 1) % capacity + 1)
            number = 1 + (n - first) // capacity
            i = np.repeat(np.arange(len(n)), number)
            piece = np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number)
            at = np.where(piece == 0, 0, first[i] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[i], capacity)
            begin = 4 * ((ends - n)[i] + at)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, max_nodes: int | None = MAX_NODES, max_branches: int | None = MAX_BRANCHES, special: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset, in as few sequences of ``capacity`` tokens as found.

    ``docs`` needs doc_id and text; further columns are not read, whatever their names. Null or repeated ids are documents
    like others; ties among equal lengths go by doc_id, piece and start. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        cut = durable(pieces(docs, tokenizer, capacity, end_id, special))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan = fill(histogram, capacity, max_nodes, max_branches)

    # Slots: for each length in order, ranges of global rank that lie in one filling. At most one per length and filling.
    before, slots, base = {}, [], 0
    total = 0
    for size in sorted(histogram):
        before[size] = total
        total += histogram[size]
    for times, filling in plan:
        offset = 0
        for size, each in filling:
            slots.append((before[size], size, each, base, offset))
            before[size] += each * times
            offset += each * size
        base += times
    from_rank, sizes, each, first_bin, offsets = (np.array(x, dtype=np.int64) for x in zip(*sorted(slots))) if slots else [np.zeros(0, np.int64)] * 5

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False) - 1
            slot = np.searchsorted(from_rank, rank, side="right") - 1
            k = rank - from_rank[slot]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(first_bin[slot] + k // each[slot]), pa.array(offsets[slot] + (k % each[slot]) * sizes[slot])],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    ranked = number_rows(cut, [], ["length", "doc_id", "piece", "start", "ids_crc32"], "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
