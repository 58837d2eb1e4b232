"""Near-duplicate classes by DartMinHash signatures, a banded join, exact checks and connected components.

A document is the set of its shingles of five words (A-Z in lower case), or with ``weighted`` the multiset. Darts are
points of a Poisson process over (weight, rank) that every document sees alike: each element's plane is cut into
strips of dyadic width, and within a strip darts arrive by rank. A document owns the darts below its weights; each dart
falls on one of k coordinates, and a coordinate keeps its earliest dart. Two documents agree on a coordinate with
probability equal to their (weighted) Jaccard similarity. About k log k + 2k darts are looked at, whatever the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import placed, release, remade, replaced, word_bytes
from gleaner.operators.skew import join_leaders
from gleaner.session import durable, scratch

SHINGLE = 5
THRESHOLD = 0.8
#: 25 bands of 4: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 25 < 2e-6.
BANDS = 25
ROWS = 4
#: Nodes of one bucket that meet in one place at a time.
BLOCK = 4000
#: Nodes of a family, outside its largest group and in all, whose texts meet in one place at a time.
FEW_BLOCK = 250
ALL_BLOCK = 500
#: Nodes up to this number (8 MB of ids) are broadcast to pick their texts.
MAX_BROADCAST_NODES = 1_000_000
#: Edges that one task contracts at a time, and neighbours of a node beyond which its edges are dealt over several tasks.
CONTRACT_EDGES = 500_000
HUB = 1000
RESULT = ("class_id", "class_size", "stays")

M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
POSITION_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(16)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text, ascending, and how often each occurs. A text of fewer words than ``size``
    is one shingle; a text without words has none."""
    words = word_bytes(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += mixed(h[k : n - width + 1 + k] * np.uint64(POSITION_MULTIPLIERS[k]))
    return np.unique(mixed(total), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates, as 64-bit dart ids. Weights are positive."""
    reach = (k * math.log(k) + 2 * k) / float(weights.sum())
    top = float(weights.max())
    while True:
        ranks, coordinates, darts = [], [], []
        strip, low = 0, 0.0
        while low < top:
            width = float(1 << strip)
            own = weights > low
            seed = mixed(elements[own] + np.full(1, strip + 1, np.uint64) * GOLDEN)
            limit, rank = weights[own] - low, np.zeros(len(seed))
            number, block = 0, max(1, math.ceil(reach * width))
            while len(seed):
                steps = np.arange(number + 1, number + block + 1, dtype=np.uint64) * GOLDEN
                dart = mixed(seed[:, None] + steps)
                arrival = rank[:, None] + np.cumsum(-np.log(unit(mixed(dart + M1))), axis=1) / width
                hit = arrival <= reach
                hit &= unit(mixed(dart + M2)) * width <= limit[:, None] if width > 1 or limit.min() < 1 else True
                ranks.append(arrival[hit])
                darts.append(dart[hit])
                alive = arrival[:, -1] <= reach
                seed, limit, rank = seed[alive], limit[alive], arrival[alive, -1]
                number += block
            low, strip = low + width, strip + 1
        rank, dart = np.concatenate(ranks), np.concatenate(darts)
        coordinate = (mixed(dart) % np.uint64(k)).astype(np.int64)
        latest_first = np.argsort(-rank, kind="stable")
        kept = np.zeros(k, np.uint64)
        filled = np.zeros(k, bool)
        kept[coordinate[latest_first]] = dart[latest_first]
        filled[coordinate] = True
        if filled.all():
            return kept
        reach *= 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = mixed(sig.reshape(bands, rows) + np.arange(rows, dtype=np.uint64) * GOLDEN)
    total = parts[:, 0]
    for r in range(1, rows):
        total = mixed(total * M1 + parts[:, r])
    return mixed(total + np.arange(1, bands + 1, dtype=np.uint64) * M2).view(np.int64)


def signed(rows: DataFrame, weighted: bool = False, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(node, text) to (node, mass, sketch, bands): total weight, one byte of each coordinate, and the band keys of each text
    with a word."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in remade(batches, 512):
            found = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements, counts = shingles(text)
                if len(elements):
                    weights = counts.astype(np.float64) if weighted else np.ones(len(elements))
                    sig = signature(elements, weights, bands * per_band)
                    found.append((node, int(weights.sum()), sig.astype(np.uint8).tobytes(), band_keys(sig, bands, per_band)))
            if found:
                node, mass, sketch, keys = zip(*found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(keys) + 1, bands, dtype=np.int32)), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(mass, pa.int64()), pa.array(sketch, pa.binary()), lists], names=["node", "mass", "sketch", "bands"]
                )

    return rows.select("node", "text").mapInArrow(sign, "node long, mass long, sketch binary, bands array<long>")


def likely(sides: DataFrame, threshold: float, least: int) -> DataFrame:
    """Pairs (a, b) of a node asked and a node of the same bucket and another group that may reach the threshold: their
    masses allow it and their sketches agree in at least ``least`` bytes.

    ``sides`` has band, few, node, root, mass, sketch: rows of a bucket that ask (few) and rows that are asked. Both are cut
    into blocks of bounded size; each block that asks meets each block that is asked, sorted next to it in one partition.
    Pairs are compared as bytes and only likely ones leave the task.
    """
    counts = sides.groupBy("band", "few").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    blocks = counts.groupBy("band").agg(F.max(F.when(F.col("few"), F.col("n"))).alias("n_few"), F.max(F.when(~F.col("few"), F.col("n"))).alias("n_all"))
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = sides.join(blocks.where("n_few is not null and n_all is not null"), "band")
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("few"), own("n_few")).otherwise(every("n_few"))))
    dealt = dealt.withColumn("y", F.explode(F.when(F.col("few"), every("n_all")).otherwise(own("n_all"))))
    key = ["band", "x", "y"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, F.desc("few")).select(*key, "few", "node", "root", "mass", "sketch")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asking = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            sketches = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = np.stack([c.astype(np.int64) for c in (*columns[:3], columns[3])])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
            out = []
            for at, to in zip(edges[:-1], edges[1:]):
                part = (columns[4][at:to], columns[5][at:to], columns[6][at:to], sketches[at:to])
                bucket = tuple(keys[:3, at])
                if keys[3, at]:
                    asking = tuple(np.concatenate([a, b]) for a, b in zip(asking, part)) if bucket == last and asking else part
                    last = bucket
                elif bucket == last:
                    for start in range(0, to - at, 256):
                        asked = [c[start : start + 256] for c in part]
                        low, high = np.minimum(asking[2][:, None], asked[2]), np.maximum(asking[2][:, None], asked[2])
                        i, j = np.nonzero((asking[1][:, None] != asked[1]) & (low >= threshold * high))
                        for cut in range(0, len(i), 100_000):
                            x, y = i[cut : cut + 100_000], j[cut : cut + 100_000]
                            good = (asking[3][x] == asked[3][y]).sum(1) >= least
                            out.append((asking[0][x[good]], asked[0][y[good]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def texts_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) once for each of the nodes. ``rows`` may repeat a node; copies are merged in the map tasks, so a text that
    many rows share is shuffled once per task. Few nodes (counted) pick their rows by a broadcast, more by a join."""
    nodes = durable(nodes.distinct())
    wanted = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_NODES else nodes
    return rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, rows: DataFrame, threshold: float, weighted: bool = False) -> DataFrame:
    """Those of the pairs (a, b) whose texts have at least the similarity, computed exactly. Texts of the pairs are shuffled
    once, for both sides."""
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), rows)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(node: int, text: pa.StringScalar) -> tuple[np.ndarray, np.ndarray]:
            if node not in met:
                if len(met) >= 1000:
                    met.clear()
                met[node] = shingles(text.as_py())
            return met[node]

        for batch in remade(batches, 256):
            good = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                good.append(similarity(of(a, text_a), of(b, text_b), weighted) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(compare, "a long, b long")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], weighted: bool = False) -> float:
    """Jaccard similarity of two shingle sets, or of the multisets."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if weighted:
        common, total = int(np.minimum(x[1][i], y[1][j]).sum()), int(x[1].sum() + y[1].sum())
    else:
        common, total = len(i), len(x[0]) + len(y[0])
    return common / (total - common) if total else 0.0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) that join what the edges (a, b) join. Each turn hooks every root that has a
    smaller neighbour below it, so at least half of the open roots go."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def contracted(pairs: DataFrame) -> DataFrame:
    """Written pairs (u, v) as stars that join the same nodes: every task contracts the edges it reads, in bounded chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CONTRACT_EDGES:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    tasks = max(1, math.ceil(pairs.count() / CONTRACT_EDGES))
    return durable(pairs.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node reachable. Tasks contract the edges they hold to
    stars; then the large-star and the small-star step join what tasks hold apart, until nothing changes. Each result is a
    written table and the edges of a hub are dealt over tasks; the driver sees counts."""
    with scratch(edges.sparkSession) as cuts:
        pairs = contracted(durable(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u != v").distinct()))
        while True:
            role = lambda c, is_u: pairs.select(F.col(c).alias("n"), F.lit(is_u).alias("is_u"))  # noqa: E731, B023
            nodes = role("u", 1).unionByName(role("v", 0)).groupBy("n").agg(F.sum("is_u").alias("out"), F.count_if(F.col("is_u") == 0).alias("in"))
            # Done once every edge leads from a node with no other edge to a root.
            if nodes.where("out > 1 or (out > 0 and in > 0)").isEmpty():
                break
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count(F.lit(1)).alias("n"))
            large = join_leaders(both, least, ["u"], "n", ["v"], HUB).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            large = durable(large.distinct())
            # Nodes have few smaller neighbours by now, but for as many roots as a node may join.
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
            small = join_leaders(large, least, ["u"], "n", ["v"], HUB).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            joined = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            earlier = pairs
            pairs = contracted(durable(joined.where("u != v").distinct()))
            release(earlier)
            release(large)
        roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
        return cuts.keep(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))


def links(rows: DataFrame, threshold: float = THRESHOLD, weighted: bool = False, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """Verified links (a, b) between different texts (node, text; nodes may repeat) that suffice for the classes.

    First the nodes of a bucket meet two pivots, not each other: the node with the most neighbours over all buckets, which is
    near the middle of its group, and one by hash. Nodes linked by then count as one group, and buckets of one group are
    done. In the others all nodes outside the bucket's largest group meet every node of another group. No bucket is
    capped. A pair is left unverified only if its sketches differ so much that a similarity at the threshold would show
    them so with a probability below 1e-8, far below that of never sharing a band.
    """
    least = least_agreement(threshold, bands * per_band)
    table = durable(signed(rows, weighted, bands, per_band).dropDuplicates(["node"]))
    shared = table.select("node", F.explode("bands").alias("band"))
    sizes = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = durable(shared.join(sizes, "band"))
    degrees = grouped.groupBy("node").agg(F.sum("n").alias("degree"))
    known = table.select("node", "mass", "sketch").join(degrees, "node")
    open_rows = durable(grouped.drop("n").join(known, "node").withColumn("root", F.col("node")))
    release(grouped)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Each pair once, with the side that more pairs share in second place."""
        shares = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("b").alias("b"))
        once = durable(shares.select(F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("a"), "b"))
        new = durable(verified(once, rows, threshold, weighted))
        release(once)
        return new

    side = ["band", "node", "root", "mass", "sketch"]
    whole = F.struct(*side[1:])
    pivots = open_rows.groupBy("band").agg(F.array(F.max_by(whole, F.struct("degree", "node")), F.min_by(whole, F.xxhash64("node"))).alias("p"))
    asking = pivots.select("band", F.explode(F.array_distinct("p")).alias("p")).select("band", "p.*", F.lit(True).alias("few"))
    found = confirmed(likely(asking.unionByName(open_rows.select(*side, F.lit(False).alias("few"))), threshold, least))

    roots = components(found)
    joined = durable(open_rows.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed_bands = joined.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first")).where("low != high")
    unsettled = durable(joined.join(mixed_bands.select("band", "first"), "band").select("node", "root", "first"))
    families = components(unsettled.select(F.col("node").alias("a"), F.col("first").alias("b")))
    members = unsettled.select("node", "root").distinct().join(families.withColumnRenamed("root", "family"), "node").join(table.select("node", "mass", "sketch"), "node")
    more = durable(settled(durable(members), rows, threshold, least, weighted))
    for cut in (table, open_rows, roots, joined, unsettled, families):
        release(cut)
    return found.unionByName(more)


def settled(members: DataFrame, rows: DataFrame, threshold: float, least: int, weighted: bool = False) -> DataFrame:
    """Links between the groups of each family, found exactly.

    ``members`` has node, root (its group), family, mass and sketch. In a family every node outside its largest group meets
    every node of another group. Both sides are cut into blocks of bounded size with the texts of their nodes; a pair
    whose sketches agree in ``least`` bytes is compared shingle by shingle where it meets. Of the pairs that are linked only
    those leave the task that join two groups not yet joined there, so no family gives more links than nodes per block.
    """
    by_root = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("family").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    sizes = main.select(
        "family",
        F.col("m.root").alias("main"),
        F.greatest(F.ceil((F.col("n") - F.col("m.n")) / FEW_BLOCK), F.lit(1)).cast("int").alias("n_x"),
        F.ceil(F.col("n") / ALL_BLOCK).cast("int").alias("n_y"),
    )
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = members.join(sizes, "family")
    few = sized.where("root != main").withColumn("x", block("n_x")).withColumn("y", every("n_y")).withColumn("few", F.lit(True))
    whole = sized.withColumn("y", block("n_y")).withColumn("x", every("n_x")).withColumn("few", F.lit(False))
    texts = texts_of(members.select("node"), rows)
    columns = ["family", "x", "y", "few", "node", "root", "mass", "sketch"]
    dealt = few.select(*columns).unionByName(whole.select(*columns)).join(texts, "node")

    def compare(group: pa.Table) -> pa.Table:
        flags = group.column("few").to_numpy(zero_copy_only=False)
        node, root, mass = (group.column(c).to_numpy() for c in ("node", "root", "mass"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        text, sets = group.column("text"), {}
        joined: dict[int, int] = {}

        def group_of(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = shingles(text[i].as_py())
            return sets[i]

        asked, out = np.flatnonzero(~flags), []
        for i in np.flatnonzero(flags).tolist():
            fits = np.minimum(mass[i], mass[asked]) >= threshold * np.maximum(mass[i], mass[asked])
            near = asked[fits & (root[asked] != root[i])]
            agree = (sketch[near] == sketch[i]).sum(1)
            order = np.argsort(-agree, kind="stable")
            for j in near[order[agree[order] >= least]].tolist():
                a, b = group_of(int(root[i])), group_of(int(root[j]))
                if a != b and similarity(of(i), of(j), weighted) >= threshold:
                    joined[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[j])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "x", "y").applyInArrow(compare, "a long, b long")


def least_agreement(threshold: float, k: int) -> int:
    """The largest number that k coordinates agreeing with probability ``threshold`` stay below with probability < 1e-8."""
    total = 0.0
    for n in range(k + 1):
        total += math.comb(k, n) * threshold**n * (1 - threshold) ** (k - n)
        if total >= 1e-8:
            return n
    return k


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """The documents with class_id, class_size and stays.

    A class is a connected component of documents with equal texts or of at least the similarity; class_id is its
    smallest doc_id (null if all are null). ``stays`` marks one row per class: the smallest doc_id, nulls last, ties by
    row. Null text counts as empty; texts without a word are alike only if equal. Texts are told apart by 128 bits.
    Repeated rows fall into one class; an empty table stays empty; input columns named like a result are replaced.
    """
    keyed, row = placed(docs)
    classed = classes(keyed.select("doc_id", "text", F.col(row).alias("row")), threshold, weighted)
    found = classed.select(F.col("row").alias(row), *[F.col(c).alias(f"{row}_{c}") for c in RESULT])
    joined = keyed.join(found.hint("shuffle_hash"), row)
    return replaced(joined, {c: F.col(f"{row}_{c}") for c in RESULT}).drop(row, *[f"{row}_{c}" for c in RESULT])


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """The same without the other columns: doc_id, row, class_id, class_size, stays. ``row`` is the column of that name
    in ``docs``, or else a number given here."""
    text = F.coalesce("text", F.lit(""))
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    with scratch(docs.sparkSession) as cuts:
        identity = [F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("other")]
        narrow = durable(docs.select("doc_id", *identity, row.alias("row")))
        rows = docs.select(*identity, text.alias("text"))
        # A node is the hash of a text. Where two texts share it, a second hash parts them.
        clashes = durable(narrow.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high").select("node"))
        if not clashes.isEmpty():
            shared = clashes.withColumn("shared", F.lit(True))
            apart = F.when(F.col("shared"), F.xxhash64("node", "other")).otherwise(F.col("node"))
            narrow = narrow.join(shared, "node", "left").withColumn("node", apart).drop("shared")
            rows = rows.join(shared, "node", "left").withColumn("node", apart).drop("shared")
        found = links(rows.select("node", "text"), threshold, weighted)
        roots = components(found)
        classed = cuts.keep(narrow.join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = classed.groupBy("root").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return classed.join(heads, "root").select(
        "doc_id", "row", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("head.row") == F.col("row")).alias("stays")
    )
