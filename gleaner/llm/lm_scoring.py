"""Scoring texts with a causal self-attention model on subword ids, trained in numpy.

The model: token and place vectors, one causal attention head, a small feed-forward layer, and a two-level softmax (class,
then member) over the most frequent ids of the learning texts. Rarer ids are one common entry, whose probability is shared
among them by their counts over all learning texts, so every id has a probability and all sum to one. Training is data
parallel: in each round every task takes steps on its own share of windows and the results are averaged, weighted by
tokens. Scoring cuts a text into overlapping windows; each token is scored once, with at least ``window - stride`` tokens
before it where the text has them.

The base score is a word unigram whose counts come from all learning texts. Frequent words are looked up in a broadcast
table of bounded size, all others meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import by_bytes, memo_tokenizer, release, remade, small_batches
from gleaner.session import durable

WINDOW = 32
STRIDE = 24
WIDTH = 16
CLASSES = 32
MEMBERS = 32
#: Training steps use every window of the learning texts once, a part of them in each round. Inputs of fewer than
#: MIN_TOKENS tokens are gone over again, at most once in every round.
MIN_TOKENS = 2_000_000
ROUNDS = 4
BATCH = 64
#: Windows that a task holds, and takes its mini-batches from in random order, at a time.
HELD_WINDOWS = 8192
#: Bytes of freed memory that a worker keeps for its next arrays.
KEPT_BYTES = 16 << 20
#: Rows that a product of a long and a small matrix takes at a time.
PART = 512
RATE = 0.01
SEED = 5
#: Words in the broadcast table: the most frequent ones, at most so many.
HOT_WORDS = 100_000
#: Bytes of texts that a task encodes at a time, and of the batches in which rows come to Python.
CODED_BYTES = 1 << 20
BATCH_BYTES = "2m"
#: Distinct words that a task counts before it hands on what it has.
MAX_COUNTED = 150_000
END_WORD = b"\n"  # no word holds a line feed
ADD, FOLDS, HELD_OUT_FOLD = 0.1, 10, 0

Params = dict[str, np.ndarray]


def held_out(doc_id: str = "doc_id") -> Column:
    """A row without an id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


# --- the model -----------------------------------------------------------------------------------------------------


def shapes() -> dict[str, tuple[int, ...]]:
    d, v = WIDTH, CLASSES * MEMBERS
    return {
        "E": (v, d), "P": (WINDOW, d), "Wqkv": (d, 3 * d), "Wo": (d, d), "W1": (d, 2 * d), "b1": (2 * d,), "W2": (2 * d, d),
        "Uc": (CLASSES, d), "bc": (CLASSES,), "Um": (CLASSES, MEMBERS, d), "bm": (CLASSES, MEMBERS),
    }


def start(entry_counts: np.ndarray) -> Params:
    """Random vectors, and biases that make the untrained model the unigram of the entries."""
    rng = np.random.default_rng(SEED)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes().items()}
    for k in ("Wqkv", "Wo", "W1", "W2"):
        p[k] *= 10 / math.sqrt(p[k].shape[0])
    p["W2"] *= 0.3
    p["b1"][:] = 0
    share = (entry_counts + 0.5).reshape(CLASSES, MEMBERS)
    p["bc"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    p["bm"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return p


def by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of the cells by class, and each class that occurs with its place in it."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")  # 8 bits are sorted by counting
    edges = [0, *np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()]
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` for many rows, some at a time: small products are made without copies of the factors. ``w`` is best
    contiguous."""
    out = np.empty((len(x), w.shape[1]), x.dtype)
    whole = len(x) - len(x) % PART
    if whole:
        np.matmul(x[:whole].reshape(-1, PART, x.shape[1]), w, out=out[:whole].reshape(-1, PART, w.shape[1]))
    if whole < len(x):
        np.matmul(x[whole:], w, out=out[whole:])
    return out


def crossed(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """``x.T @ y`` for many rows into ``out``, likewise."""
    whole = len(x) - len(x) % PART
    np.matmul(x[whole:].T, y[whole:], out=out)
    if whole:
        parts = [z[:whole].reshape(-1, PART, z.shape[1]) for z in (x, y)]
        out += np.matmul(parts[0].transpose(0, 2, 1), parts[1]).sum(0)


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row, in place, up to a factor, and the rows' sums; the maximum is taken off only where needed, as it
    costs more than the rest."""
    if max(x.max(initial=0), -x.min(initial=0)) >= 80:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def log_sum(x: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each row; ``x`` is overwritten."""
    top = x.max(1) if max(x.max(initial=0), -x.min(initial=0)) >= 80 else None
    total = np.log(exponentials(x)[1])
    return total if top is None else total + top


def open_weights(q: np.ndarray, k: np.ndarray, open_cells: np.ndarray) -> np.ndarray:
    """Weights of masked attention, for queries that are scaled already, without the running maximum. Should the plain
    exponentials leave the range of floats, the slower way is taken."""
    s = np.matmul(q, k.transpose(0, 2, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(s, out=s)
        s *= open_cells
        total = s @ np.ones(s.shape[-1], s.dtype)
    if not np.isfinite(total).all() or total.min(initial=1) < 1e-30:
        s = np.where(open_cells > 0, np.matmul(q, k.transpose(0, 2, 1)), -1e9).astype(q.dtype)
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        total = s.sum(-1)
    s *= (1 / total)[..., None]
    return s


def scaled(p: Params) -> np.ndarray:
    weights = p["Wqkv"].copy()
    weights[:, :WIDTH] /= math.sqrt(WIDTH)
    return weights


def gradients(p: Params, inputs: np.ndarray, goals: np.ndarray, real: np.ndarray, g: Params | None = None) -> tuple[float, Params]:
    """Mean loss (nats a token) and gradients for windows of entries; ``real`` marks the goals that count. ``g`` takes the
    gradients, if given, and must be zero."""
    b, w, d = len(inputs), WINDOW, WIDTH
    kind = p["E"].dtype
    g = {name: np.zeros_like(value) for name, value in p.items()} if g is None else g
    ones = np.ones(b * w, kind)
    turned = lambda z: np.ascontiguousarray(z.T)
    weights = scaled(p)
    x = np.take(p["E"], inputs, axis=0)
    x += p["P"]
    x = x.reshape(-1, d)
    qkv = times(x, weights).reshape(b, w, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    a = open_weights(q, k, np.tri(w, dtype=kind))
    o = np.matmul(a, v).reshape(-1, d)
    h1 = times(o, p["Wo"])
    h1 += x
    r = times(h1, p["W1"])
    r += p["b1"]
    np.maximum(r, 0, out=r)
    h = times(r, p["W2"])
    h += h1
    # From here to ``dh`` the cells that count are in the order of their goals' classes.
    cell = np.flatnonzero(real)
    goal = goals.ravel()[cell]
    order, spans = by_class(goal // MEMBERS)
    cell, goal = cell[order], goal[order]
    flat = np.take(h, cell, axis=0)
    n = max(len(goal), 1)
    c, m = goal // MEMBERS, goal % MEMBERS
    first = np.arange(len(goal))
    lc = times(flat, turned(p["Uc"]))
    lc += p["bc"]
    lc, loss = errors(lc, first * CLASSES + c, n)
    crossed(lc, flat, g["Uc"])
    np.matmul(ones[: len(goal)], lc, out=g["bc"])
    df = times(lc, p["Uc"])
    lm = np.empty((len(goal), MEMBERS), kind)
    members = np.ascontiguousarray(p["Um"].transpose(0, 2, 1))
    for i, span in spans:
        np.dot(flat[span], members[i], out=lm[span])
    lm += np.take(p["bm"], c, axis=0)
    lm, more = errors(lm, first * MEMBERS + m, n)
    back = np.empty_like(flat)
    for i, span in spans:
        part = lm[span]
        if len(part) > PART:
            crossed(part, flat[span], g["Um"][i])
        else:
            np.dot(part.T, flat[span], out=g["Um"][i])
        np.dot(ones[: len(part)], part, out=g["bm"][i])
        np.dot(part, p["Um"][i], out=back[span])
    df += back
    dh = np.empty_like(h) if len(cell) == len(h) else np.zeros_like(h)
    dh[cell] = df
    crossed(r, dh, g["W2"])
    dz = times(dh, turned(p["W2"]))
    dz *= r > 0
    crossed(h1, dz, g["W1"])
    np.matmul(ones, dz, out=g["b1"])
    dh1 = times(dz, turned(p["W1"]))
    dh1 += dh
    crossed(o, dh1, g["Wo"])
    do = times(dh1, turned(p["Wo"]))
    # A row's sum of weights times their gradients is its value times the value's gradient.
    own = ((do * o) @ np.ones(d, kind)).reshape(b, w, 1)
    do = do.reshape(b, w, d)
    ds = np.matmul(do, v.transpose(0, 2, 1))
    ds -= own
    ds *= a
    dqkv = np.empty_like(qkv)
    np.matmul(ds, k, out=dqkv[..., :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), do, out=dqkv[..., 2 * d :])
    dqkv = dqkv.reshape(-1, 3 * d)
    crossed(x, dqkv, g["Wqkv"])
    g["Wqkv"][:, :d] /= math.sqrt(d)
    dx = times(dqkv, turned(weights))
    dx += dh1
    np.matmul(ones[:b], dx.reshape(b, w * d), out=g["P"].reshape(-1))
    numbers = np.arange(g["E"].size).reshape(-1, d)
    np.add.at(g["E"].reshape(-1), np.take(numbers, inputs.ravel(), axis=0).ravel(), dx.ravel())
    return (loss + more) / n, g


def errors(x: np.ndarray, goal: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """A n-th of the probabilities that scores give, less one at the goals (cells of the flat array), and the goals' loss."""
    x, total = exponentials(x)
    flat = x.reshape(-1)
    total = 1 / total
    found = np.take(flat, goal) * total
    total /= n
    x *= total[:, None]
    flat[goal] = (found - 1) / n
    found += 1e-20
    return x, -float(np.log(found).sum())


def keep_memory() -> None:
    """Have the C library keep freed memory of this process, as it does once an array of this size has been freed. Otherwise
    every step gives its arrays back and fetches them again page by page, a fifth of its time. The array takes no memory,
    since nothing is written to it."""
    np.empty(KEPT_BYTES // 2, np.uint8)


def train(p: Params, blocks: Iterable[np.ndarray], rate: float, seed: int) -> tuple[Params, float]:
    """One pass of Adam over a stream of blocks of windows (inputs, goals, and 1 where the goal counts); returns also the
    number of goals."""
    keep_memory()
    at_p = packed(p).astype(np.float32)
    m, v, at_g, step_of = (np.zeros_like(at_p) for _ in range(4))
    p, g = views(at_p), views(at_g)
    rng = np.random.default_rng(seed)
    step, weight = 0, 0.0
    for block in blocks:
        weight += float(block[:, 2].sum())
        order = rng.permutation(len(block))
        for at in range(0, len(order), BATCH):
            step += 1
            part = block[order[at : at + BATCH]].astype(np.int64)
            at_g[:] = 0
            gradients(p, part[:, 0], part[:, 1], part[:, 2] > 0, g)
            # The means up to factors, which the step makes good.
            m *= 0.9
            m += at_g
            at_g *= at_g
            v *= 0.999
            v += at_g
            size = math.sqrt((1 - 0.999**step) / 0.001)
            np.sqrt(v, out=step_of)
            step_of += 1e-7 * size
            np.divide(m, step_of, out=step_of)
            step_of *= rate * 0.1 * size / (1 - 0.9**step)
            at_p -= step_of
    return p, weight


def packed(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def views(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in shapes().items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def unpacked(flat: np.ndarray) -> Params:
    return views(flat.astype(np.float32))


def token_scores(p: Params, sequences: list[np.ndarray]) -> np.ndarray:
    """Sum of natural log probabilities of each sequence of entries, given the end entry before it. Windows of all
    sequences form batches; a window scores the tokens that the one before it has not scored."""
    lengths = np.array([len(s) for s in sequences])
    joined = np.concatenate([np.zeros(1, np.int64), *[np.concatenate([s, [0]]) for s in sequences], np.zeros(WINDOW, np.int64)])
    # Inputs of a sequence start one cell before its first goal, at the end entry (0) that closes the one before.
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n_windows = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), n_windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    totals = np.zeros(len(lengths))
    d = WIDTH
    # One layer: what a token and a place send into attention are rows of small tables.
    weights = scaled(p)
    own_table, own_places = (np.hstack([p[k] @ weights[:, :d], p[k]]) for k in ("E", "P"))
    sent_table, sent_places = (np.hstack([p[k] @ weights[:, d : 2 * d], p[k] @ (weights[:, 2 * d :] @ p["Wo"])]) for k in ("E", "P"))
    joined = joined.astype(np.int32)
    to_class, members = np.ascontiguousarray(p["Uc"].T), np.ascontiguousarray(p["Um"].transpose(0, 2, 1))
    # Later windows score no token of their first places, which then need not attend.
    for skip, group in ((0, np.flatnonzero(number == 0)), (WINDOW - STRIDE, np.flatnonzero(number))):
        place = np.arange(skip, WINDOW)
        open_cells = np.tri(WINDOW, dtype=p["E"].dtype)[skip:]
        for at in range(0, len(group), 256):
            hidden, goals, owners = [], [], []
            for part in range(at, min(at + 256, len(group)), 64):  # few windows at a time: their scores stay in the cache
                window = group[part : min(part + 64, at + 256)]
                own, num = owner[window], number[window]
                cells = (base[own] + num * STRIDE)[:, None] + np.arange(WINDOW)
                entry = joined[cells]
                sent = np.take(sent_table, entry, axis=0)
                sent += sent_places
                own_rows = np.take(own_table, entry[:, skip:], axis=0)
                own_rows += own_places[skip:]
                o = np.matmul(open_weights(own_rows[..., :d], sent[..., :d], open_cells), sent[..., d:])
                # The end entry stands in for the goal of another sequence's cells; ``real`` leaves those out.
                real = num[:, None] * STRIDE + place < lengths[own][:, None]
                cell = np.flatnonzero(real)
                o += own_rows[..., d:]
                h = o.reshape(-1, d)
                hidden.append(h if len(cell) == len(h) else np.take(h, cell, axis=0))
                goals.append(joined[cells[:, skip:].ravel()[cell] + 1])
                owners.append(own[cell // len(place)])
            goal = np.concatenate(goals)
            order, spans = by_class(goal // MEMBERS)
            h, goal = np.take(np.concatenate(hidden), order, axis=0), goal[order].astype(np.int64)
            z = times(h, p["W1"])
            z += p["b1"]
            h += times(np.maximum(z, 0, out=z), p["W2"])
            c = goal // MEMBERS
            first = np.arange(len(goal))
            lc = times(h, to_class)
            lc += p["bc"]
            logp = np.take(lc, first * CLASSES + c)
            logp -= log_sum(lc)
            lm = np.empty((len(goal), MEMBERS), h.dtype)
            for i, span in spans:
                np.dot(h[span], members[i], out=lm[span])
            lm += np.take(p["bm"], c, axis=0)
            logp += np.take(lm, first * MEMBERS + goal % MEMBERS)
            logp -= log_sum(lm)
            totals += np.bincount(np.concatenate(owners)[order], logp, minlength=len(totals))
    return totals


# --- entries: what the model predicts ------------------------------------------------------------------------------


def entries(counts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Map ids to entries: 0 is the end, 1 the common entry of rare ids, then the most frequent ids by count, spread over
    the classes. Returns the map, the counts of entries, and the natural log of each id's share within its entry."""
    size = CLASSES * MEMBERS
    top = np.argsort(-counts, kind="stable")[: size - 2]
    top = top[counts[top] > 0]
    to_entry = np.ones(len(counts), np.int64)
    to_entry[top] = np.arange(2, len(top) + 2)
    rare = to_entry == 1
    by_entry = np.bincount(to_entry, counts, minlength=size)
    by_entry[0] = n_docs
    share = np.zeros(len(counts))
    share[rare] = np.log((counts[rare] + 0.5) / (counts[rare] + 0.5).sum())
    return to_entry, by_entry, share


# --- Spark jobs ----------------------------------------------------------------------------------------------------


def coded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, row, held_out, text and ids (little-endian unsigned 32-bit) of every whole text, as a written table: the same
    rows, in the same order, for counts, training and scores."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = memo_tokenizer(tokenizer)
        for batch in by_bytes(batches, 2, CODED_BYTES):
            flat, ends = coder.encode_column(batch.column(2))
            offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=["doc_id", "held_out", "text", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(code, f"doc_id {kind}, held_out boolean, text string, ids binary")
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return durable(done.withColumn("row", F.monotonically_increasing_id()))


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of texts without nulls, A-Z in lower case, as UTF-8, and each word's text. Arrow's ASCII blanks are these six."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    words = split.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a text leave empty ones
    return owner[real.to_numpy(zero_copy_only=False)], words.filter(real).cast(pa.large_binary()).cast(pa.binary())


def word_counts(learning: DataFrame) -> DataFrame:
    """(word, c) over all learning texts; counted in the tasks before the shuffle. The end of each text counts as a word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        seen = schema.empty_table()
        for batch in batches:
            words, counts = words_in(batch.column(0))[1].value_counts().flatten()
            ends = pa.table([pa.array([END_WORD], pa.binary()), pa.array([batch.num_rows], pa.int64())], schema)
            seen = pa.concat_tables([seen, pa.table([words, counts], schema), ends])
            seen = seen.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(schema.names)
            if len(seen) > MAX_COUNTED:
                yield from seen.to_batches()
                seen = schema.empty_table()
        yield from seen.to_batches()

    return learning.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(learning: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of every id over all learning texts, and the number of texts. The result has a row per id of the tokenizer's
    fixed vocabulary at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").astype(np.int64), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts))], names=["id", "c"])

    rows = learning.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    found = {r["id"]: r["c"] for r in rows}
    n_docs = found.pop(-1, 0)
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    counts[list(found)] = list(found.values())
    return counts, n_docs


def draws(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of windows by their rows and places there, spread evenly; 64-bit arithmetic that wraps, for any row."""
    mixed = rows.astype(np.uint64) * np.uint64(1_000_003) + numbers.astype(np.uint64)
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)) / 65_536


def windows_of(batches: Iterable[pa.RecordBatch], entry_of: np.ndarray, turn: int, share: float) -> Iterator[np.ndarray]:
    """Blocks of the windows of (row, ids) that a round takes: inputs, goals and whether a goal counts, as entries."""
    kept, held = [], 0
    entry_of = entry_of.astype(np.int16)
    gap = bytes(4 * (WINDOW + 1))
    for batch in remade(batches, 256):
        ids = batch.column(1).to_pylist()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # Windows, with the entry before the first goal, lie within their text and the gaps around it.
        flat = np.frombuffer(gap + gap.join(ids) + gap, "<u4")
        lines = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 1)
        base = np.cumsum(sizes + WINDOW + 1) - sizes
        n_windows = sizes // WINDOW + 1
        owner = np.repeat(np.arange(len(ids)), n_windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        drawn = draws(batch.column(0).to_numpy()[owner], number)
        chosen = np.flatnonzero((drawn + turn / ROUNDS) % 1.0 < share)

        def gathered(part: np.ndarray) -> np.ndarray:
            own = owner[part]
            size = sizes[own][:, None]
            place = number[part][:, None] * WINDOW + np.arange(-1, WINDOW)
            line = np.take(entry_of, np.minimum(lines[base[own] + place[:, 0]], len(entry_of) - 1))
            line *= (place >= 0) & (place < size)  # the end is entry 0
            return np.stack([line[:, :-1], line[:, 1:], place[:, 1:] <= size], 1).astype(np.int16)

        done = end = 0
        for n in np.bincount(owner[chosen], minlength=len(ids)).tolist():
            for at in range(0, n, HELD_WINDOWS):  # a long text has many blocks
                size = min(n - at, HELD_WINDOWS)
                end, held = end + size, held + size
                if held >= HELD_WINDOWS:
                    yield np.concatenate([*kept, gathered(chosen[done:end])])
                    kept, held, done = [], 0, end
        if done < end:
            kept.append(gathered(chosen[done:]))
    if kept:
        yield np.concatenate(kept)


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (w, p) with the sums of all."""
    weight, flat = 0.0, np.zeros(0)
    for batch in batches:
        for w, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weight += w
            flat = np.frombuffer(p, "<f8") + (flat if len(flat) else 0.0)
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=["w", "p"])


def averaged(sent: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of rows (w, p), p a weighted array of doubles; None without rows. Tasks behind a shuffle add what about
    the root of the number of tasks sent, the driver adds their sums. Unlike treeAggregate() on the rows of mapInArrow(),
    this needs no second Python process a task beside the one that trains."""
    groups = math.isqrt(max(tasks - 1, 0)) + 1
    by_task = sent.withColumn("part", F.spark_partition_id() % groups).repartition(groups, "part")
    rows = by_task.select("w", "p").mapInArrow(summed, "w double, p binary").collect()
    if not rows:
        return None
    return sum(np.frombuffer(r["p"], "<f8") for r in rows) / sum(r["w"] for r in rows)


def fit(learning: DataFrame, to_entry: np.ndarray, by_entry: np.ndarray) -> Params:
    """Rounds of local steps and averaging; every window has its round. A task holds a block of windows at a time."""
    spark = learning.sparkSession
    tasks = learning.rdd.getNumPartitions()
    total = max(float(by_entry.sum()), 1.0)
    share = min(1.0, max(1.0, MIN_TOKENS / total) / ROUNDS)
    p = start(by_entry)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((packed(p), to_entry))
        rate = 2 * RATE / 2**turn

        def run(batches: Iterable[pa.RecordBatch], turn: int = turn, rate: float = rate) -> Iterator[pa.RecordBatch]:
            memo_tokenizer.cache_clear()  # a reused worker may still hold it
            flat, entry_of = shared.value
            p, weight = train(unpacked(flat), windows_of(batches, entry_of, turn, share), rate, SEED + turn)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(packed(p) * weight).astype("<f8").tobytes()], pa.binary())], names=["w", "p"])

        mean = averaged(learning.select("row", "ids").mapInArrow(run, "w double, p binary"), tasks)
        shared.unpersist()
        if mean is not None:  # a round of a tiny input may have no window
            p = unpacked(mean)
    return p


def entry_scores(p: Params, ids: list[bytes], entry_of: np.ndarray, share_of: np.ndarray, unseen: float) -> np.ndarray:
    """log10 probability of each text, given as its ids, with its end."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([len(x) // 4 for x in ids])
    line = entry_of[np.minimum(flat, len(entry_of) - 1)]
    line[flat >= len(entry_of)] = 1
    rare = np.flatnonzero(line == 1)
    shares = np.append(share_of, unseen)[np.minimum(flat[rare], len(share_of))]
    extra = np.bincount(np.searchsorted(ends, rare, "right"), shares, minlength=len(ids))
    # The closing 0 of each sequence is its end, scored as a token.
    scores = token_scores(p, [np.append(x, 0) for x in np.split(line, ends[:-1])])
    return (scores + extra) / math.log(10)


def frequent(vocabulary: DataFrame, most: int = HOT_WORDS) -> DataFrame:
    """The words of the highest counts, at most ``most``: those from a count on, which a histogram of counts (in steps of a
    16th of an octave, under 1100 rows) gives."""
    step = F.floor(F.log2("c") * 16)
    at, n = None, 0
    for r in sorted(vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        n += r["n"]
        if n > most:
            break
        at = r["step"]
    return vocabulary.where(F.lit(False) if at is None else step >= at).select("word", "c")


def score_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learning uses the documents that are not held out. Null text is empty and scores its end alone. Null or repeated ids
    and repeated rows are scored row by row; further columns of ``docs`` are not read. An empty table gives none; without
    learning texts every count is 0 and the model is untrained.
    """
    spark = docs.sparkSession
    table = coded(docs, tokenizer)
    learning = table.where("not held_out")
    with small_batches(spark, BATCH_BYTES):
        vocabulary = durable(word_counts(learning))
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = frequent(vocabulary).collect()
    below = math.log10(n + ADD * (v + 1))
    with small_batches(spark, BATCH_BYTES):
        counts, n_docs = id_counts(learning)
        to_entry, by_entry, share = entries(counts, n_docs)
        params = fit(learning, to_entry, by_entry)
    shared = spark.sparkContext.broadcast((packed(params), to_entry, share, pa.array([r["word"] for r in hot], pa.binary()), np.array([math.log10(r["c"] + ADD) - below for r in hot])))
    kind = docs.schema["doc_id"].dataType
    unseen = float(np.log(0.5 / max((counts[to_entry == 1] + 0.5).sum(), 0.5)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_tokenizer.cache_clear()
        keep_memory()
        flat, entry_of, share_of, hot_words, hot_scores = shared.value
        p = unpacked(flat)
        end = pc.index_in(pa.array([END_WORD], pa.binary()), hot_words)[0].as_py()
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = columns["row"].to_numpy()
            scores = [entry_scores(p, part.column(0).to_pylist(), entry_of, share_of, unseen) for part in remade([batch.select(["ids"])], 64)]
            owner, words = words_in(columns["text"])
            n_tokens = np.bincount(owner, minlength=len(rows)) + 1
            place = pc.index_in(words, hot_words)
            missing = place.is_null().to_numpy(zero_copy_only=False)
            found = hot_scores[place.drop_null().to_numpy()].tolist()
            ends = np.cumsum(np.bincount(owner[~missing], minlength=len(rows))).tolist()
            last = [] if end is None else [hot_scores[end]]
            base = [math.fsum(found[a:b] + last) for a, b in zip([0, *ends], ends)]
            n_known = np.diff(ends, prepend=0) + len(last)
            # Each other word once a text, with its count there; so the end, should it not be among the frequent ones.
            rest, own = words.filter(pa.array(missing)), owner[missing]
            if end is None:
                rest, own = pa.concat_arrays([rest, pa.array([END_WORD] * len(rows), pa.binary())]), np.append(own, np.arange(len(rows)))
            rest = rest.dictionary_encode()
            each, k = np.unique(own * max(len(rest.dictionary), 1) + rest.indices.to_numpy(), return_counts=True)
            r, w = np.divmod(each, max(len(rest.dictionary), 1))
            n_rare, n_rows = len(each), len(rows)
            null = lambda kind, m: pa.nulls(m, kind)
            both = lambda a, b: pa.concat_arrays([a, b])
            yield pa.RecordBatch.from_arrays(
                [
                    both(columns["row"], pa.array(rows[r], pa.int64())),
                    both(columns["doc_id"], null(columns["doc_id"].type, n_rare)),
                    both(columns["held_out"], null(pa.bool_(), n_rare)),
                    both(pa.array(n_tokens, pa.int64()), pa.array(k, pa.int64())),
                    both(pa.array(n_known, pa.int64()), null(pa.int64(), n_rare)),
                    both(pa.array(base, pa.float64()), null(pa.float64(), n_rare)),
                    both(pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64()), null(pa.float64(), n_rare)),
                    both(null(pa.binary(), n_rows), rest.dictionary.take(pa.array(w))),
                ],
                names=["row", "doc_id", "held_out", "n", "known", "base", "score", "word"],
            )

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n", T.LongType()),
            T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("word", T.BinaryType()),
        ]
    )
    with small_batches(spark, BATCH_BYTES):
        found = durable(table.select("row", "doc_id", "held_out", "text", "ids").mapInArrow(run, schema))
    release(table)
    rare = found.where("word is not null").select("row", "word", "n").join(vocabulary, "word", "left")
    each = F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)) - F.lit(below)
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(each * F.col("n")).alias("more_base"))
    scored = found.where("word is null").join(sums, "row", "left")
    return scored.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
