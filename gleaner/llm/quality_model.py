"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; unlabelled text is any text of the learning folds. The share of good text
among the unlabelled (the class prior) is estimated from how a first model's scores spread over all rows of both kinds,
then the model minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss. Features come from the
text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import remade, replaced

#: Documented bounds: positives and unlabelled texts that the model is fitted on. Everything else covers all rows.
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 8_000
#: Weakest ridge of the weights, and Newton steps of a fit at most (it ends when a step changes nothing).
RIDGE = 1e-2
MAX_STEPS = 100
CUT = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2
SCORE_BINS = 200
SEED = 11

N_FEATURES = 256 + 16


def byte_class(members: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


BLANK = byte_class(b" \t\n\x0b\x0c\r")
SYMBOL = byte_class(b"#*$%&|<>")
STOP = byte_class(b".!?")
DIGIT = byte_class(b"0123456789")
UPPER = byte_class(bytes(range(65, 91)))
WORD = UPPER | DIGIT | byte_class(bytes(range(97, 123)) + bytes(range(128, 256)))
LOWER = np.where(UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated(hashes: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each document, how many of its hashes repeat an earlier one."""
    salted = hashes ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(salted)
    h = salted[order]
    return np.bincount(owner[order[1:]][h[1:] == h[:-1]], minlength=n_docs)


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    """Of each whole text, the shares of bytes (square roots) and of word and line patterns; all zero for a text without
    words. The texts of a batch are worked as one array of bytes, each followed by a line feed."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    m = len(raws)
    x = np.zeros((m, N_FEATURES), np.float32)
    if not m:
        return x
    sizes = np.fromiter(map(len, raws), np.int64, m)
    a = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    doc = np.repeat(np.arange(m), sizes + 1)
    inside = ~BLANK[a]
    edges = np.flatnonzero(np.concatenate([inside, [False]]) != np.concatenate([[False], inside]))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return x
    owner = doc[starts]
    n = np.bincount(owner, minlength=m)
    has = n > 0
    words, size = np.maximum(n, 1), np.maximum(sizes, 1)
    counts = np.bincount(doc * 256 + a, minlength=256 * m).reshape(m, 256)
    counts[:, 10] -= 1
    lengths = ends - starts
    per_word = lambda flags: np.bincount(owner[flags], minlength=m) / words
    mean = np.bincount(owner, lengths, minlength=m) / words
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths.astype(float) ** 2, minlength=m) / words - mean**2, 0))
    # A word's hash: its bytes in lower case, each with a factor of its place in the word; blanks add nothing.
    body = a[starts[0] :]
    spans = np.append(starts[1:], len(a)) - starts
    place = (np.arange(len(body)) - np.repeat(starts - starts[0], spans)).astype(np.uint64)
    value = (LOWER[body] + np.uint64(1)) * (place * (place + MULTIPLIER) + MULTIPLIER) * inside[starts[0] :]
    h = np.add.reduceat(value, starts - starts[0])
    h ^= h >> np.uint64(29)
    next_too = owner[1:] == owner[:-1]
    pairs = h[:-1] * MULTIPLIER + h[1:]
    third_too = owner[2:] == owner[:-2]
    triples = pairs[:-1] * MULTIPLIER + h[2:]
    last = a[ends - 1]
    lines = [[s for s in raw.split(b"\n") if s.strip()] for raw in raws]
    n_lines = np.fromiter(map(len, lines), np.int64, m)
    n_distinct = np.fromiter((len(set(s)) for s in lines), np.int64, m)
    x[:, :256] = np.sqrt(counts / size[:, None])
    x[:, 256:] = np.stack(
        [
            np.minimum(np.log10(words), 5.0) / 5,
            np.minimum(mean, 20.0) / 20,
            np.minimum(spread, 20.0) / 20,
            per_word(lengths == 1),
            per_word(lengths > 15),
            np.bincount(owner[1:][next_too & (h[1:] == h[:-1])], minlength=m) / words,
            repeated(pairs[next_too], owner[:-1][next_too], m) / np.maximum(n - 1, 1),
            repeated(triples[third_too], owner[:-2][third_too], m) / np.maximum(n - 2, 1),
            counts[:, SYMBOL].sum(1) / size * 5,
            counts[:, UPPER].sum(1) / size,
            per_word(STOP[last]),
            per_word(~WORD[last]),
            1 - n_distinct / np.maximum(n_lines, 1),
            np.minimum(n_lines / words, 1.0),
            counts[:, DIGIT].sum(1) / size,
            np.ones(m),
        ],
        axis=1,
    )
    x[~has] = 0
    return x


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    center: np.ndarray
    scale: np.ndarray
    prior: float
    ridge: float = RIDGE

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale @ self.weights + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64))), 12)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float, w: np.ndarray) -> np.ndarray:
    """Newton steps to the least unbiased risk with this ridge. With the logistic loss the risk is convex,
    ``mean_u softplus(z) - prior * mean_p z``; the bias (last) has no ridge, so that the mean score of the unlabelled is the
    prior."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    pull = prior * positive.mean(0)
    risk = lambda v: softplus(unlabelled @ v).mean() - pull @ v + 0.5 * (penalty * v * v).sum()
    now = risk(w)
    for _ in range(MAX_STEPS):
        s = 1 / (1 + np.exp(-np.clip(unlabelled @ w, -30, 30)))
        gradient = s @ unlabelled / len(s) - pull + penalty * w
        curvature = (unlabelled * (s * (1 - s) / len(s))[:, None]).T @ unlabelled + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(curvature, gradient), 1.0
        while (after := risk(w - size * step)) > now and size > 1e-6:
            size /= 2
        if not after < now - 1e-12:
            break
        w, now = w - size * step, after
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The least non-negative risk, prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), with a ridge.

    Where the least unbiased risk has a non-negative second part, it is the least non-negative risk too, since that is never
    smaller. A negative one is a sign of too free a model, so the ridge is doubled until it is not (without weights the part is
    (1 - prior) * softplus(bias)). The outcome depends on no order, batch or number of steps."""
    both = np.concatenate([positive, unlabelled])
    center, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.hstack([(m - center) / scale, np.ones((len(m), 1))]).astype(np.float64) for m in (positive, unlabelled))
    w, ridge = np.zeros(p.shape[1]), RIDGE
    w[-1] = np.log(prior / (1 - prior))
    while True:
        w = minimise(p, u, prior, ridge, w)
        if softplus(u @ w).mean() >= prior * softplus(p @ w).mean() or ridge > 1e6:
            return Model(w[:-1].astype(np.float32), float(w[-1]), center, scale, prior, ridge)
        ridge *= 2


def prior_from_bins(bins: list[tuple[int, int, int]], delta: float = 0.1) -> float:
    """Share of positives among the unlabelled from (bin, positives, unlabelled) counts: of all cuts, the one where the
    unlabelled exceed a score least in proportion to the positives, with an allowance for few rows above the cut."""
    counts = np.zeros((2, SCORE_BINS + 1))
    for b, p, u in bins:
        counts[:, b] = p, u
    above = counts[:, ::-1].cumsum(1)[:, ::-1]
    n_p, n_u = above[:, 0]
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = above / np.array([[n_p], [n_u]])
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    ok = q_p > 0.05
    at = np.argmin(np.where(ok, (q_u + slack) / np.maximum(q_p, 1e-12), np.inf))
    return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows without an id are in no learning fold and not held out."""
    return F.coalesce(remainder(doc_id) == HELD_OUT_FOLD, F.lit(False))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with its score; an input column named score is replaced."""
    kept = [c for c in docs.columns if c.lower() != "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in remade(batches, 128):
            scores = model.score(feature_matrix(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text_")).mapInArrow(run, schema)


def least_hashes(ids: DataFrame, seed: int, bound: int) -> DataFrame:
    """The ``bound`` ids with the smallest hashes. Those that can't be among them are left out before the order is made, by a
    threshold somewhat above the share that is wanted; were it too low, which is next to impossible, a few fewer are taken."""
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    share = (1.2 * bound + 500) / max(1, ids.count())
    near = ids if share >= 1 else ids.where(h < int(share * (1 << 40)))
    return near.orderBy(h, "doc_id").limit(bound)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the learning folds (crc32 of the id, mod 4, not 2). A label counts as positive if all labels of the id are 1.
    Without positives or texts every score is the prior, 0.5."""
    learning = F.coalesce(remainder() != HELD_OUT_FOLD, F.lit(False))
    good = labels.where(learning & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    positives = least_hashes(good, SEED, MAX_POSITIVES).withColumn("positive", F.lit(True))
    others = least_hashes(docs.where(learning).select("doc_id"), SEED + 1, MAX_UNLABELLED).withColumn("positive", F.lit(False))
    # At most MAX_POSITIVES + MAX_UNLABELLED ids: a broadcast of bounded size.
    sample = docs.select("doc_id", "text").join(F.broadcast(positives.union(others)), "doc_id").select("doc_id", "positive", "text")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in remade(batches, 128):
            rows = [f.tobytes() for f in feature_matrix(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], names=["doc_id", "positive", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(extract, f"doc_id {kind}, positive boolean, x binary")
    # Repeated ids could exceed the bound; the order also makes the fit independent of how rows arrive.
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(2)) == 0)
    rows = rows.orderBy(F.xxhash64("doc_id", "x"), "positive").limit(MAX_POSITIVES + MAX_UNLABELLED).collect()
    stack = lambda kept: np.stack([np.frombuffer(r["x"], np.float32) for r in kept]) if kept else np.zeros((0, N_FEATURES), np.float32)
    positive, unlabelled = stack([r for r in rows if r["positive"]]), stack([r for r in rows if not r["positive"]])
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(N_FEATURES, np.float32), 0.0, np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), 0.5)
    # The first model sees one half of the ids, the prior is read off the other half, which it has not been fitted to.
    half = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(2)) == 0
    seen = [r["half"] for r in rows if r["positive"]], [r["half"] for r in rows if not r["positive"]]
    first = fit(positive[np.array(seen[0])], unlabelled[np.array(seen[1])], 0.5)
    spread = scored(docs.where(learning & ~half).select("doc_id", "text"), first).select("doc_id", F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"))
    marked = spread.join(good.withColumn("positive", F.lit(True)), "doc_id", "left")
    bins = marked.groupBy("bin").agg(F.count("positive").alias("p"), F.count(F.lit(1)).alias("u")).collect()  # <= SCORE_BINS + 1 rows
    return fit(positive, unlabelled, prior_from_bins([tuple(r) for r in bins]))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents with held_out, score (0 to 1, higher: good text likelier) and predicted (1 from ``cut`` on).

    Only the text is scored. Null and empty texts get the score of a text without words. Repeated rows score alike, an
    empty table stays empty, input columns named like a result are replaced.
    """
    model = learn(docs, labels)
    return replaced(scored(docs, model), {"held_out": held_out(), "score": F.col("score"), "predicted": (F.col("score") >= cut).cast("int")})
