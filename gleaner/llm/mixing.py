"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes each of its documents floor(r) times whole, and once more with
probability r - floor(r). The flight phase moves these probabilities within the null space of two constraints, the sum of
sizes and the number of documents, until all but two per block are 0 or 1; both sums then are exactly what they were.
Blocks hold a bounded number of rows of one source, so a source of any size is worked in parallel; what is left of the
blocks meets in new blocks, until one block per source is left. The last two documents of a source are landed at random.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import placed, words_of
from gleaner.operators.skew import number_rows
from gleaner.session import durable, scratch

#: Weights by rank of the source, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK_ROWS = 2000
SEED = 7
EPS = 1e-9


def size_column(text: str = "text"):
    return F.size(words_of(F.col(text))).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_rank, n_docs, source_size, target. Sources are ranked by code point, null last.

    Water-filling: with a level x, a source gets min(max_copies * its size, x * weight). x rises as capped sources hand on
    their excess; each round is an aggregate over the sources, of which the driver sees three numbers.
    """
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = number_rows(totals.withColumn("none", F.col("source").isNull()), [], ["none", "source"], "source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = durable(ranked.select("source", F.col("source_rank").cast("long"), "n_docs", "source_size", weight.alias("w")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_copies
    level, capped = 0.0, -1
    while True:
        full = F.lit(False) if capped < 0 else cap <= F.lit(level) * F.col("w")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        level, capped = (total - row["held"]) / row["weight"], row["n"]
    target = F.least(cap.cast("double"), F.lit(level) * F.col("w"))
    return ranked.select("source", "source_rank", "n_docs", "source_size", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one block: at most two probabilities stay strictly between 0 and 1; sum(p) and sum(p * size) keep
    their values. Units enter one by one; three at a time move along the null vector of both constraints."""
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    active: list[int] = []
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            move = (b - c, c - a, a - b)
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            move = (1.0, -1.0)
        else:
            break
        up = min((1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(active, move) if m)
        down = min(p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(active, move) if m)
        step = up if next(draws) * (up + down) < down else -down
        for i, m in zip(active, move):
            x = p[i] + step * m
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        active = [i for i in active if 0 < p[i] < 1]
    return np.array([0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p])


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: the at most two open units get 0 or 1, with their probabilities, so that the expected squared miss of
    the size total is least."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) == 1:
        p[left] = rng.random() < p[left]
    elif len(left) == 2:
        (x, y), (a, b) = p[left], size[left]
        want = x * a + y * b
        miss = [(sx * a + sy * b - want) ** 2 for sx in (0, 1) for sy in (0, 1)]
        low, high = max(0.0, x + y - 1), min(x, y)
        both = low if miss[3] + miss[0] > miss[1] + miss[2] else high
        shares = np.clip([1 - x - y + both, y - both, x - both, both], 0, 1)
        outcome = int(np.searchsorted(np.cumsum(shares), rng.random() * shares.sum(), side="right").clip(0, 3))
        p[left] = divmod(outcome, 2)
    return p


def flight(level: int, seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "size", "p"], kind="stable")
        rng = np.random.default_rng([seed, level, int(block["source_rank"].iloc[0]), int(block["block"].iloc[0])])
        p = fly(block["p"].to_numpy(), block["size"].to_numpy(), rng)
        if last:
            p = land(p, block["size"].to_numpy(), rng)
        return block.assign(p=p)

    return run


def mix(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """units (doc_id, source, size, and optionally ``row``, unique) with source_size, target and taken.

    ``taken`` is size times the copies of the document. Without ``row``, rows that are equal in doc_id, source and size
    are numbered among themselves, which needs no order. A column ``tie`` tells rows of equal doc_id and size apart, and then
    ``row`` decides only among rows that are equal in all three. Null ids and sources are values like others; a document of
    size 0 takes nothing. The same rows give the same result, however they are laid out; an empty table gives none.
    """
    with scratch(units.sparkSession) as cuts:
        if "row" not in units.columns:
            same = units.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
            units = same.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("row"))
        own = F.xxhash64(F.lit(seed), "doc_id", "size", "tie" if "tie" in units.columns else "row")
        units = durable(units.select("doc_id", "source", "size", "row", own.alias("h")))  # read twice, without texts
        again = units.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("again"))
        wanted = durable(targets(units, weights, max_copies))
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        rows = units.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rows = rows.join(again, "h", "left").withColumn("h", F.when(F.col("again"), F.xxhash64("h", "row")).otherwise(F.col("h"))).drop("again")
        rows = durable(rows.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)))
        keys = ["doc_id", "source", "size", "row", "source_rank", "source_size", "target", "h", "whole"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", p double, block long"
        most = wanted.agg(F.max("n_docs")).first()[0] or 0
        n_blocks, done, open_rows = F.ceil(F.col("n_docs") / BLOCK_ROWS), [], rows
        level = 0
        while True:
            last = most <= BLOCK_ROWS
            dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), n_blocks)).select(*keys, "p", "block")
            flown = durable(dealt.groupBy("source_rank", "block").applyInPandas(flight(level, seed, last), schema))
            done.append(flown if last else flown.where("p = 0 or p = 1"))
            if last:
                break
            left = flown.where("p > 0 and p < 1")
            counts = left.groupBy("source_rank").agg(F.count(F.lit(1)).alias("n_docs"))
            open_rows = left.drop("block").join(counts, "source_rank")
            most = counts.agg(F.max("n_docs")).first()[0] or 0
            level += 1
        whole = done[0]
        for part in done[1:]:
            whole = whole.unionByName(part)
        taken = (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken")
        return cuts.keep(whole.select("doc_id", "source", "row", "size", "source_size", "target", taken))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` (doc_id, text, source, more) as often as the mix takes it."""
    keyed, row = placed(docs)
    units = keyed.select("doc_id", "source", size_column().alias("size"), F.col(row).alias("row"), F.xxhash64("text").alias("tie"))
    taken = mix(units, weights, max_copies, seed).where("taken > 0").select(F.col("row").alias(row), F.expr("taken div size").alias(f"{row}_n"))
    repeated = keyed.join(taken.hint("shuffle_hash"), row).withColumn(f"{row}_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{row}_n"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
