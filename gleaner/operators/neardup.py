"""Near duplicates: exact similarity joins on token sets, and the ordered leader rule on top of them.

Candidates come from partition signatures (Arasu, Ganti, Kaushik: Efficient exact set-similarity joins, VLDB 2006).
Two sets with Jaccard similarity >= t and sizes in one size band differ in at most d tokens; if tokens are hashed into
d + 1 classes, the sets agree completely on at least one class. A signature is the hash of one class, so candidates
need an equi-join only, and no similar pair is lost.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gleaner.functions import sqltext as S
from gleaner.functions.frames import pinned
from gleaner.operators.skew import ROWS_PER_SLICE, join_leaders
from gleaner.session import durable

MAX_BANDS_SIZE = 1_000_000_000


# Records that a signature nominates in one round, at most.
MAX_PIVOTS = 256


def token_set(sql: Column) -> Column:
    return F.array_distinct(S.tokens(S.template_key(sql)))


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


@F.pandas_udf(T.DoubleType())
def _difflib_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64"
    )


def similarity(left_tokens: Column, right_tokens: Column, metric: str = "jaccard") -> Column:
    """Similarity of two token lists: ``jaccard`` on sets, ``levenshtein`` or ``difflib`` on the joined tokens.

    Zero when a list is empty or one has less than half the tokens of the other.
    """
    small = F.least(F.size(left_tokens), F.size(right_tokens))
    large = F.greatest(F.size(left_tokens), F.size(right_tokens))
    if metric == "jaccard":
        score = jaccard(F.array_distinct(left_tokens), F.array_distinct(right_tokens))
    else:
        left, right = F.array_join(left_tokens, " "), F.array_join(right_tokens, " ")
        if metric == "levenshtein":
            score = 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))
        elif metric == "difflib":
            score = _difflib_ratio(left, right)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return F.when((small == 0) | (small * 2 < large), F.lit(0.0)).otherwise(score)


def pair_similarity(pairs: DataFrame, left: str, right: str, metric: str = "jaccard") -> DataFrame:
    """Add ``similarity`` of two statement text columns."""
    tokens = {name: S.tokens(S.template_key(F.col(c))) for name, c in (("_left", left), ("_right", right))}
    scored = pinned(pairs, tokens)
    return scored.withColumn("similarity", similarity(F.col("_left"), F.col("_right"), metric)).drop("_left", "_right")


def size_bands(threshold: float) -> list[tuple[int, int, int]]:
    """(first size, last size, number of classes) of each band: sets with similarity >= threshold lie in one band or
    in neighbouring ones. The class count covers a pair of the two largest sizes of the band."""
    bands, low = [], 1
    while low < MAX_BANDS_SIZE:
        high = int(low / threshold + 1e-9)
        differing = int((1 - threshold) / (1 + threshold) * 2 * high + 1e-9)
        bands.append((low, high, differing + 1))
        low = high + 1
    return bands


def band_number(size: Column, bands: list[tuple[int, int, int]]) -> Column:
    first_sizes = F.array(*[F.lit(b[0]) for b in bands])
    return F.size(F.filter(first_sizes, lambda s: s <= size))


def set_signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(signature, ord) rows for token sets in ``form``, blocked by ``block``.

    A set takes part in its own band and in the next larger one, which covers both kinds of pairs.
    """
    bands = size_bands(threshold)
    classes = F.array(*[F.lit(b[2]) for b in bands])
    band = band_number(F.size("form"), bands)
    banded = sets.filter(F.size("form") > 0).select(
        "ord",
        "block",
        F.array_sort(F.transform("form", lambda t: F.xxhash64(t))).alias("hashes"),
        F.explode(F.array_distinct(F.array(band, F.least(band + 1, F.lit(len(bands)))))).alias("band"),
    )
    split = banded.withColumn("n_classes", F.element_at(classes, F.col("band"))).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)).alias("class")
    )
    member = F.filter("hashes", lambda h: F.pmod(h, F.col("n_classes").cast("bigint")) == F.col("class"))
    return split.select(F.xxhash64("block", "band", "class", member).alias("signature"), "ord")


def length_signatures(texts: DataFrame, threshold: float) -> DataFrame:
    """(signature, ord) rows from length bands alone: the lossless filter for character ratios, where
    2 * min / (sum of lengths) bounds the ratio and so limits the quotient of the lengths."""
    bands = size_bands(threshold / (2 - threshold))
    band = band_number(F.length(F.array_join("form", " ")), bands)
    banded = texts.filter(F.size("form") > 0).select(
        "ord",
        "block",
        F.explode(F.array_distinct(F.array(band, F.least(band + 1, F.lit(len(bands)))))).alias("band"),
    )
    return banded.select(F.xxhash64("block", "band").alias("signature"), "ord")


def ordered_leaders(reps: DataFrame, signatures: DataFrame, similar: Column, pivots: int = 4) -> DataFrame:
    """The sequential leader rule, computed in rounds: in ``ord`` order a record joins the first leader it is similar
    to and becomes a leader when there is none.

    ``reps`` has unique ``ord`` and ``form``; ``similar`` is a predicate over ``form`` and ``leader_form``. Each round
    lets every signature nominate its first ``pivots`` undecided records, and records are compared with nominated ones
    only, never with all of their group. A record nominated by all its signatures has met every earlier undecided
    candidate; with no similar one among them it is a leader, and records similar to it are decided too. The first
    undecided record of all is always decided, so the loop ends; ``pivots`` grows to MAX_PIVOTS so that it ends soon, and
    no further, so that what a signature nominates stays bounded and Spark prunes the ranking before the shuffle.
    Returns (ord, leader) for the records that are no leaders.
    """
    many = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("signature")
    signatures = durable(signatures.join(many, "signature", "left_semi"))
    forms = reps.select("ord", "form")
    leader_forms = reps.select(F.col("ord").alias("leader"), F.col("form").alias("leader_form"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(forms, "ord").join(leader_forms, "leader").filter(similar).select("ord", "leader")

    undecided = durable(signatures.select("ord").distinct())
    leader_parts, joined_parts = [], []
    while not undecided.isEmpty():
        active = signatures.join(undecided, "ord", "left_semi")
        rank = F.row_number().over(W.partitionBy("signature").orderBy("ord"))
        first = (
            active.withColumn("rank", rank)
            .filter(F.col("rank") <= pivots)
            .groupBy("signature")
            .agg(F.collect_list("ord").alias("nominated"))
        )
        sizes = active.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
        met = join_leaders(active, first.join(sizes, "signature"), ["signature"], "n", ["ord"], ROWS_PER_SLICE)
        met = met.select(
            "ord",
            F.array_contains("nominated", F.col("ord")).alias("inside"),
            F.filter("nominated", lambda p: p < F.col("ord")).alias("earlier"),
        )
        per_record = durable(
            met.groupBy("ord").agg(
                F.bool_and("inside").alias("covered"),
                F.array_distinct(F.flatten(F.collect_list("earlier"))).alias("earlier"),
            )
        )
        edges = durable(verified(per_record.select("ord", F.explode("earlier").alias("leader"))))
        leaders = per_record.filter("covered").select("ord").join(edges.select("ord"), "ord", "left_anti")
        joined = (
            edges.join(leaders.select(F.col("ord").alias("leader")), "leader", "left_semi")
            .groupBy("ord")
            .agg(F.min("leader").alias("found"))
        )
        leader_parts.append(leaders)
        joined_parts.append(joined)
        undecided = durable(
            undecided.join(leaders, "ord", "left_anti").join(joined.select("ord"), "ord", "left_anti")
        )
        pivots = min(pivots * 4, MAX_PIVOTS)
    if not leader_parts:
        return reps.select("ord", F.col("ord").alias("leader")).filter(F.lit(False))
    leaders, joined = leader_parts[0], joined_parts[0]
    for more_leaders, more_joined in zip(leader_parts[1:], joined_parts[1:], strict=True):
        leaders, joined = leaders.union(more_leaders), joined.union(more_joined)
    # A leader decided in a later round may still come earlier in the order than the one that was found. Only records
    # with such a leader under one of their signatures are looked at again; mostly the found one is the first.
    ahead = durable(signatures.join(leaders, "ord", "left_semi").withColumnRenamed("ord", "leader"))
    first_leader = ahead.groupBy("signature").agg(F.min("leader").alias("first"))
    behind = (
        signatures.join(joined, "ord")
        .join(first_leader, "signature")
        .filter(F.col("first") < F.col("found"))
        .drop("first")
    )
    maybe = (
        behind.join(ahead, "signature")
        .filter(F.col("leader") < F.col("found"))
        .select("ord", "leader")
        .distinct()
    )
    better = verified(maybe).groupBy("ord").agg(F.min("leader").alias("better"))
    return joined.join(better, "ord", "left").select("ord", F.coalesce("better", "found").alias("leader"))


def near_dup(
    df: DataFrame,
    threshold: float = 0.95,
    block: str = "query_type",
    metric: str = "jaccard",
    order: list[str] | None = None,
    carry: list[str] | None = None,
    text: str = "raw_sql",
    pivots: int = 4,
) -> DataFrame:
    """Tag near duplicates within each block; adds ``is_duplicate``, ``survivor`` and ``group_size`` as the key tiers do.

    ``metric`` is ``jaccard`` on token sets or ``difflib``, the character ratio of the joined tokens. Records with the
    same tokens are folded into their first one before any comparison.
    """
    order = order or ["source_file", "ordinal"]
    tokens = S.tokens(S.template_key(F.col(text)))
    form = F.array_sort(F.array_distinct(tokens)) if metric == "jaccard" else tokens
    keyed = pinned(df, {"_form": form}).withColumn(
        "_form_key",
        F.when(F.size("_form") == 0, F.concat_ws("\u0001", *order)).otherwise(
            F.sha2(F.concat_ws("\u0001", F.col(block), F.array_join("_form", " ")), 256)
        ),
    )
    reps = durable(
        keyed.groupBy("_form_key").agg(
            F.min(F.struct(*order, *(carry or []))).alias("ord"),
            F.any_value(block).alias("block"),
            F.any_value("_form").alias("form"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    if metric == "jaccard":
        signatures = set_signatures(reps, threshold)
        similar = jaccard(F.col("form"), F.col("leader_form")) >= threshold
    elif metric == "difflib":
        signatures = length_signatures(reps, threshold)
        similar = similarity(F.col("form"), F.col("leader_form"), "difflib") >= threshold
    else:
        raise ValueError(f"unknown metric {metric!r}")
    joined = ordered_leaders(reps.select("ord", "form"), signatures, similar, pivots)
    resolved = (
        reps.select("_form_key", "ord", "group_size")
        .join(joined, "ord", "left")
        .select("_form_key", "group_size", F.coalesce("leader", "ord").alias("survivor"))
    )
    tagged = join_leaders(keyed.drop("_form"), resolved, ["_form_key"], "group_size", order)
    return tagged.drop("_form_key").withColumn(
        "is_duplicate", F.struct(*order) != F.struct(*[F.col("survivor")[c].alias(c) for c in order])
    )
