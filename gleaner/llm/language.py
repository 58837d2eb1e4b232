"""Language of web pages by Bayesian evidence fusion.

The posterior of a page's language is the product of the likelihood of its visible text (hashed byte 3-grams, tempered,
since overlapping grams are not independent), the likelihoods of the declared markup language and of the address suffix,
and a prior of its host. Text counts come from documents whose language is known. The other tables come from grouped
aggregation over all pages, by the language that the text alone suggests; the host's prior is smoothed by its site's, and
that by the share of each language in the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import remade
from gleaner.session import durable

BUCKETS = 1 << 13
#: Tables of counts are collected and broadcast: languages times BUCKETS numbers. More languages than this are an error.
MAX_LANGUAGES = 200
#: A text counts as at most so many independent grams.
MAX_GRAMS = 60.0
#: Additive smoothing of evidence tables, and pseudo-rows that a host takes from its site and a site from the whole.
SMOOTH = 1.0
PULL = 5.0

# Elements whose content a page does not show.
HIDDEN = re.compile(r"<(?:(!--)|(script|style|noscript|template)\b)?", re.I)
CLOSING = {"!--": re.compile("-->"), "": re.compile(">")} | {
    name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")
}
ENTITY = re.compile(r"&(#?\w{1,10});")


def visible(html: str | None) -> str:
    """What is left without comments, hidden elements, tags and entities. What nothing closes is taken for a plain tag, and a
    ``<`` without ``>`` for text. A closing mark that is not found is never looked for again, so time is linear."""
    if not html:
        return ""
    out, at, missing = [], 0, set()
    while opening := HIDDEN.search(html, at):
        for kind in dict.fromkeys(((opening[1] or opening[2] or "").lower(), "")):
            closing = None if kind in missing else CLOSING[kind].search(html, opening.end() if kind else opening.start() + 1)
            if closing:
                out += (html[at : opening.start()], " ")
                at = closing.end()
                break
            missing.add(kind)
        else:
            break  # no > is left, hence no tag
    return ENTITY.sub(" ", "".join(out) + html[at:])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte 3-gram of the lower-cased letters of all texts, and its text's number; runs of other
    characters count as one blank."""
    rows, owners = [], []
    for i, text in enumerate(texts):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        if letters:
            a = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
            code = (a[:-2] * np.uint32(65_599) + a[1:-1]) * np.uint32(65_599) + a[2:]
            rows.append((code ^ (code >> np.uint32(15))) % np.uint32(BUCKETS))
            owners.append(np.full(len(code), i, np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def text_model(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and log probabilities (languages x BUCKETS) from all documents with a language."""
    known = documents.where("lang is not null and text is not null").select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in remade(batches, 256):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                found = np.bincount(grams([t for t, x in zip(texts, langs) if x == lang])[0], minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + found
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], names=["lang", "bucket", "n"])

    counts = durable(known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs.sort()
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in counts.collect():
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; empty where the address has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def declared_in(html: Column) -> Column:
    """Primary subtag of the lang attribute of the first html element; empty where there is none."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*", 0)
    return F.lower(F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, site, suffix, declared, and the tempered log likelihood of the text for each language."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), declared_in(F.col("html")).alias("declared"), "html")
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.T
        for batch in remade(batches, 128):
            texts = [visible(h) for h in batch.column(3).to_pylist()]
            bucket, owner = grams(texts)
            n = np.bincount(owner, minlength=len(texts))
            sums = np.stack([np.bincount(owner, logs[bucket, k], minlength=len(texts)) for k in range(len(langs))], 1)
            sums *= np.minimum(1.0, MAX_GRAMS / np.maximum(n, 1))[:, None]
            lines = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), len(langs)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lines], names=["page_id", "host", "declared", "text_log"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(score, f"page_id {kind}, host string, declared string, text_log array<double>")
    parts = F.split("host", r"\.")
    return found.withColumns(
        {
            "suffix": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""),
            "site": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."),
            "text_best": (F.array_position("text_log", F.array_max("text_log")) - 1).cast("int"),
        }
    )


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix and host of every page (page_id, url, html).

    Pages without visible letters are judged by the other evidence; without any, by the whole's shares. Null ids, addresses
    and texts are values like others, equal probabilities go to the first language by name, repeated rows are judged
    alike, further columns are not read. Without documents of a known language every lang is null.
    """
    langs, table = text_model(documents)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(
            "page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), declared_in(F.col("html")).alias("declared"), none.alias("suffix"), host_of(F.col("url")).alias("host")
        )
    rows = durable(evidence(pages, langs, table))
    size = len(langs)
    # Pages whose text says nothing teach nothing.
    teaching = rows.where(F.exists("text_log", lambda x: x != 0))
    vector = lambda n: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at(n, k), F.lit(0)).cast("double"))

    def counts(key: str, name: str) -> DataFrame:
        """One row per value of the key with its count in every language, reduced before the shuffle."""
        each = teaching.groupBy(key, "text_best").agg(F.count(F.lit(1)).alias("n"))
        grouped = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_best", "n"))).alias("m"))
        return grouped.select(key, vector(F.col("m")).alias(name))

    whole = np.full(size, SMOOTH)
    for r in teaching.groupBy("text_best").agg(F.count(F.lit(1)).alias("n")).collect():
        whole[r["text_best"]] += r["n"]
    share = whole / whole.sum()
    joined = rows
    for key in ("host", "site", "suffix", "declared"):
        table_of = durable(counts(key, f"n_{key}"))
        joined = joined.join(table_of, key, "left")

    def fuse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = np.zeros(size)
        for batch in batches:
            stack = lambda c: np.stack([zero if x is None else np.asarray(x) for x in batch[c]]) if len(batch) else np.zeros((0, size))
            site = stack("n_site") + PULL * share
            site /= site.sum(1, keepdims=True)
            host = stack("n_host") + PULL * site
            logs = stack("text_log") + np.log(host / host.sum(1, keepdims=True))
            for key in ("suffix", "declared"):
                n = stack(f"n_{key}")
                there = (batch[key] != "").to_numpy()[:, None]
                logs += np.where(there, np.log((n + SMOOTH * share) / whole), 0.0)
            p = np.exp(logs - logs.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            names = np.array(langs, dtype=object)
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"], "lang": names[best], "probability": p[np.arange(len(best)), best],
                    "text_lang": names[batch["text_best"].to_numpy()], "declared": batch["declared"], "suffix": batch["suffix"], "host": batch["host"],
                }
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(fuse, f"page_id {kind}, lang string, probability double, text_lang string, declared string, suffix string, host string")
