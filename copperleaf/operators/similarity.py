"""Likeness of texts and vectors: overlap scores, cosine, the nearest references.

The text scores are loops over a pair's own words, so they are pandas UDFs over Arrow batches. Scores that need models which are not
there (METEOR's synonyms, BERTScore) are null and never 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, materialise
from copperleaf.functions.text import text_key

WORD = re.compile(r"\w+")
#: Rows of a block of golds, and of the pool.
GOLDS, POOL = 4096, 32768


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        same = row & where.get(y, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def rouge_l(reference: str, said: str) -> float:
    """F1 of the longest common subsequence of lower-cased words; 0 where a side has none."""
    r, c = WORD.findall(reference.lower()), WORD.findall(said.lower())
    n = lcs_length(r, c) if r and c else 0
    return 2 * (n / len(c)) * (n / len(r)) / (n / len(c) + n / len(r)) if n else 0.0


def _grams(words: list[str] | str, n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(references: list[str], said: str, order: int = 4) -> float:
    """Sentence BLEU with orders up to the sentence's own, zero counts halved over and over, and the brevity of the nearest reference."""
    tokens = lambda t: re.findall(r"\w+|[^\w\s]", t)
    c, refs = tokens(said), [tokens(r) for r in references]
    if not c or not any(refs):
        return 0.0
    logs, smooth = [], 1.0
    for n in range(1, order + 1):
        have = _grams(c, n)
        total = sum(have.values())
        if not total:
            break
        most = reduce(lambda a, b: a | b, [_grams(r, n) for r in refs])
        hit = sum((have & most).values())
        if not hit:
            smooth *= 2
        logs.append(math.log((hit or 1 / smooth) / total))
    if _is_disjoint(c, refs):
        return 0.0
    nearest = min((abs(len(r) - len(c)), len(r)) for r in refs)[1]
    return min(1.0, math.exp(1 - nearest / len(c))) * math.exp(sum(logs) / len(logs))


def _is_disjoint(words: list[str], refs: list[list[str]]) -> bool:
    return not any(set(words) & set(r) for r in refs)


def chrf(references: list[str], said: str, order: int = 6, beta: float = 2.0) -> float:
    """The best F score over the references of shared runs of up to ``order`` characters, white space left out."""
    flat = lambda t: re.sub(r"\s+", "", t)
    c, best = flat(said), 0.0
    for ref in map(flat, references):
        scores = []
        for n in range(1, order + 1):
            have, want = _grams(c, n), _grams(ref, n)
            if have and want:
                hit = sum((have & want).values())
                scores.append((hit / sum(have.values()), hit / sum(want.values())))
        if scores:
            p, r = (sum(s[i] for s in scores) / len(scores) for i in (0, 1))
            best = max(best, (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0)
    return best


def _scored(function: Callable[[list[str], str], float | None]) -> Callable[[Column, Column], Column]:
    """A score of (references, text): 0 for blank text or references, null for null."""

    def each(references: pd.Series, said: pd.Series) -> pd.Series:
        out = []
        for refs, text in zip(references, said, strict=True):
            known = [r for r in (refs if refs is not None else []) if r and r.strip()]
            out.append(None if text is None else 0.0 if not text.strip() or not known else function(known, text))
        return pd.Series(out, dtype="float64")

    return lambda references, said: F.pandas_udf(each, "double")(references, said)  # made where a session is


#: Scores by name; each takes the references (an array) and the text.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rouge_l": _scored(lambda refs, text: max(rouge_l(r, text) for r in refs)),
    "bleu": _scored(bleu),
    "chrf": _scored(chrf),
    "meteor": lambda refs, text: F.lit(None).cast("double"),
    "bertscore": lambda refs, text: F.lit(None).cast("double"),
}


def with_reference_metrics(rows: DataFrame, text: str, gold: str, references: str) -> DataFrame:
    """``rows`` with each metric against the gold text (<name>_gold) and the others (<name>_multi), and how much closer to gold than to others
    the text is (excess)."""
    made = {f"{n}_{k}": m(r, F.col(text)) for n, m in METRICS.items() for k, r in (("gold", F.array(gold)), ("multi", F.col(references)))}
    return rows.withColumns(made).withColumn("excess", F.col("rouge_l_gold") - F.col("rouge_l_multi"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is empty or all zeros, null where one is null."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) > 0) & (F.size(b) > 0) & (size > 0), dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0))


def argmax_cosine(rows: DataFrame, vector: str, anchors: list[tuple[str, list[float]]], threshold: float = 0.28) -> DataFrame:
    """``rows`` with the anchor that is nearest by cosine and how near; ``unknown`` below the threshold. The anchors are few."""
    each = F.array(*[F.struct(cosine(F.col(vector), F.array(*map(F.lit, v))).alias("near"), F.lit(-i).alias("first"), F.lit(n).alias("anchor")) for i, (n, v) in enumerate(anchors)])
    return rows.withColumn("_best", F.array_max(each)).withColumns({"near": F.col("_best.near"), "anchor": F.when(F.col("_best.near") >= threshold, F.col("_best.anchor")).otherwise("unknown")}).drop("_best")


def nearest_references(gold: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """(gold_id, ref_id, near, place): the k rows of the gold's platform that are nearest by cosine, of the whole pool where the platform has fewer
    than k; a row with the gold's own text key never counts. gold and pool: (id, platform, key, vector).

    Golds and pool are dealt to blocks of their platform, GOLDS and POOL rows each, and every block of golds meets every block of its pool in a task of
    its own, which keeps k for a gold; the best are chosen from those. Nothing passes the driver but two counts, and no task holds more than two blocks.
    """
    some = pool.filter("platform IS NOT NULL").groupBy("platform").agg(F.count("*").alias("n"))
    some = materialise(some.filter(F.col("n") >= k).unionByName(pool.select(F.lit(None).cast("string").alias("platform"), F.lit(1).alias("one")).groupBy("platform").agg(F.count("*").alias("n"))), "pool-sizes")
    some = some.withColumnsRenamed({"platform": "_p", "n": "_n"})
    own = F.col("platform").eqNullSafe(F.col("_p"))
    placed = gold.join(broadcast_if_small(some.filter("_p IS NOT NULL")), own, "left").select("id", "key", "vector", F.col("_p").alias("platform"))
    placed = materialise(placed, "gold")
    asked = placed.groupBy(F.col("platform").alias("_g")).agg(F.count("*").alias("_m"))
    blocks = materialise(some.join(asked, F.col("_p").eqNullSafe(F.col("_g"))).select("_p", F.ceil(F.col("_n") / POOL).cast("int").alias("_np"), F.ceil(F.col("_m") / GOLDS).cast("int").alias("_nq")), "blocks")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = broadcast_if_small(blocks)
    # the whole pool only where a gold's platform has too few rows
    whole = pool.select("id", "key", "vector", F.lit(None).cast("string").alias("platform"))
    rows = pool.filter("platform IS NOT NULL").select(*whole.columns)
    rows = rows.unionByName(whole) if blocks.filter("_p IS NULL").count() else rows
    left = placed.join(known, own).withColumn("p", every("_np")).select(F.coalesce("platform", F.lit("")).alias("platform"), F.col("platform").isNull().alias("all"), "p", at("_nq").alias("q"), "id", "key", "vector")
    right = rows.join(known, own).withColumn("q", every("_nq")).select(F.coalesce("platform", F.lit("")).alias("platform"), F.col("platform").isNull().alias("all"), at("_np").alias("p"), "q", "id", "key", "vector")

    def meet(golds: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(golds) and len(block):
            ids, keys = np.array(block["id"].to_pylist(), object), np.array(block["key"].to_pylist(), object)
            units = _units(np.array(block["vector"].to_pylist(), np.float64))
            order = np.argsort(np.array(block["id"].to_pylist()), kind="stable")
            ids, keys, units = ids[order], keys[order], units[order]
            for g, key, x in zip(golds["id"].to_pylist(), golds["key"].to_pylist(), _units(np.array(golds["vector"].to_pylist(), np.float64)), strict=True):
                ok = np.flatnonzero(keys != key)
                near = units[ok] @ x
                out += [(g, ids[ok[j]], float(near[j])) for j in np.argsort(-near, kind="stable")[:k]]
        return pa.table([pa.array([f[i] for f in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["gold_id", "ref_id", "near"])

    cell = ["platform", "all", "p", "q"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, "gold_id long, ref_id long, near double")
    place = F.row_number().over(W.partitionBy("gold_id").orderBy(F.col("near").desc(), "ref_id"))  # k rows of each block
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def reference_corpus(ads: DataFrame, held_out: DataFrame, tier: str = "high", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """ads: (order, platform, tier, blob); held_out: (text). The texts of a tier, each once (its first row), without those that are held out,
    under their platform and under ALL; and the counts (references, held, overlap, percent). Raises where strict and any overlaps, or where all do."""
    rows = ads.filter((F.col("tier") == tier) & (F.col("blob") != "")).withColumn("key", text_key(F.col("blob")))
    once = rows.groupBy("key").agg(F.min_by(F.struct("platform", "blob"), "order").alias("r"), F.min("order").alias("order"))
    held = held_out.filter(F.trim("text") != "").select(text_key(F.col("text")).alias("_held")).distinct()
    marked = materialise(once.join(held, F.col("key") == F.col("_held"), "left").select("order", "r.platform", "r.blob", F.col("_held").isNotNull().alias("overlaps")), "references")
    counts = marked.agg(F.count("*").alias("references"), F.count_if("overlaps").alias("overlap")).crossJoin(F.broadcast(held.agg(F.count("*").alias("held"))))  # one row each
    counts = counts.withColumn("percent", F.round(100.0 * F.col("overlap") / F.greatest(F.lit(1), F.col("held")), 1))
    n = counts.first()
    if n["overlap"] and (strict or n["overlap"] == n["references"]):
        raise ValueError(f"{n['overlap']} of {n['references']} references are held out")
    kept = marked.filter("NOT overlaps").select("order", F.explode(F.array(F.lit("ALL"), F.col("platform"))).alias("platform"), F.col("blob").alias("text"))
    return kept, counts
