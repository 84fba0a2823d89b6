"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features of a text are its distinct words and word pairs, and the words' shapes and pairs of
shapes by their share of the text; a shape is the word with runs of letters and digits reduced to
one sign, and a pair of equal words is marked, so that spelled-out junk is recognised in words that
training never saw. Both groups are scaled to length 1 and hashed into ``2 ** bits`` weights. Ids, labels, language
and source are never features.

Training takes a bounded sample: at most ``max_train`` labelled rows and ``max_bytes`` of their whole texts, the
first by a hash of the id, dealt to ``shards`` groups by another hash. Each group runs FTRL updates over its rows in hash
order, ``epochs`` times, in one task of bounded size, and the groups' weights are averaged by their rows. Everything
else runs over all rows: scoring is a sparse dot product with the broadcast weights, whose size
is ``2 ** bits`` numbers whatever the input.

Defined results: null and empty texts have no features and score by the bias alone; null labels
and null ids are not learned from; several labels of an id count as their mean; a table without
labels gives every text 0.5; repeated rows score alike; texts of any length are scored whole, one at a time; of an id's
different texts the smallest is learned from; extra columns are passed through by ``score``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import fresh, materialise

SHAPE_SALT = 0x9E3779B97F4A7C15
PAIR_SALT = 0xC2B2AE3D27D4EB4F
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.001, 0.01


def _kind(c: str) -> str:
    return "0" if c.isdigit() else ("A" if c != c.lower() else "a") if c.isalpha() else c


@lru_cache(maxsize=1 << 17)
def _word(word: str) -> tuple[int, int]:
    """Hash of a word and of its shape."""
    shape: list[str] = []
    for c in map(_kind, word):
        if not shape or shape[-1] != c:
            shape.append(c)
    return xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest("".join(shape), 1)


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the text's features, each place once; the last place, ``2 ** bits``, is the bias."""
    pairs = [_word(w) for w in (text or "").split()]
    bias = 1 << bits
    if not pairs:
        return np.array([bias]), np.array([1.0])
    own, shape = np.array(pairs, np.uint64).T
    shift, salt = np.uint64(64 - bits), np.uint64(PAIR_SALT)
    same = own[1:] == own[:-1]
    words = np.concatenate([own, (own[:-1] * salt) ^ own[1:]])
    shapes = np.concatenate([shape, ((shape[:-1] * salt) ^ shape[1:]) + same.astype(np.uint64)])
    at = np.unique((words * np.uint64(SHAPE_SALT)) >> shift).astype(np.int64)
    kinds, count = np.unique((shapes * np.uint64(SHAPE_SALT)) >> shift, return_counts=True)
    kinds, share = kinds.astype(np.int64), count / np.sqrt(np.dot(count, count))
    said = np.full(len(at), 1 / math.sqrt(len(at)))
    # a word and a shape may fall on one place: its value is their sum
    where = np.minimum(np.searchsorted(at, kinds), len(at) - 1)
    both = at[where] == kinds
    said[where[both]] += share[both]
    return np.r_[at, kinds[~both], bias], np.r_[said, share[~both], 1.0]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows in their order."""
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for at, x, label in rows:
            w = weights(at)
            g = (_sigmoid(float(w @ x)) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size))


def in_held_out(id_col: Column) -> Column:
    """One fifth of the ids, by CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    bits: int = 18, max_train: int = 20000, max_bytes: int = 1 << 29, shards: int = 8, epochs: int = 5,
) -> np.ndarray:
    """The averaged weights, ``2 ** bits`` and the bias."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    there = texts.select("_doc").filter(F.col("_doc").isNotNull()).distinct()
    order = F.xxhash64(F.lit("sample"), F.col("_id"))
    sample = marked.join(there, F.col("_id") == F.col("_doc"), "left_semi").orderBy(order, "_id").limit(max_train)
    sample = materialise(sample, "sample")  # at most max_train ids: that bounds what is broadcast
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), "_id"), F.lit(shards)).cast("int")).withColumn("_order", order)
    rows = materialise(rows.withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")), "sample-texts")
    # a window over at most max_train rows of three numbers
    before = F.sum("_bytes").over(W.orderBy("_order", "_id").rowsBetween(W.unboundedPreceding, 0))
    fits = F.broadcast(rows.select("_order", "_id", "_bytes").withColumn("_sum", before).filter(F.col("_sum") <= max_bytes).select(F.col("_id").alias("_fits")))
    rows = rows.join(fits, F.col("_id") == F.col("_fits"), "left_semi")
    size = (1 << bits) + 1

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "_id"])
        w = ftrl([(*features(t, bits), y) for t, y in zip(part["_text"], part["_label"], strict=True)], size, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.r_[-1, at], "w": np.r_[1.0, w[at]] * len(part)})

    parts = rows.groupBy("_shard").applyInPandas(learn, "at long, w double").groupBy("at").agg(F.sum("w").alias("w"))
    sums, total = np.zeros(size), 1.0
    # at most 2 ** bits rows, a bound of the model and not of the data
    for at, w in parts.toPandas().itertuples(index=False):
        if at < 0:
            total = w
        else:
            sums[at] = w
    return sums / total


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability of label 1."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [*docs.columns, out]
    at = names.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            made = []
            for text in batch.column(at):
                place, x = features(text.as_py(), bits)
                made.append(_sigmoid(float(w[place] @ x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=names)

    return docs.mapInArrow(task, docs.select("*", F.lit(0.0).alias(out)).schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = in_held_out(F.col("doc_id")).alias("held_out")
    return score(docs.select("doc_id", held, "text"), weights).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score 0.3 or more, with the columns they came with."""
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (out,) = fresh(docs, "score")
    return score(docs, weights, out=out).filter(F.col(out) >= 0.3).drop(out)
