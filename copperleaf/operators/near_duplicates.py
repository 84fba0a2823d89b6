"""Near-duplicate texts by TF-IDF cosine, first come first kept.

A text falls if an earlier text that is itself kept is more than ``threshold`` like it; fallen texts are no anchors. The vectors
are those of words of two and more signs, the ``max_features`` commonest of them, without stop words: count times
ln((1 + n) / (1 + df)) + 1, scaled to length one. Blank texts take no part.

Equal vectors are one text. What could drop a text is shown to it in rounds: a text that has seen all that could drop it is kept once those it is like have
fallen, and falls once one of them is kept. Each round shows WIDER times as many, so the rounds grow as the logarithm of what is to be shown.

Up to JOINED texts are joined by their words. The words of a text are put in the order of the rarest first, and the least
run of them beyond which the rest is shorter than the threshold is its prefix; texts over the threshold share a word of their
prefixes. Where two texts first meet, their cosine is at most the product of the two weights there and that of the lengths of the two
rests behind it; only pairs for which that is over the threshold are compared. In a round every word's list shows its first ``heads``
undecided texts, and each text is compared with those before it; families fall in the first rounds. A text
that is within the heads of all its lists has seen all that could drop it.

More texts meet as blocks (``alike_blocks``): such a join writes pairs that grow with the square of the texts, blocks write what a text is told, a ``heads``/WIDER-th part
at first. Time still grows with the square, since nearly all texts stay and each must be seen beside all before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, materialise
from copperleaf.functions.text import once
from copperleaf.operators import alike_blocks
from copperleaf.operators.alike_blocks import DIGITS
from copperleaf.operators.ranking import running

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Common English words that say little; give another list where it matters.
STOP_WORDS = (
    "about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once only or other our out over own "
    "same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
#: Cosines are compared at DIGITS; a prefix leaves so much room.
ROOM = 1e-7
#: Each round shows so many times as many texts of a list as the one before.
WIDER = 8
#: So many texts at most are joined by their words.
JOINED = 4096
#: So many links at most are walked by one task: two keys each.
FOLDED = 200_000


def _said(batch: pa.RecordBatch, stop_words: set[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a batch of lists of words, and (row, term, tf) in the order of rows and terms."""
    words = batch.column("words")
    coded = words.flatten().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
    codes = coded.indices.to_numpy()
    real = np.array([t not in stop_words for t in terms], bool)[codes] if terms else np.zeros(0, bool)
    cells, tf = np.unique(rows[real].astype(np.int64) * max(1, len(terms)) + codes[real], return_counts=True)
    return terms, cells // max(1, len(terms)), cells % max(1, len(terms)), tf


def term_counts(words: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """words: (key, words). (term, tf, df): how often a term is said, and in how many texts; a term has a row for each batch that it is in."""
    stop = set(stop_words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, _, codes, tf = _said(batch, stop)
            df = np.bincount(codes, minlength=len(terms))
            there = np.flatnonzero(df)
            yield pa.record_batch([pa.array(terms, pa.string()).take(pa.array(there)), pa.array(np.bincount(codes, tf, len(terms)).astype(np.int64)[there]), pa.array(df[there])], names=["term", "tf", "df"])

    return words.select("words").mapInArrow(counted, "term string, tf long, df long")


def vocabulary(counts: DataFrame, n: int, max_features: int) -> DataFrame:
    """(term, place, idf): the commonest terms, numbered from the rarest on; at most ``max_features`` rows, in a written table."""
    found = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    best = found.orderBy(F.col("total").desc(), "term").limit(max_features)
    place = F.row_number().over(W.orderBy("df", "term"))  # over max_features rows at most
    return materialise(best.select("term", place.alias("place"), (F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1).alias("idf")), "vocabulary")


def _celled(places: dict[str, tuple[int, float]], stop_words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    stop = set(stop_words)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, rows, codes, tf = _said(batch, stop)
            place, idf = (np.array([places.get(t, (0, 0.0))[k] for t in terms], kind) for k, kind in ((0, np.int32), (1, np.float64)))
            known = place[codes] > 0 if terms else np.zeros(0, bool)
            rows, codes, tf = rows[known], codes[known], tf[known]
            order = np.lexsort((place[codes], rows))
            rows, codes, tf = rows[order], codes[order], tf[order]
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(place[codes], pa.int32()), pa.array(tf * idf[codes], pa.float64())], names=["place", "weight"])
            yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), cells)], names=["key", "cells"])

    return celled


def tfidf_vectors(texts: DataFrame, key: str, text: str, max_features: int = 10_000, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, vector): (place, weight) of each term, the rarest first; texts without a term of the vocabulary have no row.

    A text's terms are counted where it lies, once for the vocabulary and once for its vector; the vocabulary passes the driver to every task."""
    some = texts.filter(F.col(text).rlike(r"\S")).select(key, text)
    words = some.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({TOKEN})")).alias("words"))
    terms = vocabulary(term_counts(words, stop_words), some.count(), max_features).collect()
    rows = words.mapInArrow(_celled({t: (place, idf) for t, place, idf in terms}, stop_words), f"key {words.schema['key'].dataType.simpleString()}, cells array<struct<place:int,weight:double>>").filter(F.size("cells") > 0)
    length = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
    # bound by once: a column made before would be put into the function, and so be summed again for each term
    scaled = once(length, lambda n: F.transform("cells", lambda x: F.struct(x["place"].alias("place"), (x["weight"] / n).alias("weight"))))
    return rows.select("key", scaled.alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of length one: equal places stand side by side once both are sorted together."""
    start = F.struct(F.lit(0).alias("place"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(x["place"].alias("place"), x["weight"].alias("weight"), (s["sum"] + F.when(x["place"] == s["place"], x["weight"] * s["weight"]).otherwise(0.0)).alias("sum"))
    return F.round(F.aggregate(F.sort_array(F.concat(a, b)), start, step)["sum"], DIGITS)


def prefix(vector: Column, threshold: float) -> Column:
    """The first terms, up to where the rest is too short to reach the threshold alone: place, weight, and the length of what stands behind the term."""
    none = F.array().cast("array<struct<place:int,weight:double,rest:double>>")
    start = F.struct(F.lit(0.0).alias("seen"), none.alias("cells"))
    least = threshold * threshold - ROOM

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["weight"] * x["weight"]
        cell = F.struct(x["place"].alias("place"), x["weight"].alias("weight"), F.sqrt(F.greatest(F.lit(0.0), 1 - seen)).alias("rest"))
        return F.struct(seen.alias("seen"), F.when(1 - s["seen"] >= least, F.array_append(s["cells"], cell)).otherwise(s["cells"]).alias("cells"))

    return F.aggregate(vector, start, step)["cells"]


def _heads(lists: DataFrame, heads: int) -> DataFrame:
    """The first keys of each list."""
    at = F.row_number().over(W.partitionBy("place").orderBy("key"))
    return lists.withColumn("at", at).filter(F.col("at") <= heads).select(F.col("place").alias("_place"), F.col("key").alias("head"), F.col("weight").alias("_weight"), F.col("rest").alias("_rest"), "at")


def _met(lists: DataFrame, shown: DataFrame, threshold: float) -> DataFrame:
    """(key, head): pairs that can be over the threshold, by the first term that they share."""
    bound = F.col("weight") * F.col("_weight") + F.col("rest") * F.col("_rest")
    return lists.join(shown, (F.col("place") == F.col("_place")) & (F.col("head") < F.col("key")) & (bound > threshold - ROOM)).select("key", "head").distinct()


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """(key, fell, open) of all keys of the links, in their order."""
    certain = dict(zip(rows["earlier"], rows["_certain"], strict=True)) | dict(zip(rows["key"], rows["certain"], strict=True))
    anchors: dict[object, list[object]] = {}
    for key, earlier in zip(rows["key"], rows["earlier"], strict=True):
        anchors.setdefault(key, []).append(earlier)
    kept, fell = set(), set()
    for key in sorted(certain):
        if any(a in kept for a in anchors.get(key, [])):
            fell.add(key)
        elif certain[key] and all(a in fell for a in anchors.get(key, [])):
            kept.add(key)
    keys = list(certain)
    return pd.DataFrame({"key": keys, "fell": [k in fell for k in keys], "open": [k not in fell and k not in kept for k in keys]})


def _walked(undecided: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``_settle`` gives, by one task over so few links."""
    own, other = undecided.select(F.col("key").alias("_k"), "certain"), undecided.select(F.col("key").alias("_e"), F.col("certain").alias("_certain"))
    rows = links.join(own, F.col("key") == F.col("_k")).join(other, F.col("earlier") == F.col("_e")).select("key", "earlier", "certain", "_certain")
    told = materialise(rows.groupBy().applyInPandas(_walk, f"key {rows.schema['key'].dataType.simpleString()}, fell boolean, open boolean"), "walked")
    done = undecided.join(told.select(F.col("key").alias("_k"), "open"), F.col("key") == F.col("_k"), "left")
    return told.filter("fell").select("key"), materialise(done.filter(F.coalesce("open", ~F.col("certain"))).select("key", "certain"), "undecided")


def _settle(undecided: DataFrame, links: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The fallen and the still undecided of ``undecided`` (key, certain), by the links (key, earlier) that are known. Once there are few links, one task
    walks them, since a chain of links would need a round for every other one."""
    fallen = None
    while True:
        if links.count() <= FOLDED:
            drops, undecided = _walked(undecided, links)
            return drops if fallen is None else fallen.unionByName(drops), undecided
        held = links.select(F.col("key").alias("_key")).distinct()
        kept = materialise(undecided.filter("certain").join(held, F.col("key") == F.col("_key"), "left_anti").select("key"), "kept")
        if kept.isEmpty():
            return fallen, undecided
        drops = links.join(kept.withColumnRenamed("key", "_kept"), F.col("earlier") == F.col("_kept")).select("key").distinct()
        drops = materialise(drops, "fallen")
        fallen = drops if fallen is None else fallen.unionByName(drops)
        gone = kept.unionByName(drops).withColumnRenamed("key", "_gone")
        undecided = materialise(undecided.join(gone, F.col("key") == F.col("_gone"), "left_anti"), "undecided")
        links = links.join(gone, F.col("key") == F.col("_gone"), "left_anti").join(gone, F.col("earlier") == F.col("_gone"), "left_anti")
        links = materialise(links, "links")


def _joined(vectors: DataFrame, threshold: float, heads: int) -> DataFrame:
    """(key): the fallen of a few different vectors, by joins over their words."""
    only = materialise(vectors.withColumn("places", prefix(F.col("vector"), threshold)), "distinct-vectors")
    fallen, undecided = only.select("key").filter(F.lit(False)), only.select("key")
    while True:
        lists = materialise(only.join(undecided.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_semi").select("key", F.inline("places")), "lists")
        if lists.isEmpty():
            return fallen
        shown = materialise(_heads(lists, heads), "heads")
        met = _met(lists, shown, threshold)
        one, other = only.select(F.col("key").alias("_a"), F.col("vector").alias("va")), only.select(F.col("key").alias("_b"), F.col("vector").alias("vb"))
        alike = met.join(one, F.col("key") == F.col("_a")).join(other, F.col("head") == F.col("_b")).filter(cosine(F.col("va"), F.col("vb")) > threshold)
        links = materialise(alike.select("key", F.col("head").alias("earlier")), "links")
        last = shown.filter(F.col("at") == heads).select("_place", F.col("head").alias("_last"))
        seen = lists.join(last, F.col("place") == F.col("_place"), "left").groupBy("key").agg(F.bool_and(F.col("_last").isNull() | (F.col("key") <= F.col("_last"))).alias("certain"))
        drops, left = _settle(materialise(seen, "undecided"), links)
        fallen, undecided = fallen.unionByName(drops) if drops is not None else fallen, left.select("key")
        heads *= WIDER


def _in_blocks(vectors: DataFrame, keys: DataFrame, threshold: float, most: int) -> DataFrame:
    """(key): the fallen of those ``keys`` of the vectors, which are different; every pair meets in one task of blocks. keys: (key, cells)."""
    load, block = F.col("cells") + alike_blocks.EACH, F.floor(F.col("load") / alike_blocks.LOAD).cast("long").alias("b")

    def packed(places: DataFrame) -> DataFrame:
        return alike_blocks.packed(vectors.join(broadcast_if_small(places), F.col("key") == F.col("_key")))

    placed = running(keys, [], [F.col("key")], {"at": F.lit(1).cast("long"), "load": load})
    placed = materialise(placed.select(F.col("key").alias("_key"), F.col("at").cast("long").alias("at"), "cells", block), "places")
    later = earlier = packed(placed)
    asks, fallen, gone = placed, None, None
    while True:
        told = alike_blocks.links(later, earlier, gone, threshold, most)
        links = materialise(told.select("key", F.explode("earlier").alias("earlier")), "links")
        cut = told.filter("cut").select(F.col("key").alias("_cut"))
        seen = asks.join(cut, F.col("at") == F.col("_cut"), "left").select(F.col("at").alias("key"), F.col("_cut").isNull().alias("certain"))
        if gone is not None:  # those that an earlier round has kept
            kept = links.select(F.col("earlier").alias("key")).distinct().join(asks.select("at"), F.col("key") == F.col("at"), "left_anti")
            seen = seen.unionByName(kept.withColumn("certain", F.lit(True)))
        drops, left = _settle(materialise(seen, "undecided"), links)
        if drops is not None:
            fallen = drops if fallen is None else fallen.unionByName(drops)
        asks = placed.join(left.select(F.col("key").alias("_left")), F.col("at") == F.col("_left"), "left_semi")
        if left.isEmpty():
            return placed.join(fallen, F.col("at") == F.col("key"), "left_semi").select(F.col("_key").alias("key"))
        gone = materialise(placed.join(fallen, F.col("at") == F.col("key"), "left_semi").select("b", "at"), "gone") if fallen is not None else None
        asks = materialise(running(asks.select("_key", "at", "cells"), [], [F.col("at")], {"load": load}).select("_key", "at", "cells", block), "asks")
        later, most = packed(asks), most * WIDER


def near_duplicates(texts: DataFrame, key: str, text: str, threshold: float, max_features: int = 10_000, stop_words: list[str] = STOP_WORDS, heads: int = 64) -> DataFrame:
    """(key): the texts that fall. ``key`` is unique and gives the order; rows without one take no part. No cosine is above 1."""
    if threshold >= 1:
        return texts.select(key).filter(F.lit(False))
    known = texts.filter(F.col(key).isNotNull())
    vectors = materialise(tfidf_vectors(known, key, text, max_features, stop_words).withColumn("same", F.md5(F.to_json("vector"))), "vectors")
    firsts = materialise(vectors.groupBy("same").agg(F.min(F.struct("key", F.size("vector").alias("cells"))).alias("first")).select("first.*"), "firsts")
    fallen = vectors.select("key").join(firsts.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_anti")
    if firsts.count() <= JOINED:
        more = _joined(vectors.select("key", "vector").join(firsts.select(F.col("key").alias("_first")), F.col("key") == F.col("_first"), "left_semi"), threshold, heads)
    else:
        more = _in_blocks(vectors.select("key", "vector"), firsts, threshold, max(1, heads // WIDER))
    return fallen.unionByName(more).withColumnRenamed("key", key)


def without_near_duplicates(texts: DataFrame, key: str, text: str, threshold: float, **options) -> DataFrame:
    """``texts`` without those that fall."""
    fallen = near_duplicates(texts, key, text, threshold, **options).select(F.col(key).alias("_fallen"))
    return texts.join(fallen, F.col(key) == F.col("_fallen"), "left_anti")
