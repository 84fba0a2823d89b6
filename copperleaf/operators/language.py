"""Language told by runs of letters, learned from labelled texts: counts per language in one aggregation, scored as a sum of log shares.

A text is put in lower case, everything but letters becomes one space, and its runs of one to LONGEST signs are counted. A language's share of
a run is (count + 1) / (all its runs + runs known); what is known are the ``most`` commonest runs of each language, so the model is of a bounded
size and is broadcast. A text is of the language whose logarithms of shares have the highest sum; empty if no run of it is known, or no language is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from copperleaf.cluster import materialise

LONGEST = 3
#: Signs of texts that are cut up at once, cells of a table by runs, and counts that a task holds.
SIGNS, CELLS, HELD = 1 << 20, 1 << 22, 200_000


def flat(text: str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct code, the number of each code among the distinct ones)."""
    most = int(codes.max(initial=-1)) + 1
    if most > CELLS:
        _, first, number = np.unique(codes, return_index=True, return_inverse=True)
        return first, number
    place = np.full(most, -1)
    place[codes] = np.arange(len(codes))
    there = place >= 0
    return place[there], (np.cumsum(there) - 1)[codes]


def _runs(texts: list[str], longest: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each length (its distinct runs, the run and the text of each place): all runs of texts of three signs or more but a single space."""
    joined = "".join(texts)
    signs = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) if len(t) >= 3 else 0 for t in texts])
    _, letter = _ranked(signs)
    base, code = int(letter.max(initial=0)) + 1, letter
    for k in range(1, longest + 1):
        if k > 1:
            code = code[:-1] * base + letter[k - 1 :]
        first, code = _ranked(code)
        inside = owner[: len(code)] == owner[k - 1 :]
        runs = [joined[i : i + k] for i in first.tolist()]
        if k == 1:
            inside = signs != ord(" ")
        yield runs, code[inside], owner[: len(code)][inside]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The batch's first column and texts of some SIGNS together; texts too short to be told are empty."""
    keys, texts, n = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        text = text.as_py()
        keys.append(key.as_py())
        texts.append(text if len(text) >= 3 else "")
        n += len(text)
        if n >= SIGNS:
            yield keys, texts
            keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def run_counts(texts: DataFrame, key: str, text: str, longest: int = LONGEST) -> DataFrame:
    """(key, run, n), ``key`` a string of few values: a task counts where the texts lie and hands on its counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([r for _, r in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["key", "run", "n"])

        for batch in batches:
            for keys, said in _pieces(batch):
                names = list(dict.fromkeys(keys))
                at = np.array([names.index(k) for k in keys])
                for runs, code, owner in _runs(said, longest):
                    counts = np.bincount(at[owner] * len(runs) + code, minlength=len(names) * len(runs))
                    for i in np.flatnonzero(counts).tolist():
                        cell = (names[i // len(runs)], runs[i % len(runs)])
                        held[cell] = held.get(cell, 0) + int(counts[i])
                if len(held) > HELD:
                    yield made()
                    held.clear()
        if held:
            yield made()

    return texts.select(F.col(key).cast("string"), flat(text)).mapInArrow(count, "key string, run string, n long").groupBy("key", "run").agg(F.sum("n").alias("n"))


def language_model(labelled: DataFrame, text: str, lang: str, most: int = 2000, longest: int = LONGEST) -> DataFrame:
    """(run, lang, share): the logarithm of a language's share of each known run; a written table of at most languages^2 x ``most`` rows."""
    counts = materialise(run_counts(labelled.filter(F.col(lang).isNotNull()), lang, text, longest).withColumnRenamed("key", "lang"), "run-counts")
    common = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "run"))).filter(F.col("place") <= most).select("run").distinct()
    common = materialise(common, "known-runs")
    known = counts.join(F.broadcast(common), "run")
    totals = known.groupBy("lang").agg(F.sum("n").alias("total"))
    size = common.count()
    cells = common.crossJoin(F.broadcast(totals)).join(known.select("run", "lang", "n"), ["run", "lang"], "left")  # known runs by languages
    return materialise(cells.select("run", "lang", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + size)).alias("share")), "language-model")


def _summed(known: dict[str, int], shares: np.ndarray, longest: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text the sum of shares by language, null where no run of it is known."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, said in _pieces(batch):
                sums, met = np.zeros((shares.shape[1], len(said))), np.zeros(len(said), bool)
                for runs, code, owner in _runs(said, longest):
                    place = np.array([known.get(r, -1) for r in runs], np.int64)[code] if runs else code
                    hit = place >= 0
                    place, owner = place[hit], owner[hit]
                    met[owner] = True
                    for i in range(shares.shape[1]):
                        sums[i] += np.bincount(owner, shares[place, i], len(said))
                made = [s if m else None for s, m in zip(sums.T.tolist(), met.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return task


def with_language(texts: DataFrame, key: str, text: str, model: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, language) of each text. Texts are summed where they lie and nothing is shuffled; the model, which is of a bounded size, goes to every task."""
    cells = model.collect()  # at most languages^2 x most
    langs, runs = sorted({r["lang"] for r in cells}), sorted({r["run"] for r in cells})
    if not cells:
        return texts.select(F.col(key).alias(key), F.lit("").alias("language"))
    known, at = {r: i for i, r in enumerate(runs)}, {x: i for i, x in enumerate(langs)}
    shares = np.zeros((len(runs), len(langs)))
    for r in cells:
        shares[known[r["run"]], at[r["lang"]]] = r["share"]
    rows = texts.select(F.col(key).alias("key"), flat(text).alias("flat"))
    kind = rows.schema["key"].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("sums", pa.list_(pa.float64()))])
    sums = rows.mapInArrow(_summed(known, shares, longest, schema), T.StructType([T.StructField("key", kind), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    best = F.array_max(F.transform("sums", lambda s, i: F.struct(F.round(s, 6), F.get(F.array(*map(F.lit, langs)), i).alias("lang"))))
    return sums.select(F.col("key").alias(key), F.coalesce(best["lang"], F.lit("")).alias("language"))
