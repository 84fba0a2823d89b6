"""Which vectors are alike, block against block: the pairs of two blocks never leave the task that finds them.

A block is a row: some vectors of length one and no negative weight, in the order of their keys, as bytes. Each pair of blocks meets in one task by a
product of partitions, which reads the written blocks again and shuffles nothing. The places of a vector are dealt to WIDTH buckets; by Cauchy and Schwarz a cosine is at most the sum
over the buckets of the products of both lengths there, so one product of two narrow matrices says which pairs can be over the threshold, and the cosine is
summed for those alone. What a task hands on is a few links of each vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import BROADCAST_ROWS, materialise

#: Buckets of places.
WIDTH = 512
#: A block holds vectors of so many cells, each vector counted as so many more: at most 10,000 vectors, some 10 MB.
LOAD, EACH = 1_000_000, 100
#: Bounds of a product made at a time, vectors that are spread out at a time, and cells that are multiplied at a time.
BOUNDS, SPREAD, CELLS = 2_000_000, 64, 1_000_000
#: Pairs of a vector that are summed first; each step takes twice as many.
FIRST = 32
#: A bound of single precision is that much too low at most.
SLACK = 1e-4
#: Cosines are compared at so many digits, so that the order of a sum decides nothing.
DIGITS = 9
#: Links that a task holds before it drops what is beyond those that it tells.
HELD = 4_000_000

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # at, ends of the cells (one more than at), places, weights


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at").combine_chunks()
    places, weights = rows["place"].combine_chunks(), rows["weight"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())]).astype(np.int32)
    parts = {"at": rows["at"].to_numpy().astype(np.int64), "ends": ends, "places": places.flatten().to_numpy().astype(np.int32), "weights": weights.flatten().to_numpy().astype(np.float64)}
    least, most = parts["at"][0], parts["at"][-1]
    return pa.table({**{k: pa.array([v], pa.int64()) for k, v in (("b", rows["b"][0].as_py()), ("lo", least), ("hi", most))}, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}})


def packed(vectors: DataFrame) -> DataFrame:
    """vectors: (b, at, vector). A written row for each block, each in a file of its own, so that they spread over tasks."""
    rows = vectors.select("b", "at", F.col("vector.place").alias("place"), F.col("vector.weight").alias("weight"))
    return materialise(rows.groupBy("b").applyInArrow(_packed, "b long, lo long, hi long, at binary, ends binary, places binary, weights binary"), "blocks", rows_per_file=1)


def _bucketed(block: Block) -> np.ndarray:
    """The length of each vector in each bucket."""
    at, ends, places, weights = block
    rows = np.repeat(np.arange(len(at)), np.diff(ends))
    return np.sqrt(np.bincount(rows * WIDTH + places % WIDTH, weights * weights, len(at) * WIDTH)).reshape(len(at), WIDTH).astype(np.float32)


def _without(block: Block, gone: np.ndarray) -> Block:
    at, ends, places, weights = block
    which = ~np.isin(at, gone)
    cells = np.repeat(which, np.diff(ends))
    return at[which], np.concatenate([[0], np.cumsum(np.diff(ends)[which])]), places[cells], weights[cells]


def _cosines(i: np.ndarray, j: np.ndarray, spread: np.ndarray, block: Block) -> np.ndarray:
    """Of the rows i of ``spread`` with the vectors j of the block."""
    _, ends, places, weights = block
    out = np.zeros(len(i))
    sizes = (ends[1:] - ends[:-1])[j]
    pieces = np.flatnonzero(np.diff(np.cumsum(sizes) // CELLS, prepend=0)) if len(j) else []
    for s, e in zip([0, *pieces], [*pieces, len(i)], strict=True):
        if e > s:
            n = sizes[s:e].astype(np.int64)
            first = np.cumsum(n) - n
            cell = np.repeat(ends[j[s:e]] - first, n) + np.arange(first[-1] + n[-1])
            out[s:e] = np.add.reduceat(spread[np.repeat(i[s:e], n), places[cell]] * weights[cell], first)
    return out


def alike(later: Block, earlier: Block, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, cut): for each vector of ``later`` those of ``earlier`` that stand before it and are over the threshold, the first ``most`` at least; and
    the vectors that have more."""
    at, ends, places, weights = later
    xs, ys, cut = [], [], []
    if not len(at) or not len(earlier[0]):
        return (np.zeros(0, np.int64),) * 3
    one, other = _bucketed(later), _bucketed(earlier).T
    before = np.searchsorted(earlier[0], at)  # so many stand before it
    spread = np.zeros((SPREAD, int(max(places.max(), earlier[2].max())) + 1))
    rows = max(1, BOUNDS // other.shape[1] // SPREAD) * SPREAD
    for top in range(0, len(at), rows):
        all_i, all_j = np.nonzero(one[top : top + rows] @ other > threshold - SLACK)
        all_i += top
        some = all_j < before[all_i]
        all_i, all_j = all_i[some], all_j[some]
        for start in range(top, min(top + rows, len(at)), SPREAD):
            end = min(start + SPREAD, len(at))
            of = slice(*np.searchsorted(all_i, [start, end]))
            i, j = all_i[of] - start, all_j[of]
            if not len(i):
                continue
            cells = slice(ends[start], ends[end])
            row = np.repeat(np.arange(end - start), np.diff(ends[start : end + 1]))
            spread[row, places[cells]] = weights[cells]
            found, width = np.zeros(end - start, np.int64), FIRST
            while len(i):
                turn = np.arange(len(i)) - np.searchsorted(i, i)
                now = turn < width
                over = np.round(_cosines(i[now], j[now], spread, earlier), DIGITS) > threshold
                x, y = i[now][over], j[now][over]
                xs.append(at[x + start])
                ys.append(earlier[0][y])
                found += np.bincount(x, minlength=len(found))
                rest, width = ~now & (found[i] < most), 2 * width
                cut.append(at[np.unique(i[~now & ~rest]) + start])
                i, j = i[rest], j[rest]
            spread[row, places[cells]] = 0.0
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys]), np.concatenate([none, *cut])


def _first(x: np.ndarray, y: np.ndarray, cut: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` links of each x, the earliest."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    turn = np.arange(len(x)) - np.searchsorted(x, x)
    return x[turn < most], y[turn < most], np.unique(np.concatenate([cut, x[turn >= most]]))


def _meeting(threshold: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batch: pa.RecordBatch, k: int, prefix: str) -> Block:
        kinds = {"at": np.int64, "ends": np.int32, "places": np.int32, "weights": np.float64}
        return tuple(np.frombuffer(batch.column(prefix + n)[k].as_buffer(), t) for n, t in kinds.items())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64),) * 3]
        for batch in batches:
            for k in range(batch.num_rows):
                earlier, gone = read(batch, k, "_"), batch.column("gone")[k].values
                held.append(alike(read(batch, k, ""), earlier if gone is None else _without(earlier, gone.to_numpy(zero_copy_only=False)), threshold, most))
                if sum(len(x) for x, _, _ in held) > HELD:
                    held = [_first(*map(np.concatenate, zip(*held, strict=True)), most)]
        x, y, cut = _first(*map(np.concatenate, zip(*held, strict=True)), most)
        who = np.unique(np.concatenate([x, cut]))
        ends = np.append(np.searchsorted(x, who), len(x)).astype(np.int32)
        yield pa.record_batch([pa.array(who, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(y, pa.int64())), pa.array(np.isin(who, cut))], names=["key", "earlier", "cut"])

    return meet


def links(later: DataFrame, earlier: DataFrame, gone: DataFrame | None, threshold: float, most: int) -> DataFrame:
    """(key, earlier, cut): for the vectors of the blocks ``later`` up to ``most`` that stand before them in the blocks ``earlier``, are not ``gone`` (b, at; a written table) and over the threshold, and whether there may be
    others. Vectors without any have no row. The table is written."""
    if gone is None:
        earlier = earlier.withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        listed = gone.groupBy(F.col("b").alias("_of")).agg(F.collect_list("at").alias("gone"))
        earlier = earlier.join(F.broadcast(listed) if gone.count() <= BROADCAST_ROWS else listed, F.col("b") == F.col("_of"), "left").drop("_of")
    earlier = earlier.select("gone", *[F.col(c).alias(f"_{c}") for c in earlier.columns if c != "gone"]).hint("shuffle_replicate_nl")
    met = later.join(earlier, F.col("_lo") < F.col("hi")).drop("b", "_b", "lo", "hi", "_lo", "_hi")
    told = met.mapInArrow(_meeting(threshold, most), "key long, earlier array<bigint>, cut boolean")
    told = told.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("earlier"))).alias("all"), F.bool_or("cut").alias("cut"))
    return materialise(told.select("key", F.slice("all", 1, most).alias("earlier"), (F.col("cut") | (F.size("all") > most)).alias("cut")), "told-links")
