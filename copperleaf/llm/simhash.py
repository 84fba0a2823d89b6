"""SimHash near-duplicates by a self-join of binary tries of fingerprints.

Fingerprints that differ in at most ``budget`` bits agree in full on one of ``budget + 1`` blocks
of bits. So each distinct fingerprint goes into budget + 1 tries, one for each block turned to the
front, and only tries below the same first block need to be joined with themselves. Such a trie is
a run of sorted numbers: a node is a range of it. The join walks pairs of nodes from the top,
jumps to the next bit where either node branches, adds the bits that differ on the way, and drops
a pair as soon as the sum exceeds the budget. Ranges with more than ``max_group`` fingerprints are
dealt out once more, and again, by blocks of their remaining bits, so that a crowd of similar
fingerprints is spread over tasks too. Every group returns a spanning forest of its links, at most
one edge per fingerprint, which keeps all components.

Defined results: null or empty text has fingerprint 0, linked like any other; a null id is never
a component's name (null if a component has no other); rows that repeat an id are all returned, and are
linked by their fingerprints like any others; a text of any length is taken whole, in pieces of shingles; an
empty table gives an empty table; columns other than id and text are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, fresh, join_counted, materialise
from copperleaf.llm.components import connected_components

BITS = 64
SEED = 42
#: Pairs of trie nodes that are looked at together; bounds a task's memory.
FRONTIER = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of the bits of the shingles' XXH64, as a signed 64-bit number."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = (digest(join(w[i : i + width]), SEED) for i in range(n))
    ones, seen = np.zeros(BITS, np.int64), 0
    while seen < n:  # a long text in pieces
        part = np.fromiter(hashes, "<u8", min(1 << 16, n - seen))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        seen += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, copy) of each row; copy is a hash of the text that tells different texts of one id apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py(), width) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(1)], ["id", "fp", "copy"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("copy"), F.col(text_col).alias("text"))
    return slim.mapInArrow(task, "id long, fp long, copy long")


def text_hash(text_col: str):
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def _branch(lo: np.ndarray, hi: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The bit, from the front, at which each range branches; 64 for a single leaf."""
    x = path[lo] ^ path[hi - 1]
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return BITS - np.bitwise_count(x).astype(np.int64)


def _below(bit: np.ndarray) -> np.ndarray:
    """All bits from ``bit`` on, from the front; none at 64."""
    return np.where(bit >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(bit, BITS - 1).astype(np.uint64))


def _middle(lo: np.ndarray, at: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Where the upper child of each range starts that branches at bit ``at``."""
    bound = (path[lo] & ~_below(at)) | (np.uint64(1) << (BITS - 1 - at).astype(np.uint64))
    return np.searchsorted(path, bound)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the leaf pairs; a label is the smallest leaf of its part."""
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (differ := low < high).any():
            return root
        root = root.copy()
        np.minimum.at(root, high[differ], low[differ])
        while (root != (up := root[root])).any():
            root = up


def trie_links(path: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: np.ndarray, budget: int) -> np.ndarray:
    """For each leaf the smallest leaf that links lead to, within the given ranges.

    path: sorted unsigned numbers in each range, all ranges in order; depth: the bits that the
    numbers of a range have in common. Both ends of a pair of nodes are ranges of ``path``.
    """
    root = np.arange(len(path))
    zero = np.zeros(len(starts), np.int64)
    stack = [(starts, ends, starts, ends, depth, zero)]
    while stack:
        al, ah, bl, bh, k, d = stack.pop()
        if len(al) > FRONTIER:
            cut = len(al) // 2
            stack += [tuple(x[:cut] for x in (al, ah, bl, bh, k, d)), tuple(x[cut:] for x in (al, ah, bl, bh, k, d))]
            continue
        ka, kb = _branch(al, ah, path), _branch(bl, bh, path)
        m = np.minimum(ka, kb)
        d = d + np.bitwise_count((path[al] ^ path[bl]) & _below(k) & ~_below(m))
        within = d <= budget
        leaf = within & (m == BITS) & (al != bl)
        root = _unite(root, al[leaf], bl[leaf])
        on = within & (m < BITS)
        al, ah, bl, bh, m, d, ka, kb = (x[on] for x in (al, ah, bl, bh, m, d, ka, kb))
        if not len(al):
            continue
        same = al == bl
        am, bm = np.where(ka == m, _at(al, m, ka, path), ah), np.where(kb == m, _at(bl, m, kb, path), bh)
        sides_a = [(al, am, am > al), (am, ah, ka == m)]
        sides_b = [(bl, bm, bm > bl), (bm, bh, kb == m)]
        new = []
        for i, (x0, x1, xs) in enumerate(sides_a):
            for j, (y0, y1, ys) in enumerate(sides_b):
                take = xs & ys & ~(same & (i > j))  # of a node with itself, each pair of children once
                new.append([z[take] for z in (x0, x1, y0, y1, m, d)])
        stack.append(tuple(np.concatenate(z) for z in zip(*new, strict=True)))
    return root


def _at(lo: np.ndarray, m: np.ndarray, own: np.ndarray, path: np.ndarray) -> np.ndarray:
    return _middle(lo, np.where(own == m, m, BITS - 1), path)


def _turned(value, shift: int, width: int, low: int):
    """The ``low`` last bits of a number turned left by ``shift``; the bits before them stay."""
    mask = (1 << low) - 1
    tail = value.bitwiseAND(F.lit(mask if low < BITS else -1))
    turned = F.shiftleft(tail, shift).bitwiseOR(F.shiftrightunsigned(tail, low - shift)) if shift else tail
    return turned if low == BITS else value.bitwiseAND(F.lit(~mask)).bitwiseOR(turned.bitwiseAND(F.lit(mask)))


def _dealt(rows: DataFrame, depth: int, parts: int) -> DataFrame:
    """Each row once for each block of the bits after ``depth``, that block turned to the front."""
    low = BITS - depth
    width = low // parts
    turns = F.array(*[F.struct((F.col("tag") * (parts + 1) + i + 1).alias("tag"), _turned(F.col("path"), i * width, width, low).alias("path")) for i in range(parts)])
    return rows.select("fp", F.explode(turns).alias("t")).select("fp", "t.tag", "t.path", F.lit(depth + width).alias("depth"))


def _prefix(depth: int):
    return F.shiftrightunsigned("path", BITS - depth)


def _depths(parts: int, rounds: int = 2) -> list[int]:
    """The bits at the front that agree after each of the first dealings, while enough are left for another."""
    out: list[int] = []
    while len(out) < rounds:
        at = out[-1] if out else 0
        out.append(at + (BITS - at) // parts)
        if BITS - out[-1] < parts:
            return out[:-1]
    return out


def spanning_links(fps: DataFrame, budget: int = 3, max_group: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep all components at ``budget`` bits."""
    rows = _dealt(fps.select("fp", F.lit(0).cast("long").alias("tag"), F.col("fp").alias("path")), 0, budget + 1)
    ready = []
    for depth in _depths(budget + 1):
        sizes = rows.groupBy("tag", _prefix(depth).alias("prefix")).agg(F.count("*").alias("n")).filter(F.col("n") > max_group)
        large = sizes.select(F.col("tag").alias("t"), F.col("prefix").alias("p"))
        on = (F.col("tag") == F.col("t")) & (_prefix(depth) == F.col("p"))
        ready.append(rows.join(large, on, "left_anti"))
        rows = _dealt(rows.join(large, on, "left_semi"), depth, budget + 1)
    ready.append(rows)
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.withColumn("prefix", F.expr(f"shiftrightunsigned(path, {BITS} - depth)"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            got = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            got = np.concatenate([*held, got], axis=1)
            changes = np.flatnonzero((got[1:4, 1:] != got[1:4, :-1]).any(axis=0)) + 1
            cut = int(changes[-1]) if len(changes) else 0
            held = [got[:, cut:]]  # the last group may go on in the next batch
            if cut:
                yield _group_links(got[:, :cut], budget)
        if held and held[0].shape[1]:
            yield _group_links(held[0], budget)

    ordered = dealt.select("fp", "tag", "prefix", F.col("depth").cast("long").alias("depth"), "path").repartition("tag", "prefix").sortWithinPartitions("tag", "prefix", "depth", "path")
    return ordered.mapInArrow(task, "a long, b long")


def _group_links(rows: np.ndarray, budget: int) -> pa.RecordBatch:
    """rows: fp, tag, prefix, depth, path, by group and path; a tag has one depth."""
    fp, path = rows[0], rows[4].view(np.uint64)
    a, b = [], []
    turns = np.flatnonzero(np.r_[True, rows[1, 1:] != rows[1, :-1]])
    for lo, hi in zip(turns, np.r_[turns[1:], rows.shape[1]], strict=True):  # below one turn all ranges are in order
        starts = np.flatnonzero(np.r_[True, rows[2, lo + 1 : hi] != rows[2, lo : hi - 1]])
        ends = np.r_[starts[1:], hi - lo]
        several = ends - starts > 1
        root = trie_links(path[lo:hi], starts[several], ends[several], rows[3, lo:hi][starts[several]], budget)
        linked = np.flatnonzero(root != np.arange(hi - lo))
        a.append(fp[lo:hi][linked])
        b.append(fp[lo:hi][root[linked]])
    flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([flat(a), flat(b)], ["a", "b"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_group: int = 4096) -> DataFrame:
    """(id, fp, copy, component, root): each row's fingerprint, the smallest id that links reach from it, and the
    smallest fingerprint that they reach, which names the component also where no row has an id."""
    fps = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = materialise(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "first-of-fingerprint")
    found = connected_components(spanning_links(first.select("fp"), budget, max_group))
    found = found.join(first, found["node"] == first["fp"]).select("node", "root", "first")
    names = found.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component"), F.count("*").alias("nodes"))
    named = join_counted(found, "root", materialise(names, "components"), "_root", "nodes").select(F.col("node").alias("_node"), "root", "component")
    every = first.join(named, F.col("fp") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), "rows", F.coalesce("component", "first").alias("component"), F.coalesce("root", "fp").alias("root"))
    return join_counted(fps, "fp", materialise(every, "named-fingerprints"), "_fp", "rows").select("id", "fp", "copy", "component", "root")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, that with the smallest id and hash of the text; rows without an
    id come last. Rows that repeat both leave one row, the smallest by a hash of all their columns.
    """
    rows = materialise(simhash_components(docs).withColumn("place", F.struct(F.col("id").isNull().alias("none"), "id", "copy")).select("root", "place"), "placed")
    least = rows.groupBy(F.col("root").alias("_root")).agg(F.min("place").alias("best"), F.count("*").alias("rows"))
    told = join_counted(rows, "root", materialise(least, "best-of-component"), "_root", "rows")
    ident, copy = fresh(docs, "_copy_id", "_copy_hash")
    same = (text_hash("text") == F.col(copy)) & F.col("doc_id").cast("long").eqNullSafe(F.col(ident))

    def known(some: DataFrame, name: str) -> DataFrame:
        return broadcast_if_small(materialise(some.select(F.col("place.id").alias(ident), F.col("place.copy").alias(copy)), name))

    losers = known(told.filter("place <> best").select("place").distinct(), "copies")
    repeated = known(rows.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    kept = docs.join(losers, same, "left_anti")
    once, several = kept.join(repeated, same, "left_anti"), kept.join(repeated, same)
    return once.unionByName(one_of(several, [ident, copy], docs.columns))


def one_of(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of each key the smallest by a hash of its columns as JSON; columns of any type."""
    (row,) = fresh(rows, "_row")
    every = F.struct(*columns)
    return rows.groupBy(*keys).agg(F.min_by(every, F.sha2(F.to_json(every), 256)).alias(row)).select(*[F.col(row)[c].alias(c) for c in columns])
