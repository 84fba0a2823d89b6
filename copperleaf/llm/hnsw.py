"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are merged first and stand for their number. A distinct vector is numbered by its hash, and dealt by
that to shards of at most about ``shard_rows`` vectors and ``shard_bytes`` bytes (eight at least), so that reruns and other
partitionings build the same graphs. Each shard's graph is built in one task and written as one row
of a table. Every block of queries then searches every shard: a greedy descent through the upper
layers, then a beam on the lowest. A beam is widened in two ways: for a whole block and shard until an
audit passes, and for a single query as long as all of its beam is within the threshold, so that a crowd of any size is found whole.

The audit of a block and shard is against known truth and leaves none out. It asks for ``recall`` of the links that
brute force finds for up to 512 of the block's queries, and of up to 512 planted neighbours: nodes of the shard, each turned by a
random angle to just within the threshold, so that a shard is audited on the hardest links there can be also where no
sampled query has one. What share of those queries' four nearest is found, whatever their cosine, is measured too and
returned with the rest, but asks for nothing: in random directions they are far from any link.

What is within reach by single precision is verified by cosine in double precision. A task returns the number
of links of each query, and a spanning forest of the links instead of all pairs; the
components are united over all tasks.

Searches go in lock step: numpy handles a batch of queries at a time, one step of all beams at once. A task holds one
shard and one block of queries, both bounded in rows and bytes. Each block meets each shard, so what is
shuffled is about n * n * (1 / block rows + 1 / shard rows) vectors; larger shards and blocks make it less.

Defined results: null, empty or zero vectors and those with null or non-finite components have no links;
vectors of different lengths have no links; equal vectors are linked, whatever the graph; a null id
is never a component's name, and its row is never kept; repeated rows are vectors of their own; an empty table
gives an empty table; other columns are never read, whatever their names; a vector of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import join_counted, materialise
from copperleaf.llm.components import connected_components
from copperleaf.llm.simhash import _unite

#: Neighbours of a node in the upper layers and in the lowest, and the beam while building.
M, M0, EF_BUILD = 12, 24, 48
#: Queries in lock step, nodes that each beam opens at once, queries of an audit, nearest nodes of each that it looks for.
BATCH, OPEN, AUDIT, NEAREST = 256, 4, 512, 4
#: Similarities held at once where all vectors are compared.
CELLS = 1 << 22
#: How far within the threshold an audit's neighbours are planted.
PLANTED = 1e-3
#: Margin of single precision around the threshold; what is within is verified in double.
SLACK = 1e-4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of double precision, each scaled to length 1 without overflow."""
    big = rows / np.abs(rows).max(axis=1, keepdims=True)
    return big / np.sqrt((big * big).sum(axis=1, keepdims=True))


class Graph:
    """Vectors of length 1 (single precision), layers of neighbours, and the place to enter."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    # -- searching

    def _sims(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, np.einsum("bd,bkd->bk", q, self.x[at]), -np.inf)

    def _descend(self, q: np.ndarray, layer: int, cur: np.ndarray) -> np.ndarray:
        """Greedy steps in one layer until no neighbour is nearer."""
        best = np.einsum("bd,bd->b", q, self.x[cur])
        moving = np.arange(len(q))
        while len(moving):
            near = self.layers[layer][cur[moving]]
            sims = self._sims(q[moving], near)
            k = sims.argmax(axis=1)
            top = sims[np.arange(len(moving)), k]
            up = top > best[moving]
            cur[moving[up]], best[moving[up]] = near[up, k[up]], top[up]
            moving = moving[up]
        return cur

    def beam(self, q: np.ndarray, ef: int, layer: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), ``ef`` of each query at most, the nearest first; -1 fills up."""
        n, b = len(self.x), len(q)
        if start is None:
            start = np.full(b, self.entry)
            for up in range(len(self.layers) - 1, layer, -1):
                start = self._descend(q, up, start)
        near = self.layers[layer]
        ef = min(ef, n)
        seen = np.zeros((b, n), bool)
        rows = np.arange(b)
        seen[rows, start] = True
        nodes, sims, opened = np.full((b, ef), -1), np.full((b, ef), -np.inf, np.float32), np.zeros((b, ef), bool)
        nodes[:, 0], sims[:, 0] = start, np.einsum("bd,bd->b", q, self.x[start])
        live = rows
        while len(live):
            waits = np.where(opened[live], -np.inf, sims[live])
            k = min(OPEN, ef)
            pick = np.argpartition(-waits, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(waits, pick, 1) > -np.inf
            going = ok.any(axis=1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            opened[live[:, None], pick] |= ok
            found = np.where(ok[:, :, None], near[nodes[live[:, None], pick]], -1).reshape(len(live), -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[live[:, None], found] & (found >= 0)] = -1
            r, c = np.nonzero(found >= 0)
            seen[live[r], found[r, c]] = True
            new = np.full(found.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[found[r, c]])
            all_nodes, all_sims = np.concatenate([nodes[live], found], 1), np.concatenate([sims[live], new], 1)
            all_open = np.concatenate([opened[live], np.zeros(found.shape, bool)], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            nodes[live], sims[live], opened[live] = (np.take_along_axis(z, top, 1) for z in (all_nodes, all_sims, all_open))
        nodes[np.isneginf(sims)] = -1
        return nodes, sims

    # -- building

    def _choose(self, of: np.ndarray, at: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates (nearest first) up to ``most``: those nearer to it than to one taken
        before, so that links lead out of a crowd; then the nearest of the others."""
        b, c = at.shape
        own = np.einsum("bid,bjd->bij", self.x[at], self.x[at])
        taken, order = np.zeros((b, c), bool), np.full((b, c), 2 * c)
        for j in range(c):
            blocked = (taken & (own[:, j, :] > sims[:, j, None])).any(axis=1)
            good = (at[:, j] >= 0) & ~blocked & (taken.sum(axis=1) < most)
            taken[:, j] = good
            order[:, j] = np.where(good, j, np.where(at[:, j] >= 0, c + j, 3 * c))
        keep = np.argsort(order, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(order, keep, 1) < 3 * c, np.take_along_axis(at, keep, 1), -1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, layer: int, new: np.ndarray, most: int) -> None:
        """Each neighbour of a new node gets the new node, and chooses anew where it has too many."""
        near = self.layers[layer]
        src, dst = np.repeat(new, near.shape[1]), near[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        of, begin, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(of), BATCH):
            part, n = of[lo : lo + BATCH], count[lo : lo + BATCH]
            width = int(n.max())
            add = np.full((len(part), width), -1)
            r = np.repeat(np.arange(len(part)), n)
            c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = begin[lo]
            add[r, c] = src[first : first + n.sum()]
            both = np.concatenate([near[part], add], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both[both == part[:, None]] = -1
            sims = self._sims(self.x[part], both)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : most * 2]
            near[part] = self._choose(part, np.take_along_axis(both, top, 1), np.take_along_axis(sims, top, 1), most)

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray) -> Graph:
        """x: rows of length 1; levels: the top layer of each. Rows join in batches of at most the graph's size."""
        order = np.argsort(-levels, kind="stable")  # the highest first: then no batch moves the entry
        layers = [np.full((len(x), M0 if k == 0 else M), -1) for k in range(int(levels.max(initial=0)) + 1)]
        graph = cls(x, layers, int(order[0]) if len(x) else -1)
        at = 1
        while at < len(order):
            batch = order[at : at + min(BATCH, at)]
            at += len(batch)
            q, cur = x[batch], np.full(len(batch), graph.entry)
            peers = q @ q.T
            np.fill_diagonal(peers, -np.inf)
            for layer in range(len(layers) - 1, -1, -1):
                here = np.flatnonzero(levels[batch] >= layer)
                rest = np.flatnonzero(levels[batch] < layer)
                if len(rest):
                    cur[rest] = graph._descend(q[rest], layer, cur[rest])
                if not len(here):
                    continue
                nodes, sims = graph.beam(q[here], EF_BUILD, layer, cur[here])
                cur[here] = nodes[:, 0]
                mates = peers[np.ix_(here, here)]
                nodes = np.concatenate([nodes, np.broadcast_to(batch[here], mates.shape)], 1)
                sims = np.concatenate([sims, mates], 1)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
                nodes, sims = np.take_along_axis(nodes, top, 1), np.take_along_axis(sims, top, 1)
                nodes[np.isneginf(sims)] = -1
                most = layers[layer].shape[1]
                first = M  # in the lowest layer half of the places are left to nodes that come later
                layers[layer][batch[here], :first] = graph._choose(batch[here], nodes, sims, first)
                graph._link_back(layer, batch[here], most)
        return graph

    # -- as bytes

    def layers_bytes(self) -> list[bytes]:
        return [layer.astype("<i4").tobytes() for layer in self.layers]

    @classmethod
    def read(cls, x: np.ndarray, layers: list[bytes], entry: int) -> Graph:
        n = len(x)
        return cls(x, [np.frombuffer(b, "<i4").reshape(n, -1).astype(np.int64) for b in layers], entry)


def planted(graph: Graph, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, the node that each is to find): each node turned in a random direction to just within the threshold."""
    x = graph.x.astype(np.float64)
    at = np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)
    if x.shape[1] < 2:
        return graph.x[:0], at[:0]
    away = np.random.default_rng(len(x)).normal(size=(len(at), x.shape[1]))
    away = unit(away - (away * x[at]).sum(axis=1, keepdims=True) * x[at])
    cosine = min(1.0, threshold + PLANTED)
    return (cosine * x[at] + np.sqrt(1 - cosine * cosine) * away).astype(np.float32), at


def _audit(graph: Graph, q: np.ndarray, own: np.ndarray, ef: int, threshold: float) -> tuple[float, float]:
    """The least of the recalls of links and planted neighbours, and the recall of the nearest nodes, at a beam.

    Links are told apart by their number, 1, 2 to 3, 4 to 7 and so on, and averaged by query, so that crowds do not outvote pairs.
    """
    shares, kinds, nearest = [], [], []
    for i, found in enumerate(search(graph, q, ef, threshold)):
        sims = graph.x @ q[i]
        if own[i] >= 0:
            sims[own[i]] = -np.inf
        hit = np.zeros(len(sims), bool)
        hit[found] = True
        k = min(NEAREST, len(sims))
        nearest.append(hit[np.argpartition(-sims, k - 1)[:k]].mean())
        links = np.flatnonzero(sims >= threshold)
        if len(links):
            shares.append(hit[links].mean())
            kinds.append(len(links).bit_length())
    probes, at = planted(graph, threshold)
    shares += [float(a in found) for a, found in zip(at, search(graph, probes, ef, threshold), strict=True)]
    kinds += [0] * len(at)
    count = np.bincount(kinds)
    means = np.bincount(kinds, shares)[count > 0] / count[count > 0]
    return float(means.min(initial=1.0)), float(np.mean(nearest)) if nearest else 1.0


def audited_beam(graph: Graph, q: np.ndarray, own: np.ndarray, threshold: float, recall: float, start: int = 16) -> tuple[int, int, float, float]:
    """(beam, queries audited, recall of links and planted neighbours, recall of the nearest): the narrowest beam, doubled
    from ``start``, that passes. One that compares as many vectors as there are is the whole shard, which ``search`` compares at once.
    own: each query's node, or -1."""
    pick = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
    ef = start
    while ef < len(graph.x):
        found, nearest = _audit(graph, q[pick], own[pick], ef, threshold)
        if found >= recall:
            return ef, len(pick), found, nearest
        ef = _wider(graph, ef, 2)
    return len(graph.x), len(pick), 1.0, 1.0


def _wider(graph: Graph, ef: int, times: int) -> int:
    """A beam opens each of its nodes and compares their neighbours: from some width on that is no less than all."""
    return ef * times if ef * times * M0 < len(graph.x) else len(graph.x)


def search(graph: Graph, q: np.ndarray, ef: int, threshold: float) -> list[np.ndarray]:
    """The nodes of each query's beam; one that is full of nodes within the threshold is widened. A beam as wide
    as the graph is none: all vectors are compared, and those within reach of the threshold returned."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    todo = np.arange(len(q))
    while len(todo) and ef < len(graph.x):
        full = []
        for lo in range(0, len(todo), BATCH):
            part = todo[lo : lo + BATCH]
            nodes, sims = graph.beam(q[part], ef)
            more = sims[:, -1] >= threshold - SLACK
            for i, n in zip(part[~more], nodes[~more], strict=True):
                out[i] = n[n >= 0]
            full.append(part[more])
        todo, ef = np.concatenate(full), _wider(graph, ef, 4)
    step = max(1, CELLS // max(1, len(graph.x)))
    for lo in range(0, len(todo), step):
        part = todo[lo : lo + step]
        r, c = np.nonzero(q[part] @ graph.x.T >= threshold - SLACK)
        for i, n in zip(part, np.split(c, np.searchsorted(r, np.arange(1, len(part)))), strict=True):
            out[i] = n
    return out


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a with rows j of b, in pieces."""
    return np.concatenate([np.einsum("kd,kd->k", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def build_shards(nodes: DataFrame) -> DataFrame:
    """nodes: (node, weight, dim, shard, embedding). A row for each shard: its nodes, weights, vectors and layers."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids, raw = table["node"].to_numpy(), _vectors(table["embedding"])
        x = unit(raw).astype(np.float32)
        u = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(int), 6)
        graph = Graph.build(x, levels)
        row = {
            "dim": [table["dim"][0].as_py()], "shard": [table["shard"][0].as_py()], "nodes": [ids.astype("<i8").tobytes()],
            "weights": [table["weight"].to_numpy().astype("<i8").tobytes()], "vectors": [raw.tobytes()], "layers": [graph.layers_bytes()], "entry": [graph.entry],
        }
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("nodes", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("entry", pa.int64())]))

    return nodes.groupBy("dim", "shard").applyInArrow(task, "dim int, shard long, nodes binary, weights binary, vectors binary, layers array<binary>, entry long")


FOUND = "a long, b long, n long, shard long, block long, ef long, audited long, recall double, nearest double"


def search_shards(nodes: DataFrame, shards: DataFrame, threshold: float, recall: float, block_rows: int, block_bytes: int) -> DataFrame:
    """With b: a link (a, b) that keeps components. With n: n links of query a in one shard. With audited: a block and shard's audit."""
    rows = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(block_bytes) / (8 * F.col("dim")))))
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(nodes.count()) / rows)).cast("long")
    targets = shards.select(F.col("dim").alias("_d"), F.col("shard").alias("_s"))
    queries = nodes.select("dim", "node", "embedding", F.pmod(F.xxhash64("node"), blocks).alias("block")).join(targets, F.col("dim") == F.col("_d"))
    queries = queries.select("dim", F.col("_s").alias("shard"), "block", "node", "embedding")
    graphs = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = pa.schema([(n, pa.float64() if n in ("recall", "nearest") else pa.int64()) for n in names])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left = left.sort_by("node")
        row = right.slice(0, 1).to_pylist()[0]
        ids, weights = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["weights"], "<i8")
        exact = unit(np.frombuffer(row["vectors"]).reshape(len(ids), -1))
        graph = Graph.read(exact.astype(np.float32), row["layers"], row["entry"])
        asked = left["node"].to_numpy()
        q64 = unit(_vectors(left["embedding"]))
        q = q64.astype(np.float32)
        place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        own = np.where(ids[place] == asked, place, -1)
        ef, audited, found_share, near_share = audited_beam(graph, q, own, threshold, recall)
        every = np.union1d(ids, asked)
        of_shard, of_query = np.searchsorted(every, ids), np.searchsorted(every, asked)
        root, links = np.arange(len(every)), np.zeros(len(asked), np.int64)
        step = 4 * BATCH if ef < len(ids) else max(1, min(4 * BATCH, CELLS // len(ids)))
        for lo in range(0, len(q), step):
            found = search(graph, q[lo : lo + step], ef, threshold)
            i = np.repeat(np.arange(len(found)) + lo, [len(f) for f in found])
            j = np.concatenate(found)
            close = (_dots(q, i, graph.x, j) >= threshold - SLACK) & (own[i] != j)
            i, j = i[close], j[close]
            sure = _dots(q64, i, exact, j) >= threshold
            i, j = i[sure], j[sure]
            np.add.at(links, i, weights[j])
            root = _unite(root, of_query[i], of_shard[j])
        tied, some = np.flatnonzero(root != np.arange(len(every))), np.flatnonzero(links)
        made = [{"a": a, "b": b} for a, b in zip(every[tied].tolist(), every[root[tied]].tolist(), strict=True)]
        made += [{"a": a, "n": n} for a, n in zip(asked[some].tolist(), links[some].tolist(), strict=True)]
        made.append({"shard": row["shard"], "block": left["block"][0].as_py(), "ef": ef, "audited": audited, "recall": found_share, "nearest": near_share})
        return pa.Table.from_pylist(made, schema=kinds)

    return queries.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInArrow(task, FOUND)


def usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(merged: DataFrame) -> DataFrame:
    """``merged`` with the column node, a hash of the vector v; of the first seed under which no two are equal."""
    count, seed = merged.count(), 0
    while merged.select(F.xxhash64(F.lit(seed), "v").alias("node")).distinct().count() < count:
        seed += 1
    return merged.withColumn("node", F.xxhash64(F.lit(seed), "v"))


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99,
    min_shards: int = 8, shard_rows: int = 1 << 16, shard_bytes: int = 1 << 28, block_rows: int = 1 << 18, block_bytes: int = 1 << 28,
) -> DataFrame:
    """(id, n_links, component, kept, audited, recall, nearest, beam): a row for each row of ``vectors``.

    The last four are of the whole run: queries audited, the least recall of links and planted neighbours that any
    block and shard was searched with, the mean recall of the nearest, and the widest beam.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), usable(vector_col).alias("ok"))
    merged = materialise(slim.filter("ok").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight")), "vectors")
    merged = numbered(merged)
    rows = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (8 * F.size("v")))))
    n_shards = F.greatest(F.lit(min_shards), F.ceil(F.lit(merged.count()) / rows)).cast("long")
    nodes = merged.select("node", "weight", F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), n_shards).alias("shard"), F.col("v").alias("embedding"))
    shards = materialise(build_shards(nodes), "hnsw")
    found = materialise(search_shards(nodes, shards, threshold, recall, block_rows, block_bytes), "hnsw-links")
    roots = connected_components(found.filter("b IS NOT NULL"))
    named = merged.select(F.col("node").alias("_node"), "first")
    roots = materialise(roots.join(named, F.col("node") == F.col("_node")).select("node", "root", "first"), "hnsw-roots")
    names = roots.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component"), F.count("*").alias("_nodes"))
    roots = join_counted(roots, "root", materialise(names, "hnsw-names"), "_root", "_nodes").select(F.col("node").alias("_r"), "component")
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("_l")).agg(F.sum("n").alias("_n"))
    every = merged.join(roots, F.col("node") == F.col("_r"), "left").join(links, F.col("node") == F.col("_l"), "left")
    every = every.select(F.col("v").alias("_v"), "weight", (F.col("weight") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("component", "first").alias("_component"))
    every = materialise(every, "hnsw-vectors")
    linked = join_counted(slim.filter("ok"), "v", every, "_v", "weight").select("id", F.col("_links").alias("n_links"), F.col("_component").alias("component"))
    alone = slim.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    audit = found.filter("audited IS NOT NULL").agg(F.sum("audited").alias("audited"), F.min("recall").alias("recall"), F.avg("nearest").alias("nearest"), F.max("ef").alias("beam"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept).crossJoin(F.broadcast(audit))  # one row


def op7_hnsw(spark, sf_dir: str) -> DataFrame:
    found = embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", F.round("recall", 6).alias("audit_recall"), F.col("audited").alias("audited_queries"), F.col("beam").alias("widest_beam"))
