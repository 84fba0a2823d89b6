import numpy as np
import pytest
from pyspark.sql import functions as F

from copperleaf.llm import hnsw


def brute(ids, vectors, threshold=0.95):
    """{id: (links, component)}"""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(vectors, ok)]
    n = len(ids)
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        named = [ids[j] for j in reach if ids[j] is not None]
        out.append((ids[i], len(link[i]), min(named) if named else None))
    return out


def crowds(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for size in (200, 30, 2, 2, 2):
        at = rng.choice(n, size, replace=False)
        x[at] = x[at[0]] + 0.15 * np.linalg.norm(x[at[0]]) / np.sqrt(dim) * rng.normal(size=(size, dim))
    return x.astype(np.float32)


@pytest.mark.parametrize("dim", [16, 64])
def test_graph_finds_what_brute_force_finds(dim):
    x = hnsw.unit(crowds(dim, 1500, dim).astype(float)).astype(np.float32)
    levels = np.minimum((-np.log(np.random.default_rng(1).random(len(x))) / np.log(hnsw.M)).astype(int), 6)
    graph = hnsw.Graph.build(x, levels)
    graph = hnsw.Graph.read(x, graph.layers_bytes(), graph.entry)
    ef = hnsw.audited_beam(graph, x, np.arange(len(x)), 0.95, 0.99)[0]
    found, true = hnsw.search(graph, x, ef, 0.95), x @ x.T >= 0.95
    got = sum(true[i, f].sum() for i, f in enumerate(found))
    assert got >= 0.99 * true.sum()


def test_query_reaches_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = {i: (n, c) for i, n, c in brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.op7_hnsw(spark, sf).collect()}
    assert set(got) == set(want)
    assert sum(got[i][0] for i in got) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(want)


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(9, a), (4, b), (7, [2.0, 4.0, 6.0]), (5, a), (None, a), (3, None), (2, []), (1, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (6, [3.0, -1.0, 0.0]), (6, [3.0, -1.0, 0.0]), (12, [1.0, 2.0]), (13, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "component": F.lit("x"), "ok": F.lit(1), "_v": F.lit(1), "v": F.lit(1), "weight": F.lit(1), "id": F.lit(1)})
    got = sorted(((r["id"], r["n_links"], r["component"]) for r in hnsw.embedding_components(df).collect()), key=str)
    assert got == sorted(brute([i for i, _ in rows], [v for _, v in rows]), key=str)
    assert hnsw.embedding_components(df.limit(0)).count() == 0


def graph_of(x):
    return hnsw.Graph.build(x, np.minimum((-np.log(np.random.default_rng(1).random(len(x))) / np.log(hnsw.M)).astype(int), 6))


def test_audit_widens_where_no_query_has_a_link():
    x = hnsw.unit(np.random.default_rng(3).normal(size=(3000, 64))).astype(np.float32)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    assert sims.max() < 0.95
    graph = graph_of(x)
    probes, at = hnsw.planted(graph, 0.95)
    assert len(at) == hnsw.AUDIT and np.allclose((probes * x[at]).sum(axis=1), 0.951, atol=1e-4)
    graph.layers[0][::3] = -1  # a third of the nodes lead nowhere, and some are out of reach
    got = lambda ef: np.mean([a in f for a, f in zip(at, graph.beam(probes, ef)[0])])
    assert got(16) < 0.99
    ef, audited, recall, nearest = hnsw.audited_beam(graph, x, np.arange(len(x)), 0.95, 0.99)
    assert ef > 16 and audited == hnsw.AUDIT and recall >= 0.99 and 0 < nearest <= 1
    assert ef == len(x) or got(ef) >= 0.99


def test_pairs_out_of_reach_are_found_beside_a_crowd():
    x = crowds(5, 1500, 32).astype(float)
    pairs = np.arange(1400, 1500).reshape(-1, 2)
    x[pairs[:, 1]] = x[pairs[:, 0]] * 1.01 + 1e-3
    x = hnsw.unit(x).astype(np.float32)
    graph, lost = graph_of(x), pairs.ravel()
    for layer in graph.layers:  # no link leads to them
        layer[np.isin(layer, lost)] = -1
    graph.entry = int(np.setdiff1d(np.flatnonzero(graph.layers[0].max(axis=1) >= 0), lost)[0])
    true = x @ x.T >= 0.95
    found = hnsw.search(graph, x, hnsw.audited_beam(graph, x, np.arange(len(x)), 0.95, 0.99)[0], 0.95)
    assert all(b in found[a] and a in found[b] for a, b in pairs)
    assert all(set(np.flatnonzero(true[i])) <= {*f, i} for i, f in enumerate(found))


def test_pairs_and_groups_across_shards_and_blocks(spark):
    rng = np.random.default_rng(7)
    x, at = rng.normal(size=(2400, 32)), 0
    sizes = [2] * 100 + [5] * 20 + [200]
    for size in sizes:
        x[at : at + size] = x[at] + 0.1 * np.linalg.norm(x[at]) / np.sqrt(32) * rng.normal(size=(size, 32))
        at += size
    x = x.astype(np.float32)
    u = hnsw.unit(x.astype(float))
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    made = hnsw.embedding_components(df, shard_rows=300, block_rows=800)
    rows = made.collect()
    small = dict(min_shards=1, shard_rows=10**6, shard_bytes=300 * 8 * 32, block_rows=10**6, block_bytes=800 * 8 * 32)
    again = hnsw.embedding_components(df.repartition(7).orderBy(F.rand(1)), **small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))  # bounded by bytes, dealt otherwise, and run again
    assert rows[0]["recall"] >= 0.99 and rows[0]["audited"] >= 3 * 8 * hnsw.AUDIT
    got = np.array([n for _, n in sorted((r["id"], r["n_links"]) for r in rows)])
    share, kind = got / np.maximum(true, 1), np.minimum(true, 9)
    assert len(got) == len(true) and (got <= true).all()
    for some in (kind == 1, (kind > 1) & (kind < 9), kind == 9):
        assert some.sum() > 50 and share[some].mean() >= 0.99
