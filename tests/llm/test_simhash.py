import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from copperleaf.llm import simhash
from copperleaf.llm.components import connected_components


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget=3):
    """fps: {node: fp}; smallest node reachable from each."""
    nodes = sorted(fps)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= budget:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "É Ä x É Ä x y z", "a b c d e f g " * 50000])
def test_fingerprint_is_the_majority_of_bits(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fp(text)


def crowd(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 20)]
    out = {rng.getrandbits(64) for _ in range(n // 2)}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return [x - 2**64 if x >= 2**63 else x for x in sorted(out)]


@pytest.mark.parametrize("max_group", [4096, 3])
def test_links_keep_all_components(spark, max_group):
    fps = crowd(random.Random(5), 600)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.spanning_links(df, max_group=max_group)).collect()}
    want = {k: v for k, v in brute_components(dict(zip(fps, fps))).items()}
    sizes = {v: sum(w == v for w in want.values()) for v in want.values()}
    assert got == {k: v for k, v in want.items() if sizes[v] > 1}


def test_dense_crowd_in_small_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(3)
    path = np.unique(rng.integers(0, 1 << 11, 500, dtype=np.uint64))
    root = simhash.trie_links(path, np.array([0]), np.array([len(path)]), np.array([16]), 3)
    want = brute_components({i: int(x) for i, x in enumerate(path)})
    assert root.tolist() == [want[i] for i in range(len(path))]


ROWS = [
    (5, "the cat sat on the mat and looked at the moon"),
    (3, "The CAT sat\ton the mat and looked at the moon"),
    (9, "something else entirely that no other text here says"),
    (9, "something else entirely that no other text here says"),
    (None, "the cat sat on the mat and looked at the moon"),
    (None, "nobody's text that has no id at all in this table"),
    (7, None),
    (8, ""),
    (4, "long " * 30000 + "tail"),
]


def test_components_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"fp": F.lit(1), "component": F.lit("x"), "id": F.lit(2)})
    got = sorted((str(r["id"]), r["fp"], r["component"]) for r in simhash.simhash_components(df).collect())
    fp = {t: brute_fp(t) for _, t in ROWS}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    name = {5: 3, 3: 3, 9: 9, 7: 7, 8: 7, 4: 4}
    want = [(str(i), signed(fp[t]), name[i] if i is not None else (3 if "cat" in t else None)) for i, t in ROWS]
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert simhash.simhash_components(df.limit(0)).count() == 0


HELPERS = ("component", "root", "copy", "_copy_id", "_copy_hash", "_row", "_root", "place", "fp", "id")


def test_stage_leaves_one_of_each(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("kept") for c in HELPERS} | {"tags": F.create_map(F.lit("a"), F.lit(1))})
    out = simhash.keep_one_of_each(spark, df, "")
    assert out.columns == df.columns
    # the text without an id that is a copy goes, that without copies stays
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "4", "7", "9", "None"]
    assert simhash.keep_one_of_each(spark, df.limit(0), "").count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    alone, near = "a text of its own that nobody else in this table has", ROWS[0][1]
    df = spark.createDataFrame([(1, near), (1, alone), (2, near), (None, alone), (None, "x y z"), (None, "x y z")], "doc_id long, text string").withColumn("n", F.rand(1))
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one_of_each(spark, df, "").collect()) == sorted([("1", near), ("1", alone), ("None", "x y z")])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: brute_fp(t) for i, t in texts.items()}
    component = brute_components(fp)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, sf).collect()}
    assert got == {(i, f"{x:016x}", component[i]) for i, x in fp.items()} and len(got) == len(texts)


@pytest.mark.parametrize("budget", [0, 1, 5])
def test_links_at_other_budgets(spark, budget):
    fps = crowd(random.Random(6), 200)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.spanning_links(df, budget, max_group=3)).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= budget
    want = {}
    for x in fps:
        reach, todo = {x}, [x]
        while todo:
            y = todo.pop()
            new = {z for z in fps if z not in reach and near(y, z)}
            reach |= new
            todo += new
        if len(reach) > 1:
            want[x] = min(reach)
    assert got == want


def test_components_of_a_long_path_and_no_edges(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(path).collect()
    assert len(got) == 301 and {r["root"] for r in got} == {0}
    assert connected_components(path.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (4, 3), (3, 4), (3, 4)], "a long, b long")
    assert sorted(map(tuple, connected_components(odd).collect())) == [(3, 3), (4, 3)]
