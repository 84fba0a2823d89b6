"""Pairs and combinations against the walks that they stand for."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from copperleaf.operators import source_selection as sel


def walk(pairs, ads, count, used_ads, used_sets, low_first=False):
    out, closed, gone = [], set(), {frozenset(s) for s in used_sets}
    for strict in (True, False):
        for _, high, low in sorted(pairs):
            if len(out) >= count:
                break
            if (strict and {high, low} & set(used_ads)) or {high, low} & closed or frozenset((high, low)) in gone or not {high, low} <= set(ads):
                continue
            out.append((strict, [low, high] if low_first else [high, low]))
            closed |= {high, low}
    return [(i, *row) for i, row in enumerate(out)]


def chosen(spark, pairs, ads, count, used_ads, used_sets, low_first=False):
    df = sel.pair_batches(
        spark.createDataFrame(pairs, "place long, high_ad_id string, low_ad_id string"), spark.createDataFrame([(a,) for a in ads], "ad_id string"), count,
        spark.createDataFrame([(a,) for a in used_ads], "ad_id string"), spark.createDataFrame([(s,) for s in used_sets], "ids array<string>"), low_first,
    )
    return sorted((r["batch"], r["strict"], r["ad_ids"]) for r in df.collect())


@pytest.mark.parametrize("folded", [0, 200_000])
@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_pairs_equal_the_walk(spark, monkeypatch, folded, shape):
    monkeypatch.setattr(sel, "FOLDED", folded)
    r = random.Random(7)
    ids = [f"a{i}" for i in range(40)]
    if shape == "random":
        pairs = [(i, r.choice(ids), r.choice(ids)) for i in range(150)]  # a pair of an ad with itself, and pairs again, among them
    elif shape == "chain":
        pairs = [(i, ids[i], ids[i + 1]) for i in range(12)]
    else:
        pairs = [(i, "a0" if i % 3 else ids[i], ids[(i * 5) % 40]) for i in range(40)]
    used_ads, used_sets = ["a3", "a8", "zz"], [["a1", "a2"], ["a2", "a1"], ["a5", "a4"]]
    for count in (3, 100):
        assert chosen(spark, pairs, ids[:35], count, used_ads, used_sets, shape == "star") == walk(pairs, ids[:35], count, used_ads, used_sets, shape == "star")


def test_no_pairs_and_none_left(spark):
    assert chosen(spark, [], ["a"], 5, [], []) == []
    assert chosen(spark, [(0, "a", "b")], ["a"], 5, [], []) == []
    assert chosen(spark, [(0, "a", "b"), (1, "a", "c")], ["a", "b", "c"], 0, [], []) == []
    assert chosen(spark, [(0, "a", "b"), (1, "b", "c")], ["a", "b", "c"], 2, ["a", "b"], []) == [(0, False, ["a", "b"])]


def combos(pools, used, min_k, max_k):
    gone, out = {frozenset(s) for s in used}, []
    for place, ids in sorted(pools):
        every = (c for k in range(max_k, min_k - 1, -1) for c in combinations(ids, k))
        pick = next((c for c in every if frozenset(c) not in gone), None)
        if pick:
            gone.add(frozenset(pick))
        out.append((place, list(pick) if pick else None))
    return out


def asked(spark, pools, used, min_k, max_k):
    df = sel.fresh_combinations(spark.createDataFrame(pools, "place long, ids array<string>"), spark.createDataFrame([(u,) for u in used], "ids array<string>"), min_k, max_k)
    return sorted((r["place"], r["ad_ids"]) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 6, 12])
def test_combinations_of_one_pool_with_used_sets_in_any_order(spark, n):
    r = random.Random(n)
    ids = [f"a{i}" for i in range(n)]
    every = [list(c) for k in (3, 2) for c in combinations(ids, k)]
    for share in (0.0, 0.5, 0.95, 1.0):
        used = [r.sample(c, len(c)) for c in every[: int(share * len(every))]] + [["a0"], ["a0", "b"], ids + ["c"]]
        assert asked(spark, [(1, ids)], used, 2, 3) == combos([(1, ids)], used, 2, 3)


def test_pools_that_want_the_same_sets_get_them_in_their_order(spark):
    r = random.Random(2)
    ids = [f"a{i}" for i in range(7)]
    pools = [(i, r.sample(ids, r.choice([2, 3, 4]))) for i in range(20)] + [(20 + i, ids[:4]) for i in range(5)] + [(30, []), (31, ["only"])]
    used = [["a0", "a1", "a2"], ["a3", "a1"]]
    assert asked(spark, pools, used, 2, 3) == combos(pools, used, 2, 3)


def test_styles_and_bundles(spark):
    rows = spark.createDataFrame([(5, ["x"], "x", "copy of x"), (2, ["y", "z"], "y", None)], "place long, ad_ids array<string>, ad_id string, ad_text string")
    assert {r["style"] for r in sel.assigned_styles(rows, ["backtranslation"], F.lit(0.5)).collect()} == {"backtranslation"}
    spread = sel.assigned_styles(spark.range(8), ["p", "q"], F.col("id") / 8).collect()
    assert [r["style"] for r in sorted(spread)] == ["p"] * 4 + ["q"] * 4
    with pytest.raises(ValueError):
        sel.assigned_styles(rows, [], F.lit(0.5))
    made = sel.prepared_bundles(sel.assigned_styles(rows, ["s"], F.lit(0.0)).withColumn("shape", F.lit("has_body")), 42, 3, 4, ["r1", "r2", "r3"], {"r1": "say 1", "r2": "say 2"}, {"s": "the rules"}, "copywriting", "Begin.").collect()
    by = {r["ad_id"]: r for r in made}
    import hashlib

    register = {a: ["r1", "r2", "r3"][hashlib.sha256(a.encode()).digest()[0] % 3] for a in by}
    assert [(r["prompt_index"], r["seed"], r["register"]) for r in (by["y"], by["x"])] == [(0, 42 + 7000, register["y"]), (1, 42 + 7001, register["x"])]
    for a, r in by.items():
        said = {"r1": ["say 1", ""], "r2": ["say 2", ""], "r3": []}[register[a]]
        lines = ["# Training-example generation — task: copywriting", "", "Begin.", "", "## Style rules", "the rules", "", *said, "## Source ad (the gold target — preserve its copy in the response)", "copy of x" if a == "x" else "(none provided)", ""]
        assert r["prompt"].startswith("\n".join(lines)) and r["prompt"].endswith("<assistant_response>[the response]</assistant_response>\n")
