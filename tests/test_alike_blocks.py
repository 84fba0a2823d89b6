"""Near-duplicates that meet as blocks: the loop's rows, small blocks, and what a task hands on."""

import numpy as np
import pytest

from copperleaf.operators import alike_blocks as blocks
from copperleaf.operators import near_duplicates as nd
from tests.test_near_duplicates import fallen, loop, texts


def vectors(seed, n):
    r = np.random.default_rng(seed)
    base, out = r.random((5, 40)), []
    for _ in range(n):
        v = np.where(r.random(40) < 0.8, base[r.integers(5)], 0) + np.where(r.random(40) < 0.1, r.random(40), 0)
        v[r.integers(40)] += 0.1
        out.append(v / np.sqrt((v * v).sum()))
    return np.array(out)


def block(made, first):
    rows, places = np.nonzero(made)
    return np.arange(first, first + len(made)), np.searchsorted(rows, np.arange(len(made) + 1)), (places * 300 + 1).astype(np.int32), made[rows, places]


@pytest.mark.parametrize(("width", "first", "most"), [(256, 64, 1000), (4, 1, 1000), (64, 2, 3)])
def test_links_are_those_of_all_pairs(monkeypatch, width, first, most):
    for name, value in (("WIDTH", width), ("FIRST", first), ("SPREAD", 8), ("BOUNDS", 900), ("CELLS", 50)):
        monkeypatch.setattr(blocks, name, value)
    made = vectors(3, 90)
    a, b = block(made[:50], 0), block(made[50:], 50)
    for later, earlier in ((a, a), (b, a), (b, b)):
        want = {(x, y) for x in later[0] for y in earlier[0] if y < x and round(made[x] @ made[y], 9) > 0.8}
        x, y, cut = blocks.alike(later, earlier, 0.8, most)
        got = set(zip(x.tolist(), y.tolist(), strict=True))
        assert got <= want and len(want) > 30 and len(x) == len(got)
        for k in later[0]:
            n, all_n = sum(x == k), sum(1 for p, _ in want if p == k)
            assert n >= min(most, all_n) and (n == all_n or k in cut)


@pytest.mark.parametrize("folded", [False, True])
@pytest.mark.parametrize(("seed", "n", "threshold", "options"), [(1, 120, 0.8, {"max_features": 60}), (6, 80, 0.7, {"heads": 1})])
def test_blocks_equal_the_loop(spark, monkeypatch, folded, seed, n, threshold, options):
    monkeypatch.setattr(nd, "JOINED", 20)
    monkeypatch.setattr(blocks, "LOAD", 2500)
    monkeypatch.setattr(nd, "FOLDED", nd.FOLDED if folded else 0)
    real, rounds = blocks.links, []
    monkeypatch.setattr(blocks, "links", lambda later, earlier, gone, t, most: rounds.append((later.count(), most)) or real(later, earlier, gone, t, most))
    rows = texts(seed, n)
    want = loop(rows, threshold, options.get("max_features", 10_000))
    assert fallen(spark, rows, threshold, **options) == want and want
    assert rounds[0][0] >= 3 and rounds[0][1] == max(1, options.get("heads", 64) // nd.WIDER)
    assert len(rounds) > 1 or "heads" not in options


def test_a_family_is_told_a_few_links_of_each_text(spark, monkeypatch):
    monkeypatch.setattr(nd, "JOINED", 20)
    made, real = [], blocks.links
    monkeypatch.setattr(blocks, "links", lambda *a: made.append(real(*a)) or made[-1])
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" w{i % 40} w{i // 40}") for i in range(600)]
    assert fallen(spark, rows, 0.8) == loop(rows, 0.8) == set(range(1, 600))
    assert len(made) == 1 and made[0].selectExpr("max(size(earlier))").first()[0] == 8
