"""The near-duplicate filter against a loop over all pairs, and the stages of the cascade that use it."""

import math
import random
import re
from collections import Counter

import pytest

from copperleaf.operators import examples
from copperleaf.operators.near_duplicates import STOP_WORDS, near_duplicates


def loop(rows, threshold, max_features=10_000, stop_words=STOP_WORDS):
    some = [(k, Counter(w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stop_words)) for k, t in sorted(rows) if t and t.strip()]
    total, df = Counter(), Counter()
    for _, c in some:
        total.update(c)
        df.update(c.keys())
    kept_terms = set(sorted(total, key=lambda t: (-total[t], t))[:max_features])
    vectors = []
    for k, c in some:
        v = {t: n * (math.log((1 + len(some)) / (1 + df[t])) + 1) for t, n in c.items() if t in kept_terms}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((k, {t: x / length for t, x in v.items()} if length else {}))
    kept, fallen = [], set()
    for k, v in vectors:
        if any(round(sum(x * u.get(t, 0.0) for t, x in v.items()), 9) > threshold for u in kept):
            fallen.add(k)
        else:
            kept.append(v)
    return fallen


def texts(seed, n):
    """Families of texts with some words changed again and again, so that likeness runs in chains, copies, blanks and words that all share."""
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)] + ["été", "日本語", "under_score", "the", "and"]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(30)] for _ in range(max(2, n // 40))]
    for i in range(n):
        b = r.choice(bases)
        if r.random() < 0.7:
            b[r.randrange(len(b))] = r.choice(vocabulary)
        if r.random() < 0.1:
            rows.append((i, r.choice([None, "", "  \n", "the and", "x", "shared"])))
        else:
            rows.append((i, " ".join(b) + (" shared" if i % 3 else "")))
    r.shuffle(rows)
    return rows


def fallen(spark, rows, threshold, **options):
    return {r[0] for r in near_duplicates(spark.createDataFrame(rows, "id long, body string").repartition(3), "id", "body", threshold, **options).collect()}


@pytest.mark.parametrize(("seed", "n", "threshold", "options"), [(1, 300, 0.8, {}), (2, 300, 0.85, {"heads": 3}), (3, 60, 0.5, {"heads": 1}), (4, 200, 0.8, {"max_features": 40, "heads": 8})])
def test_equals_the_loop(spark, seed, n, threshold, options):
    rows = texts(seed, n)
    want = loop(rows, threshold, options.get("max_features", 10_000))
    assert fallen(spark, rows, threshold, **options) == want and (want or n < 100)


def test_two_thousand_texts_with_a_third_in_one_family(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if r.random() > 0.05 else f"new{r.randrange(50)}" for w in base)) for i in range(0, 2000, 3)]
    rows += [(i, " ".join(f"w{r.randrange(40)}" if r.random() < 0.2 else f"other{r.randrange(900)}" for _ in range(25))) for i in range(2000) if i % 3]
    want = loop(rows, 0.8)
    assert len(want) > 300 and fallen(spark, rows, 0.8, heads=16) == want


def test_fallen_texts_are_no_anchors_and_only_above_the_threshold(spark):
    # the second is like the first, the third like the second alone
    a, b, c = "a1 a2 a3 a4 a5 a6 a7 a8", "a1 a2 a3 a4 a5 a6 a7 b8", "a1 a2 a3 a4 a5 a6 b7 b8"
    rows = [(1, a), (2, b), (3, c), (4, "z1 z2"), (5, "z1 z2"), (6, "z1 z2")]
    want = loop(rows, 0.75)
    assert fallen(spark, rows, 0.75) == want and {5, 6} <= want
    assert fallen(spark, [], 0.8) == set() and fallen(spark, [(1, "one"), (2, "two")], 0.8) == set()


def chat(i, prompt, reply, style="natural", ids=()):
    return (i, style, [("user", prompt), ("assistant", reply)], list(ids))


def test_cascade_drops_like_responses_then_like_prompts(spark):
    def said(word, n=80):
        return " ".join(f"{word}{i}" for i in range(n))

    rows = [
        chat(1, said("p"), said("r")), chat(2, said("q"), said("r") + " more"), chat(3, said("p"), said("s")), chat(4, said("t"), said("u"), ids=[1, 2]),
        chat(5, said("v"), said("x"), ids=[2, 1]), chat(6, said("t"), "short"), chat(7, " ", said("y")), chat(8, " ", said("z")),
    ]
    table = spark.createDataFrame(rows, "example_id long, style string, messages array<struct<role:string,text:string>>, source_ids array<long>")
    from pyspark.sql import functions as F

    got = {r["example_id"]: (r["stage"], r["reasons"]) for r in examples.judged(table, language=F.lit("en")).collect()}
    assert got == {
        1: (None, []), 2: ("duplicate", ["duplicate"]), 3: ("prompt_duplicate", ["prompt_duplicate"]), 4: (None, []),
        5: ("source_ad_duplicate", ["source_ad_duplicate:first=4"]), 6: ("min_length", ["min_length"]), 7: (None, []), 8: (None, []),
    }
