import math
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from copperleaf.llm import quality_model as q

SF = "/root/testdata/sf0.01"


def test_held_out_labels_are_told_apart(spark):
    scored = q.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (scored["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored["doc_id"]]).all()
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.3)).all()
    held = scored[scored["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].values, held[held["quality"] == 0]["score"].values
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= 0.3).mean() > 0.97


def test_updates_follow_the_plain_formula():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(9, 3, replace=False)), rng.random(3), float(rng.integers(2))) for _ in range(40)]
    z, n = [0.0] * 10, [0.0] * 10

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * q.L1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for at, x, y in rows:
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for i, v, wi in zip(at, x, w):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / q.ALPHA * wi
            n[i] += g * g
    assert np.allclose(q.ftrl(rows, 10, 1), [weight(i) for i in range(10)])


def plain_features(text, bits):
    mask = 2**64 - 1
    place = lambda h: ((h * q.SHAPE_SALT) & mask) >> (64 - bits)
    kind = lambda c: "0" if c.isdigit() else ("a" if c == c.lower() else "A") if c.isalpha() else c
    w = (text or "").split()
    own = [xxhash.xxh64_intdigest(x) for x in w]
    shape = [xxhash.xxh64_intdigest("".join(k for k, _ in groupby(map(kind, x))), 1) for x in w]
    pair = lambda h: [((a * q.PAIR_SALT) & mask) ^ b for a, b in zip(h, h[1:])]
    said = {place(h) for h in own + pair(own)}
    kinds = Counter(place(h) for h in shape + [(h + (a == b)) & mask for h, a, b in zip(pair(shape), own, own[1:])])
    out, size = Counter({1 << bits: 1.0}), math.sqrt(sum(n * n for n in kinds.values()))
    for i in said:
        out[i] += 1 / math.sqrt(len(said))
    for i, n in kinds.items():
        out[i] += n / size
    return out


def plain_weight(z, n):
    if abs(z) <= q.L1:
        return 0.0
    return -(z - math.copysign(q.L1, z)) / ((q.BETA + math.sqrt(n)) / q.ALPHA + q.L2)


def plain_ftrl(rows, epochs):
    z, n = Counter(), Counter()
    for _ in range(epochs):
        for x, y in rows:
            w = {i: plain_weight(z[i], n[i]) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    return {i: plain_weight(z[i], n[i]) for i in z}


TEXTS = ["The cat sat", "a1 b22 A1 a1 a1", "", None, "x", "Don't, don't!", "ééé Été 12-3"]


@pytest.mark.parametrize("bits", [4, 14])
def test_features_equal_the_plain_version_each_place_once(bits):
    for t in [*TEXTS, " ".join(f"w{i} W{i}! {i}" for i in range(60))]:
        at, x = q.features(t, bits)
        want = plain_features(t, bits)
        assert len(set(at.tolist())) == len(at) and set(at.tolist()) == set(want)
        assert all(abs(v - want[i]) < 1e-12 for i, v in zip(at.tolist(), x))


@pytest.mark.parametrize(("bits", "shards"), [(5, 1), (5, 3), (14, 3), (14, 50)])
def test_scores_equal_a_plain_version_with_repeated_places_and_groups(spark, bits, shards):
    texts = TEXTS + [f"{'Good' if i % 2 else 'bad!!'} text {i} " * (i % 4 + 1) + f"No. {i * i} x{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards))
    used = docs.filter(~q.in_held_out(F.col("doc_id"))).select("doc_id", "text", shard.alias("s"), F.xxhash64(F.lit("sample"), "doc_id").alias("o")).orderBy("o", "doc_id").collect()
    want = Counter()
    for s in {r["s"] for r in used}:
        own = [(plain_features(r["text"], bits), r["doc_id"] % 2) for r in used if r["s"] == s]
        for i, w in plain_ftrl(own, 3).items():
            want[i] += w * len(own) / len(used)
    got = {r["doc_id"]: r["p"] for r in q.score(docs, q.train(docs, labels, bits=bits, shards=shards, epochs=3), out="p").collect()}
    for i, t in enumerate(texts):
        p = 1 / (1 + math.exp(-sum(want[k] * v for k, v in plain_features(t, bits).items())))
        assert abs(got[i] - p) < 1e-9, (i, t)


def test_no_bytes_of_text_train_less(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int")
    full, few = (q.train(docs, labels, bits=14, shards=1, epochs=3, **o) for o in ({}, {"max_bytes": 0}))
    assert abs(few[: 1 << 14]).max() < abs(full).max()


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good text here"), (2, None), (3, ""), (None, "good text here"), (1, "good text here"), (4, "bad " * 200000)], "doc_id long, text string"
    ).withColumns({"score": F.lit("mine"), "_label": F.lit(1), "_id": F.lit(2)})
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (2, None), (None, 1)], "doc_id long, quality int")
    w = q.train(docs, labels)
    got = q.score(docs, w, out="p").collect()
    assert len(got) == 6 and all(0 <= r["p"] <= 1 for r in got)
    by = {r["doc_id"]: r["p"] for r in got}
    assert by[2] == by[3] and len({r["p"] for r in got if r["text"] == "good text here"}) == 1
    none = q.train(docs.limit(0), labels)
    assert not none.any() and q.score(docs.limit(0), none, out="p").count() == 0
    assert {r["p"] for r in q.score(docs, q.train(docs, labels.limit(0)), out="p").collect()} == {0.5}


def test_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    out = q.keep_good_quality(spark, docs, SF)
    assert out.columns == docs.columns
    assert 700 < out.count() < 1000
