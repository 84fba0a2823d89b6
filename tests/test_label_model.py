"""The overlap label model beside a plain version, on votes whose accuracies are known."""

import numpy as np
import pytest

from copperleaf.operators import label_model

VOTES = [f"v{i}" for i in range(5)]
SCHEMA = "id long, y int, " + ", ".join(f"{v} int" for v in VOTES)


def made(n, seed, accuracy=(0.9, 0.8, 0.7, 0.6, 0.75), share=0.8):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    votes = np.stack([np.where(rng.random(n) < share, np.where(rng.random(n) < a, y, 1 - y), -1) for a in accuracy], axis=1)
    return [(i, int(y[i]), *map(int, votes[i])) for i in range(n)]


def plain(rows, epochs):
    """The same losses, their gradient by differences of the loss at first and last step."""
    L = np.array([r[2:] for r in rows])
    ind = np.stack([(L[:, i] == y).astype(float) for i in range(L.shape[1]) for y in (0, 1)], axis=1)
    o, m = ind.T @ ind / len(L), L.shape[1]
    mask = np.array([[i // 2 != j // 2 for j in range(2 * m)] for i in range(2 * m)])

    def loss(mu):
        fit = sum(0.5 * np.outer(mu[:, k], mu[:, k]) for k in (0, 1))
        return ((o - fit)[mask] ** 2).sum() + ((0.5 * mu.sum(axis=1) - np.diag(o)) ** 2).sum()

    mu = np.zeros((2 * m, 2))
    for i in range(2 * m):
        mu[i, i % 2] = min(1, o[i, i] * 0.7 / 0.5)
    mu *= np.random.RandomState(42).random_sample()
    for _ in range(epochs):
        grad = np.zeros_like(mu)
        for a in range(mu.shape[0]):
            for b in (0, 1):
                step = np.zeros_like(mu)
                step[a, b] = 1e-6
                grad[a, b] = (loss(mu + step) - loss(mu - step)) / 2e-6
        mu -= 0.01 * grad
    mu = np.clip(mu, 0.001, 0.999)
    p = np.array([[np.prod([mu[2 * i + v, k] for i, v in enumerate(row) if v >= 0]) for k in (0, 1)] for row in L])
    return o, mu, p[:, 1] / p.sum(axis=1)


def test_equals_the_plain_version(spark):
    rows = made(600, 1)
    o, mu, p = plain(rows, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got_o, n = label_model.overlaps(df, VOTES)
    assert n == 600 and np.allclose(got_o, o) and np.allclose(label_model.fitted(got_o, n, epochs=60), mu, atol=1e-5)
    got = {r["id"]: r["p_high"] for r in label_model.with_labels(df, VOTES, epochs=60).collect()}
    assert np.allclose([got[i] for i in range(600)], p, atol=1e-4)


def test_labels_are_found_and_better_voters_weigh_more(spark):
    rows = made(4000, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["p_high"] for r in label_model.with_labels(df, VOTES).collect()}
    right = np.mean([(got[r[0]] > 0.5) == bool(r[1]) for r in rows if got[r[0]] != 0.5])
    assert right > 0.85
    mu = label_model.fitted(*label_model.overlaps(df, VOTES))
    edge = [mu[2 * i + 1, 1] - mu[2 * i + 1, 0] for i in range(5)]
    assert edge[0] > edge[2] > edge[3] and all(e > 0 for e in edge)


def test_rows_and_tables_without_votes(spark):
    rows = [(1, 0, *[-1] * 5), (2, 1, 1, 1, 1, -1, -1), (3, 0, 0, 0, -1, 0, 0)]
    got = {r["id"]: r["p_high"] for r in label_model.with_labels(spark.createDataFrame(rows, SCHEMA), VOTES).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] > 0.5 > got[3]
    none = spark.createDataFrame(rows[:1], SCHEMA)
    assert label_model.with_labels(none, VOTES).first()["p_high"] == 0.5 and label_model.with_labels(none.limit(0), VOTES).count() == 0
