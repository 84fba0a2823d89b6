"""A label model from the overlaps of its label functions: how each votes under each label, by gradient steps on what votes together.

With votes as indicators (a column for each function and label), O holds how often two of them come together. If votes depend on the label
alone, an entry for two different functions is the sum over labels of p(label) mu(a | label) mu(b | label), and one on the diagonal is the sum of
p(label) mu(a | label). mu is fitted to both by plain gradient descent from a start of equal precision; of the two orders of the labels the one in which most
functions vote for what they name stands. O has as many entries as functions and labels squared, whatever the input: it is summed in one aggregation.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps, their size, the precision of the start, and the seed of its scale.
EPOCHS, RATE, PRECISION, SEED = 500, 0.01, 0.7, 42


def overlaps(df: DataFrame, votes: list[str], rows: str | None = None) -> tuple[np.ndarray, int]:
    """(O, n): shares of rows on which two indicators hold together; indicator 2 i + y is that vote i is y. Rows are counted by what they vote first, of
    which there is little, so that the sums over all pairs of indicators are not made for each row. A row stands for as many as it says in ``rows``, if that is named."""
    cells = [(v, y) for v in votes for y in (0, 1)]
    pairs = [(i, j) for i in range(len(cells)) for j in range(i, len(cells))]
    is_ = lambda c: F.col(c[0]) == c[1]
    known = df.select(*([F.col(rows).alias("_rows")] if rows else []), *[F.when(F.col(v).isin(0, 1), F.col(v)).otherwise(-1).alias(v) for v in votes]).groupBy(*votes).agg((F.sum("_rows") if rows else F.count("*")).alias("_n"))
    row = known.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(is_(cells[i]) & is_(cells[j]), F.col("_n"))), F.lit(0)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    made = np.zeros((len(cells), len(cells)))
    for i, j in pairs:
        made[i, j] = made[j, i] = row[f"c{i}_{j}"] / max(1, row["n"])
    return made, row["n"]


def fitted(o: np.ndarray, n: int, balance: tuple[float, float] = (0.5, 0.5), epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """mu, a row for each indicator and a column for each label: how likely the vote is under the label."""
    m, p = len(o) // 2, np.array(balance)
    other = ~np.kron(np.eye(m, dtype=bool), np.ones((2, 2), dtype=bool))
    seen = np.diag(o)
    mu = np.zeros((2 * m, 2))
    for i in range(2 * m):
        mu[i, i % 2] = min(1.0, seen[i] * PRECISION / p[i % 2])
    mu *= np.random.RandomState(seed).random_sample()
    for _ in range(epochs):
        apart = np.where(other, o - (mu * p) @ mu.T, 0.0)
        alone = (mu * p).sum(axis=1) - seen
        mu -= rate * (-4 * apart @ (mu * p) + 2 * alone[:, None] * p)
    least = min(0.01, 1 / 10 ** math.ceil(math.log10(max(2, n))))
    mu = np.clip(mu, least, 1 - least)
    right = sum(mu[2 * i + y, y] > mu[2 * i + y, 1 - y] for i in range(m) for y in (0, 1) if seen[2 * i + y] > 0)
    wrong = sum(mu[2 * i + y, y] < mu[2 * i + y, 1 - y] for i in range(m) for y in (0, 1) if seen[2 * i + y] > 0)
    return mu if right >= wrong else mu[:, ::-1].copy()


def posterior(votes: list[str], mu: np.ndarray, balance: tuple[float, float] = (0.5, 0.5)) -> Column:
    """The probability of label 1 of a row by its votes; the balance where all abstain."""
    logs = np.log(mu)
    sides = [reduce(lambda a, b: a + b, [F.when(F.col(v) == y, float(logs[2 * i + y, k])).otherwise(0.0) for i, v in enumerate(votes) for y in (0, 1)], F.lit(math.log(balance[k]))) for k in (0, 1)]
    return 1 / (1 + F.exp(sides[0] - sides[1]))


def majority(votes: list[str]) -> Column:
    count = lambda y: reduce(lambda a, b: a + b, [F.when(F.col(v) == y, 1).otherwise(0) for v in votes])
    return (count(1) + 1) / (count(0) + count(1) + 2)


def with_labels(df: DataFrame, votes: list[str], out: str = "p_high", epochs: int = EPOCHS, rows: str | None = None) -> DataFrame:
    """``df`` (votes 1, 0, or anything else to abstain) with the fitted probability of label 1; 0.5 for all where no function ever votes, and the
    votes' majority where the fit is no number. ``rows`` as in ``overlaps``."""
    o, n = overlaps(df, votes, rows)
    if not np.diag(o).any():
        return df.withColumn(out, F.lit(0.5))
    mu = fitted(o, n, epochs=epochs)
    return df.withColumn(out, posterior(votes, mu) if np.isfinite(mu).all() else majority(votes))
