"""How near two sets of feature vectors are as distributions: both are quantised by common clusters, and the area under their divergence
curve is taken, from 0 (apart) to 1 (alike)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of the curve, its scale, and the most clusters.
POINTS, SCALE, MOST = 25, 5.0, 500


def frontier_area(p: np.ndarray, q: np.ndarray, points: int = POINTS, scale: float = SCALE) -> float:
    """Area under the curve of exp(-scale * KL) of two histograms against their mixtures; 1 for equal ones."""
    p, q = p / p.sum(), q / q.sum()
    kl = lambda a, r: float((a[a > 0] * np.log(a[a > 0] / r[a > 0])).sum())
    curve = [(1.0, 0.0), (0.0, 1.0)]
    for w in np.linspace(1e-6, 1 - 1e-6, points):
        r = w * p + (1 - w) * q
        curve.append((np.exp(-scale * kl(q, r)), np.exp(-scale * kl(p, r))))
    x, y = np.array(sorted(curve)).T
    return float(np.clip(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum(), 0, 1))


def histograms(rows: DataFrame, vector: str, side: str, clusters: int | None = None, seed: int = 42) -> np.ndarray:
    """rows: a boolean ``side`` and vectors of one length. Counts by cluster, a row for each side; a tenth as many clusters as rows, MOST at most."""
    known = rows.filter(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), side)
    n = known.count()
    k = clusters or int(min(MOST, max(2, n // 10)))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(known)
    counts = model.transform(known).groupBy("prediction").agg(F.count_if(F.col(side)).alias("p"), F.count_if(~F.col(side)).alias("q")).collect()  # at most MOST rows
    return np.array([[r["p"], r["q"]] for r in sorted(counts, key=lambda r: r["prediction"])], float).T


def divergence(rows: DataFrame, vector: str, side: str, clusters: int | None = None, times: int = 200, seed: int = 42) -> DataFrame:
    """(score, low, high, n_p, n_q): the area, and its interval over resamples of the histograms. NaN where a side is empty."""
    spark = rows.sparkSession
    h = histograms(rows, vector, side, clusters, seed)
    if not h.size or (h.sum(axis=1) == 0).any():
        return spark.createDataFrame([(float("nan"), float("nan"), float("nan"), *[int(x) for x in (h.sum(axis=1) if h.size else (0, 0))])], "score double, low double, high double, n_p long, n_q long")
    rng = np.random.default_rng(seed)
    drawn = [frontier_area(*[rng.multinomial(int(x.sum()), x / x.sum()).astype(float) for x in h]) for _ in range(times)]
    low, high = np.quantile(drawn, [0.025, 0.975])
    return spark.createDataFrame([(frontier_area(*h), float(low), float(high), int(h[0].sum()), int(h[1].sum()))], "score double, low double, high double, n_p long, n_q long")
