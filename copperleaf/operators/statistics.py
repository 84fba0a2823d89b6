"""Evaluation statistics: rank correlation, group tests, ranking quality, calibration, resampling.

Everything that needs an order goes through ``ranking``, so no statistic gathers its rows in one task; results are a row, or
a row for each group. Resampling draws Poisson weights from a hash of row and repetition instead of indices, so
each row is weighed where it lies and the sums are added on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.functions.probability import p_binomial, p_chi2, p_correlation
from copperleaf.operators.ranking import average_rank, quantiles, running, with_positions

# The normal quantile of a 95 % interval, and the tiers in order.
Z95 = 1.959964
TIERS = ["high", "medium", "low"]


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient; 0 where it cannot be told because a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, rho, n) over the rows that have both; average ranks, 0 where a side is constant, NaN for fewer than two rows. ``df`` is
    read twice and so best a written table."""
    by = by or []
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = with_positions(known, {"_rx": (x, by), "_ry": (y, by)}, average_rank())
    return _correlated(ranked, "_rx", "_ry", by)


def _correlated(ranked: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    rho = F.when(F.count("*") < 2, float("nan")).otherwise(correlation(x, y)).alias("rho")
    return ranked.groupBy(*by).agg(rho, F.count("*").alias("n"))


def with_p_value(rho: DataFrame) -> DataFrame:
    return rho.withColumn("p_value", p_correlation(F.col("rho"), F.col("n")))


def kruskal_wallis(df: DataFrame, value: str, group: str = "tier", groups: tuple[str, ...] = tuple(TIERS)) -> DataFrame:
    """(h, dof, n, per group n and median): H of the groups with two values or more, corrected for ties; 0 with dof 0 where fewer than
    two are left, and 0 where all values are equal."""
    known = df.filter(F.col(group).isin(*groups) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    large = known.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_c")).filter("_c >= 2")
    rows = materialise(known.join(F.broadcast(large), F.col("g") == F.col("_g"), "left_semi"), "groups")  # at most one row a group
    ranked = with_positions(rows, {"r": ("v", [])}, average_rank())
    per_group = ranked.groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("sum"))
    ties = ranked.groupBy("r").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    sums = per_group.agg(F.sum("n").cast("double").alias("N"), F.sum(F.col("sum") * F.col("sum") / F.col("n")).alias("s"), F.count("*").alias("k"))
    N = F.col("N")
    even = 1 - F.col("ties") / (N * N * N - N)
    h = F.when((F.col("k") >= 2) & (even > 0), (12 / (N * (N + 1)) * F.col("s") - 3 * (N + 1)) / even).otherwise(0.0)
    one = sums.crossJoin(F.broadcast(ties)).select(h.alias("h"), F.when(F.col("k") >= 2, F.col("k") - 1).otherwise(0).alias("dof"), F.coalesce(N, F.lit(0)).cast("long").alias("n"))  # one row each
    medians = quantiles(rows, "v", ["g"], {"median": 0.5}).join(per_group.select(F.col("g").alias("_g"), "n"), F.col("g") == F.col("_g"))
    wide = medians.agg(*[F.max(F.when(F.col("g") == g, F.col("n"))).alias(f"n_{g}") for g in groups], *[F.max(F.when(F.col("g") == g, F.round("median", 4))).alias(f"median_{g}") for g in groups])
    return one.crossJoin(F.broadcast(wide))  # one row


def cliffs_delta(df: DataFrame, value: str, group: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, delta): of all pairs of a value of one group and one of the other, the share in which the first is greater less that in which
    it is less; from counts by distinct value, without making the pairs. 0 where a group is empty."""
    names = {g: f"n{i}" for i, g in enumerate(dict.fromkeys(g for pair in pairs for g in pair))}
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isin(*names)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    counts = rows.groupBy("v").agg(*[F.count_if(F.col("g") == g).alias(n) for g, n in names.items()])
    at = running(counts, [], [F.col("v")], {f"{n}_before": n for n in names.values()})

    def net(a: str, b: str) -> Column:  # the rows of b that are less than a value less those that are greater, for each row of a
        less = F.col(f"{b}_before")
        return F.sum(F.col(a).cast("double") * (less - (F.col(f"{b}_before_total") - less - F.col(b))))

    cells = [F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.sum(names[a]).cast("double").alias("na"), F.sum(names[b]).cast("double").alias("nb"), net(names[a], names[b]).alias("net")) for a, b in pairs]
    sums = at.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").filter("na + nb > 0")
    both = F.col("na") * F.col("nb")
    return sums.select("pair", F.when(both > 0, F.col("net") / F.nullif(both, F.lit(0.0))).otherwise(0.0).alias("delta"))


def ranking_quality(df: DataFrame, score: str, truth: str, tie: str, percents: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """(k_percent, k, precision, ndcg): how far the best K by score are the best K by truth; K is ``k_percent`` of the rows, at least 1.
    Equal values stand in the order of ``tie``. The gain is the truth itself, over log2(place + 1)."""
    rows = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(tie).alias("t"), F.col(score).cast("double").alias("s"), F.col(truth).cast("double").alias("v"))
    by_score = running(rows, [], [F.col("s").desc(), F.col("t")], {"ps": F.lit(1)})
    placed = running(by_score.withColumnRenamed("ps_total", "n"), [], [F.col("v").desc(), F.col("t")], {"pv": F.lit(1)})
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("p") / 100).cast("long"))
    gain = lambda place: F.col("v") / F.log2(F.col(place) + 2)
    each = placed.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("k", k).filter("ps < k OR pv < k")
    sums = each.groupBy(F.col("p").alias("k_percent"), "k").agg(
        F.count_if((F.col("ps") < F.col("k")) & (F.col("pv") < F.col("k"))).alias("both"), F.sum(F.when(F.col("ps") < F.col("k"), gain("ps"))).alias("dcg"), F.sum(F.when(F.col("pv") < F.col("k"), gain("pv"))).alias("ideal")
    )
    return sums.select("k_percent", "k", F.round(F.col("both") / F.col("k"), 4).alias("precision"), F.when(F.col("ideal") == 0, 0.0).otherwise(F.round(F.col("dcg") / F.col("ideal"), 4)).alias("ndcg"))


def chi2(counts: DataFrame, row: str, column: str, n: str, by: list[str] | None = None) -> DataFrame:
    """(by, chi2, dof) of tables of counts; with one degree of freedom by Yates' correction. Rows and columns of zeros count
    for nothing where the tables come from counted rows."""
    by = by or []
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    cells = counts.select(*by, F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(n).cast("double").alias("_n"))
    rows, columns = cells.groupBy(*by, "_r").agg(F.sum("_n").alias("_rn")), cells.groupBy(*by, "_c").agg(F.sum("_n").alias("_cn"))
    whole = rows.groupBy(*by).agg(F.sum("_rn").alias("_all"), F.count("*").alias("_rows")) if by else rows.agg(F.sum("_rn").alias("_all"), F.count("*").alias("_rows"))
    wide = columns.groupBy(*by).agg(F.count("*").alias("_columns")) if by else columns.agg(F.count("*").alias("_columns"))
    grid = rows.alias("r").join(columns.alias("c"), same("r", "c", by)) if by else rows.alias("r").crossJoin(F.broadcast(columns.alias("c")))  # the cells of a table of counts
    grid = grid.select(*[F.col(f"r.{k}").alias(k) for k in by], "_r", "_c", "_rn", "_cn")
    grid = grid.alias("g").join(cells.alias("x"), same("g", "x", [*by, "_r", "_c"]), "left").select(*[F.col(f"g.{k}").alias(k) for k in by], "_rn", "_cn", F.coalesce("_n", F.lit(0.0)).alias("_n"))
    for one in (whole, wide):
        grid = grid.alias("g").join(one.alias("o"), same("g", "o", by)).select("g.*", *[F.col(f"o.{c}") for c in one.columns if c not in by]) if by else grid.crossJoin(F.broadcast(one))  # one row
    dof = (F.col("_rows") - 1) * (F.col("_columns") - 1)
    expected = F.col("_rn") * F.col("_cn") / F.col("_all")
    off = F.abs(F.col("_n") - expected)
    off = F.when(dof == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    parts = grid.select(*by, dof.alias("dof"), F.when(expected > 0, off * off / expected).alias("x"), (expected <= 0).alias("bad"))
    sums = [F.when(F.max("bad") | (F.max("dof") < 1), 0.0).otherwise(F.sum("x")).alias("chi2"), F.when(F.max("bad"), 0).otherwise(F.max("dof")).alias("dof")]
    return parts.groupBy(*by).agg(*sums) if by else parts.agg(*sums)


def homogeneity(df: DataFrame, platform: str = "platform", tier: str = "tier", least: int = 30) -> DataFrame:
    """(chi2, dof, platforms) of tiers over the platforms with ``least`` rows or more; 0 with dof 0 for fewer than two of those."""
    counts = df.groupBy(platform, tier).agg(F.count("*").alias("n"))
    large = counts.groupBy(F.col(platform).alias("_p")).agg(F.sum("n").alias("_n")).filter(F.col("_n") >= least)
    known = counts.join(large, F.col(platform) == F.col("_p"), "left_semi")
    found = chi2(known, platform, tier, "n").crossJoin(F.broadcast(large.agg(F.count("*").alias("platforms"))))  # one row each
    few = F.col("platforms") < 2
    return found.select(F.when(few, 0.0).otherwise(F.col("chi2")).alias("chi2"), F.when(few, 0).otherwise(F.col("dof")).alias("dof"), "platforms")


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 0) without trials."""
    p = F.when(n > 0, successes / n)
    below = 1 + Z95 * Z95 / n
    centre = (p + Z95 * Z95 / (2 * n)) / below
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / below
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)


def pairwise_accuracy(pairs: DataFrame, better: Column, worse: Column) -> DataFrame:
    """(n_pairs, n_correct, n_ties, accuracy, low, high): how often the score of the winner is the greater, ties apart, with Wilson's interval."""
    sums = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(better > worse).alias("n_correct"), F.count_if(better == worse).alias("n_ties"))
    decisive = F.col("n_pairs") - F.col("n_ties")
    low, high = wilson(F.col("n_correct").cast("double"), F.nullif(decisive, F.lit(0)).cast("double"))
    share = F.when(decisive > 0, F.col("n_correct") / F.nullif(decisive, F.lit(0))).otherwise(0.0)
    return sums.select("n_pairs", "n_correct", "n_ties", share.alias("accuracy"), F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(0.0)).alias("high"))


def with_binomial_p(accuracy: DataFrame) -> DataFrame:
    return accuracy.withColumn("p_value", p_binomial(F.col("n_correct"), F.col("n_pairs") - F.col("n_ties")))


def with_chi2_p(tests: DataFrame, statistic: str = "chi2") -> DataFrame:
    return tests.withColumn("p_value", p_chi2(F.col(statistic), F.col("dof")))


def two_proportions(clicks_a: Column, shown_a: Column, clicks_b: Column, shown_b: Column) -> Column:
    """Pooled z; NaN where a side was never shown or nothing varies."""
    some = (shown_a > 0) & (shown_b > 0)
    a, b = F.nullif(shown_a, F.lit(0)).cast("double"), F.nullif(shown_b, F.lit(0)).cast("double")
    pool = (clicks_a + clicks_b) / (a + b)
    se = F.sqrt(pool * (1 - pool) * (1 / a + 1 / b))
    return F.when(some & (se > 0), (clicks_a / a - clicks_b / b) / F.nullif(se, F.lit(0.0))).otherwise(float("nan"))


# -- predictions


def regression_metrics(df: DataFrame, heads: dict[str, tuple[str, str, Column]], by: list[str] | None = None, least: int = 2) -> DataFrame:
    """(by, head, n, spearman, pearson, mae): per head of (prediction, target, mask) over the rows that the mask lets in; NaN for fewer than
    two rows, 0 where a side is constant. Groups with fewer than ``least`` rows are left out."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(h).alias("head"), F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t"), m.alias("m")) for h, (p, t, m) in heads.items()])
    rows = materialise(df.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").filter("m").drop("m"), "heads")
    keys = [*by, "head"]
    rho = spearman(rows, "p", "t", keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rho").alias("spearman"))
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), correlation("p", "t").alias("pearson"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae")).filter(F.col("n") >= least)
    joined = plain.join(rho, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    nan = lambda c: F.when(F.col("n") < 2, float("nan")).otherwise(F.col(c)).alias(c)
    return joined.select(*keys, "n", nan("spearman"), nan("pearson"), nan("mae"))


def calibration_error(df: DataFrame, prediction: str, target: str, bins: int = 10) -> DataFrame:
    """(ece, n): mean gap between prediction and target over equal-width bins, weighed by their rows; NaN without rows."""
    p = F.col(prediction).cast("double")
    edges = [i / bins for i in range(1, bins)]
    at = sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))
    per_bin = df.filter(p.isNotNull() & F.col(target).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(target).cast("double")).alias("t"))
    ece = F.sum(F.col("n") * F.abs(F.col("p") - F.col("t"))) / F.sum("n")
    return per_bin.agg(F.coalesce(ece, F.lit(float("nan"))).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tier_auc(df: DataFrame, prediction: str, target: str, threshold: float, high: bool = True) -> DataFrame:
    """(auc, positives, n) for telling the rows at or beyond the threshold, equal predictions counting half; NaN with one class only."""
    sign = 1.0 if high else -1.0
    label = F.col(target) >= threshold if high else F.col(target) <= threshold
    rows = df.filter(F.col(prediction).isNotNull() & F.col(target).isNotNull()).select((sign * F.col(prediction)).cast("double").alias("s"), label.alias("y"))
    ranked = with_positions(materialise(rows, "scores"), {"r": ("s", [])}, average_rank())
    sums = ranked.agg(F.count_if("y").cast("double").alias("p"), F.count("*").alias("n"), F.sum(F.when(F.col("y"), F.col("r")).otherwise(0.0)).alias("rank"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    auc = F.when((p > 0) & (q > 0), (F.col("rank") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))).otherwise(float("nan"))
    return sums.select(auc.alias("auc"), p.cast("long").alias("positives"), "n")


def roc_curve(df: DataFrame, score: str, label: Column, tie: str) -> DataFrame:
    """(place, fpr, tpr, area): the curve after each row in falling score, ties in the order of ``tie``, and the trapezoid that the row adds."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(tie).alias("t"), label.cast("int").alias("y"))
    at = running(rows, [], [F.col("s").desc(), F.col("t")], {"tp": "y", "fp": 1 - F.col("y")})
    tp, fp = F.col("tp_total").cast("double"), F.col("fp_total").cast("double")
    tpr0, fpr0 = F.col("tp") / tp, F.col("fp") / fp
    tpr, fpr = (F.col("tp") + F.col("y")) / tp, (F.col("fp") + 1 - F.col("y")) / fp
    return at.select((F.col("tp") + F.col("fp") + 1).alias("place"), fpr.alias("fpr"), tpr.alias("tpr"), ((fpr - fpr0) * (tpr + tpr0) / 2).alias("area"))


def reliability(df: DataFrame, prediction: str, target: str, tie: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prediction, mean_target) of equal-count bins by prediction; what does not fill a bin is dropped at the end."""
    at = running(df.select(F.col(prediction).cast("double").alias("p"), F.col(target).cast("double").alias("y"), F.col(tie).alias("t")), [], [F.col("p"), F.col("t")], {"place": F.lit(1)})
    width = F.floor(F.col("place_total") / bins)
    return at.filter(F.col("place") < width * bins).groupBy(F.floor(F.col("place") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_prediction"), F.avg("y").alias("mean_target"))


def masked_loss(df: DataFrame, heads: dict[str, tuple[str, str, Column, float]], weight: Column) -> DataFrame:
    """(loss): the mean squared error over heads of (prediction, target, mask, head's weight) and rows, by weight. Raises where all weights are 0."""
    top = sum((F.when(m, weight * h * F.pow(F.col(p) - F.col(t), 2)).otherwise(0.0) for p, t, m, h in heads.values()), F.lit(0.0))
    below = sum((F.when(m, weight * h).otherwise(0.0) for _, _, m, h in heads.values()), F.lit(0.0))
    sums = df.agg(F.sum(top).alias("_top"), F.sum(below).alias("_below"))
    return sums.select(F.when(F.col("_below") > 0, F.col("_top") / F.nullif(F.col("_below"), F.lit(0.0))).otherwise(F.raise_error(F.lit("no row has a weight"))).cast("double").alias("loss"))


def summary(df: DataFrame, columns: list[str], by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """(by, n, per column its count, mean and, for each of ``shares``, the nearest-rank quantile): values that are missing count for nothing."""
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), *[x for c in columns for x in (F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"))])
    for c in columns:
        found = quantiles(df, c, by, {f"{c}_median": 0.5})
        if shares:
            from copperleaf.operators.ranking import order_statistics

            near = order_statistics(df, c, by, {f"{c}_{name}": F.floor((F.col("total") - 1).cast("double") * q + 0.5) for name, q in shares.items()})
            found = _beside(found, near, by)
        plain = _beside(plain, found, by)
    return plain


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_by_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_by_{k}"]) for k in by])
    return left.join(right, same, "left").drop(*[f"_by_{k}" for k in by])


# -- resampling


#: Resample weights past this many drawings of a row are one in ten million; groups whose sums a task holds at once.
MOST_DRAWN, HELD_GROUPS = 9, 500
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST_DRAWN)])


def resample_weights(rows: np.ndarray, times: int, seed: int) -> np.ndarray:
    """How often each resample draws each row, as Poisson weights from a hash of row, repetition and seed: the same wherever a row lies."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] + (np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :] * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def resampled_sums(rows: DataFrame, by: list[str], row: str, values: list[str], times: int, seed: int) -> DataFrame:
    """(by, i, n, values): for each group and repetition the sum of weights and of each weighted value.

    A task holds an array of sums for each group that it meets, of at most HELD_GROUPS groups at a time, and hands on one row for each: what is shuffled
    grows with tasks and groups and not with the rows.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    slim = rows.select(key.alias("key"), F.xxhash64(row).alias("row"), *values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def made() -> pa.RecordBatch:
            sums = [pa.array([h[j].tolist() for h in held.values()], pa.list_(pa.float64())) for j in range(1 + len(values))]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *sums], names=["key", "n", *values])

        for batch in batches:
            keys, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            cells = np.stack([np.ones(len(ids)), *[batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(values))]])
            for k in dict.fromkeys(keys):
                at = np.flatnonzero(keys == k)
                for part in np.array_split(at, -(-len(at) // 1024)):
                    if k not in held:
                        if len(held) >= HELD_GROUPS:
                            yield made()
                            held.clear()
                        held[k] = np.zeros((1 + len(values), times))
                    held[k] += cells[:, part] @ resample_weights(ids[part], times, seed)
        if held:
            yield made()

    arrays = slim.mapInArrow(task, "key string, " + ", ".join(f"{c} array<double>" for c in ["n", *values]))
    zipped = arrays.select("key", F.posexplode(F.arrays_zip("n", *values)).alias("i", "s")).groupBy("key", "i").agg(*[F.sum(f"s.{c}").alias(c) for c in ["n", *values]])
    if not by:
        return zipped.drop("key")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return zipped.withColumn("key", F.from_json("key", kinds)).select(*[F.col("key")[c].alias(c) for c in by], "i", "n", *values)


def bootstrap_means(df: DataFrame, value: Column, row: Column, by: list[str], times: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(by, n, mean, low, high): the mean and the interval of its resamples."""
    rows = df.select(*by, value.cast("double").alias("_v"), row.alias("_row")).filter("_v IS NOT NULL")
    sums = resampled_sums(rows, by, "_row", ["_v"], times, seed)
    means = sums.select(*by, (F.col("_v") / F.nullif(F.col("n"), F.lit(0.0))).alias("_m"))
    bounds = quantiles(materialise(means, "resamples"), "_m", by, {"low": alpha / 2, "high": 1 - alpha / 2})
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return _beside(plain, bounds, by) if by else plain.crossJoin(F.broadcast(bounds))  # one row


def bootstrap_spearman(df: DataFrame, x: str, y: str, row: Column, times: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(rho, n, p_value, low, high): the rank correlation, and the interval over resamples of the ranked rows by weight. The ranks are
    those of all rows: ranking each resample anew moves the interval by less than its own sampling error."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), row.alias("_row"))
    ranked = materialise(with_positions(known, {"a": ("x", []), "b": ("y", [])}, average_rank()).select("_row", "a", "b"), "ranked")
    cells = {"a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b")}
    s = resampled_sums(ranked.select("_row", *[c.cast("double").alias(n) for n, c in cells.items()]), [], "_row", list(cells), times, seed)
    n = F.col("n")
    spread = (F.col("aa") - F.col("a") * F.col("a") / n) * (F.col("bb") - F.col("b") * F.col("b") / n)
    r = F.when(spread > 0, (F.col("ab") - F.col("a") * F.col("b") / n) / F.sqrt(spread)).otherwise(0.0)
    bounds = quantiles(materialise(s.select(r.alias("r")), "resamples"), "r", [], {"low": alpha / 2, "high": 1 - alpha / 2})
    return with_p_value(_correlated(ranked, "a", "b", [])).crossJoin(F.broadcast(bounds))  # one row
