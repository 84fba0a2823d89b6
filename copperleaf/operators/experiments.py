"""A/B tests and campaign cells: group filters, winners, pairs, rates and their differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.functions.probability import p_normal
from copperleaf.operators.statistics import chi2, two_proportions, with_chi2_p


def rate(top: str, below: str, otherwise: float | None = 0.0):
    return F.when(F.col(below) > 0, F.col(top) / F.nullif(F.col(below), F.lit(0))).otherwise(otherwise)


def ab_tests(variants: DataFrame, least_variants: int = 2, least_shown: int = 100) -> DataFrame:
    """variants: (test_id, variant, impressions, clicks). Those of the tests with enough variants and impressions, with ctr and
    is_winner: the highest rate, the first variant of equals. A test without an id is none."""
    known = variants.filter(F.col("test_id").isNotNull()).withColumn("ctr", rate("clicks", "impressions"))
    tests = known.groupBy(F.col("test_id").alias("_t")).agg(F.count("*").alias("_n"), F.sum("impressions").alias("_i"), F.min(F.struct((-F.col("ctr")).alias("c"), F.col("variant").alias("v"))).alias("_best"))
    tests = tests.filter((F.col("_n") >= least_variants) & (F.col("_i") >= least_shown))
    return known.join(tests, F.col("test_id") == F.col("_t")).select("test_id", "variant", "impressions", "clicks", "ctr", (F.col("variant") == F.col("_best.v")).alias("is_winner"))


def ab_chi2(tests: DataFrame) -> DataFrame:
    """(test_id, chi2, dof) of clicks and other impressions by variant; dof 0 where a test has no clicks, or nothing else."""
    cells = F.array(F.struct(F.lit("click").alias("kind"), F.col("clicks").alias("n")), F.struct(F.lit("other").alias("kind"), F.greatest(F.lit(0), F.col("impressions") - F.col("clicks")).alias("n")))
    return chi2(tests.select("test_id", "variant", F.explode(cells).alias("c")).select("test_id", "variant", "c.kind", "c.n"), "variant", "kind", "n", ["test_id"])


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    return with_chi2_p(ab_chi2(tests)).withColumn("significant", F.col("p_value") < level)


def winner_loser_pairs(tests: DataFrame) -> DataFrame:
    """(test_id, winner, loser): a test's winner with each of the others."""
    won = tests.filter("is_winner").select(F.col("test_id").alias("_t"), F.col("variant").alias("winner"))
    return tests.filter("NOT is_winner").join(won, F.col("test_id") == F.col("_t")).select("test_id", "winner", F.col("variant").alias("loser"))


def other_tests_best(tests: DataFrame, value: str) -> DataFrame:
    """(test_id, variant, best_elsewhere): the highest ``value`` of the winners of all other tests.

    Leaving one test out of a maximum needs the two highest winners only, one row; no pairs are made.
    """
    won = tests.filter("is_winner").groupBy("test_id").agg(F.max(value).alias("v"))
    first = won.agg(F.max(F.struct("v", "test_id")).alias("one"))
    second = won.crossJoin(F.broadcast(first)).filter("test_id <> one.test_id").agg(F.max("v").alias("second"))
    best = first.crossJoin(F.broadcast(second))  # one row
    return tests.crossJoin(F.broadcast(best)).select("test_id", "variant", F.when(F.col("test_id") == F.col("one.test_id"), F.col("second")).otherwise(F.col("one.v")).alias("best_elsewhere"))


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: (by, impressions, clicks, spend). Sums per cell, with ctr (0 if never shown), cpc and cpm (NaN without clicks or views)."""
    nan = float("nan")
    sums = rows.groupBy(*by).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend").alias("spend"))
    return sums.withColumns({"ctr": rate("clicks", "impressions"), "cpc": rate("spend", "clicks", nan), "cpm": F.when(F.col("impressions") > 0, F.col("spend") / F.nullif(F.col("impressions"), F.lit(0)) * 1000.0).otherwise(nan)})


def pivoted(rows: DataFrame, key: str, column: str, values: list[str], sums: list[str]) -> DataFrame:
    """One row per ``key``: for each of the stated values of ``column`` the sums, 0 where there is none."""
    cell = lambda v, s: F.coalesce(F.sum(F.when(F.col(column) == v, F.col(s))), F.lit(0)).alias(f"{v}_{s}")
    return rows.groupBy(key).agg(*[cell(v, s) for v in values for s in sums])


def contrast(rows: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """(z) of the click rates of two cells, and (p_value) by ``with_normal_p``."""
    sums = rows.agg(*[F.sum(F.when(F.col(column) == v, F.col(s)).otherwise(0)).cast("double").alias(f"{s}_{n}") for n, v in (("a", a), ("b", b)) for s in ("clicks", "impressions")])
    return sums.select(two_proportions(*[F.col(c) for c in ("clicks_a", "impressions_a", "clicks_b", "impressions_b")]).alias("z"))


def with_normal_p(z: DataFrame) -> DataFrame:
    return z.withColumn("p_value", p_normal(F.col("z")))


def ad_name_parts(name):
    """(cell, brief) of a name with ``__``, split at the first and stripped; nulls without."""
    from copperleaf.functions.text import stripped

    there, at = F.instr(name, "__") > 0, F.instr(name, "__")
    return F.when(there, stripped(F.substring(name, F.lit(1), at - 1))), F.when(there, stripped(F.substring(name, at + 2, F.length(name))))


def ctr_intervals(rows: DataFrame, times: int = 1000, seed: int = 42) -> DataFrame:
    """``rows`` of cells with low and high, the 95 % interval of binomial resamples of their clicks; NaN for a cell that was never shown."""

    def drawn(clicks: pd.Series, shown: pd.Series) -> pd.DataFrame:
        out = []
        for k, n in zip(clicks, shown, strict=True):
            ctrs = np.random.default_rng(seed).binomial(int(n), k / n, times) / n if n > 0 else np.full(1, np.nan)
            out.append(np.quantile(ctrs, [0.025, 0.975]))
        return pd.DataFrame(out, columns=["low", "high"])

    bounds = F.pandas_udf(drawn, "low double, high double")(F.col("clicks").cast("long"), F.col("impressions").cast("long"))
    return rows.withColumn("_b", bounds).select(*rows.columns, "_b.low", "_b.high")
