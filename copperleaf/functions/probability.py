"""Tail probabilities of the tests in ``operators.statistics``.

They are asked for rows of results, of which there are few, so a pandas UDF over them is no hot path. The
incomplete gamma and beta functions are summed by their public continued fractions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, SMALL, DONE = 500, 1e-300, 1e-15


def _fraction(terms, first: float) -> float:
    """first + a1 / (b1 + a2 / (b2 + ...)) by the modified Lentz method."""
    f = first or SMALL
    c, d = f, 0.0
    for a, b in terms:
        d = 1 / ((b + a * d) or SMALL)
        c = (b + a / c) or SMALL
        f *= c * d
        if abs(c * d - 1) < DONE:
            break
    return f


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, STEPS):
            term *= x / (a + k)
            total += term
        return 1 - total * scale
    return scale / _fraction(((-k * (k - a), x + 2 * k + 1 - a) for k in range(1, STEPS)), x + 1 - a)


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)

    def terms():
        for m in range(STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    scale = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return scale / (a * _fraction(terms(), 1.0))


def chi2_tail(x: float, dof: float) -> float:
    return gamma_tail(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    return beta_share(dof / 2, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


def binomial_at_least(k: float, n: float) -> float:
    """Of n fair coins k or more heads."""
    return 1.0 if k <= 0 else beta_share(k, n - k + 1, 0.5) if k <= n else 0.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _column(function, *args: Column) -> Column:
    """The function of each row's numbers; null where one is null."""

    @F.pandas_udf("double")
    def each(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(pd.isna(x) for x in row) else function(*map(float, row)) for row in rows], dtype="float64")

    return each(*[a.cast("double") for a in args])


def p_chi2(x: Column, dof: Column) -> Column:
    return _column(lambda a, b: 1.0 if b <= 0 else chi2_tail(a, b), x, dof)


def p_correlation(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    return _column(lambda r, m: float("nan") if m < 3 else 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((m - 2) / (1 - r * r)), m - 2), rho, n)


def p_binomial(k: Column, n: Column) -> Column:
    return _column(lambda a, b: 1.0 if b <= 0 else binomial_at_least(a, b), k, n)


def p_normal(z: Column) -> Column:
    return _column(normal_two_sided, z)
