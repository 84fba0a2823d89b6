"""Ranks, running sums and order statistics that scale: no window over all rows, no collected arrays.

Ranks start from ``positions``: equal values are merged on the map side, the distinct ones are dealt out by
range, and each range's offset is the sum of the ranges before it. ``running`` does the same for rows in
an order. So even a rank over the whole table, or over one platform that holds most of it, is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import BROADCAST_ROWS, broadcast_if_small, fresh, join_counted, materialise


def _same(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[v]) for k, v in keys.items()])


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum over the rows of its group that stand before it, and the
    group's whole sum as <name>_total. Rows are dealt out by (by, order), which should leave no ties."""
    names = fresh(df, "_p", "_q", *[f"_{k}{i}" for i in range(len(sums)) for k in "sot"], *[f"_by{i}" for i in range(len(by))])
    here, there, values, groups = names[0], names[1], names[2 : 2 + 3 * len(sums)], names[2 + 3 * len(sums) :]
    cells, offsets, totals = values[0::3], values[1::3], values[2::3]
    summed = df.withColumns({s: c if isinstance(c, Column) else F.col(c) for s, c in zip(cells, sums.values(), strict=True)})
    placed = summed.repartitionByRange(*by, *order) if by or order else summed
    placed = materialise(placed.withColumn(here, F.spark_partition_id()), "running")
    parts = placed.groupBy(*by, here).agg(*[F.sum(c).alias(c) for c in cells])
    group = W.partitionBy(*by)
    before = group.orderBy(here).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(here).alias(there),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in zip(cells, offsets, strict=True)], *[F.sum(c).over(group).alias(t) for c, t in zip(cells, totals, strict=True)],
    )
    same = placed[here] == parts[there]
    joined = placed.join(parts, same & _same(placed, parts, dict(zip(by, groups, strict=True))) if by else same)
    inside = W.partitionBy(*by, here).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    made = [(F.col(o) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, o, name in zip(cells, offsets, sums, strict=True)]
    return joined.select(*df.columns, *made, *[F.col(t).alias(f"{name}_total") for t, name in zip(totals, sums, strict=True)])


def positions(df: DataFrame, value: str, by: list[str], rows: str | None = None) -> DataFrame:
    """(by, value, n, before, total): for each distinct value how many rows have it, how many a
    smaller one, and how many rows the group has. Nulls take no place. A row stands for as many as it says in ``rows``, if that is named."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(rows) if rows else F.count("*")).alias("n"))
    return running(counts, by, [F.col(value)], {"before": "n"}).withColumnRenamed("before_total", "total")


def average_rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2


def percentile() -> Column:
    """From 0 to 1; 0.5 for a row alone. Equal values share the average of their places."""
    return F.when(F.col("total") == 1, 0.5).otherwise(F.round((F.col("before") + (F.col("n") - 1) / 2) / (F.col("total") - 1), 6))


def _number(column: str) -> Column:
    """As a double; negative zero is zero, since what is joined by text must be equal as text."""
    x = F.col(column).cast("double")
    return F.when(x == 0, 0.0).otherwise(x)


def with_positions(df: DataFrame, specs: dict[str, tuple[str, list[str]]], made: Column | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``, name: (value, by): computed from n, before and total of the
    row's value among those of its group, the percentile unless ``made`` says otherwise; null where the value is.

    All values go through one pass as doubles. The table of distinct values is broadcast where it is of a
    checked size; else its hot values are, and the rows of the others are shuffled by value.
    """
    made = percentile() if made is None else made
    cells = [F.struct(F.lit(i).alias("spec"), F.to_json(F.struct(*by)).alias("key") if by else F.lit("").alias("key"), _number(v).alias("value")) for i, (v, by) in enumerate(specs.values())]
    at = materialise(positions(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "value", ["spec", "key"]), "positions")
    small = at.count() <= BROADCAST_ROWS
    for i, (name, (value, by)) in enumerate(specs.items()):
        own, there, rows, made_of = fresh(df, "_value", "_at", "_rows", "_made")
        found = F.struct((F.to_json(F.struct(*by)) if by else F.lit("")).alias("key"), _number(value).alias("value"))
        lookup = at.filter(F.col("spec") == i).select(F.struct("key", "value").alias(there), F.col("n").alias(rows), made.alias(made_of))
        keyed = df.withColumn(own, found)
        if small:
            ranked = keyed.join(F.broadcast(lookup), F.col(own) == F.col(there), "left")
        else:
            keyed = materialise(keyed, "ranked-rows")
            some = join_counted(keyed.filter(F.col(value).isNotNull()), own, materialise(lookup, "lookup"), there, rows)
            ranked = some.unionByName(keyed.filter(F.col(value).isNull()), allowMissingColumns=True)
        df = ranked.select(*[c for c in df.columns if c != name], F.col(made_of).alias(name))
    return df


def with_sides(df: DataFrame, values: dict[str, str], by: list[str], low: float, high: float) -> DataFrame:
    """``df`` with <name>_low and <name>_high for each of ``values``, name: value: whether the percentile of the row's value in its group is below
    ``low``, and whether it is above ``high``; null where the value is. A percentile rises with its value, so two bounds of a group say both, and no row is ranked or shuffled."""
    spec, value, *names = fresh(df, "_spec", "_value", *[f"_{k}{i}" for i in range(len(values)) for k in ("low", "high")], *[f"_by{i}" for i in range(len(by))])
    lows, highs, groups = names[0 : 2 * len(values) : 2], names[1 : 2 * len(values) : 2], names[2 * len(values) :]
    cells = [F.struct(F.lit(i).alias(spec), _number(v).alias(value)) for i, v in enumerate(values.values())]
    at = positions(df.select(*by, F.inline(F.array(*cells))), value, [*by, spec])
    side = lambda i, holds: F.when((F.col(spec) == i) & holds, F.col(value))
    ends = [c for i in range(len(values)) for c in (F.max(side(i, percentile() < low)).alias(lows[i]), F.min(side(i, percentile() > high)).alias(highs[i]))]
    bounds = materialise(at.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]).agg(*ends), "bounds")
    bounds = broadcast_if_small(bounds)
    joined = df.join(bounds, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, groups, strict=True)]), "left") if by else df.crossJoin(bounds)
    made = []
    for (name, v), lo, hi in zip(values.items(), lows, highs, strict=True):
        made += [F.when(F.col(v).isNotNull(), F.coalesce(holds, F.lit(False))).alias(f"{name}_{end}") for end, holds in (("low", _number(v) <= F.col(lo)), ("high", _number(v) >= F.col(hi)))]
    return joined.select(*df.columns, *made)


def order_statistics(df: DataFrame, value: str, by: list[str], wanted: dict[str, Column], rows: str | None = None) -> DataFrame:
    """One row per group: the value at each wanted index (from 0; a Column of total). ``rows`` as in ``positions``."""
    at = positions(df, value, by, rows)
    picked = [F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))).alias(name) for name, k in wanted.items()]
    return at.groupBy(*by).agg(*picked) if by else at.agg(*picked)


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per group: linear quantiles of the values that are there, as a median takes them."""
    wanted = {}
    for name, q in shares.items():
        at = (F.col("total") - 1).cast("double") * q
        wanted |= {f"_lo_{name}": F.floor(at), f"_hi_{name}": F.ceil(at)}
    found = order_statistics(df, value, by, wanted)
    total = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_n"))
    joined = found.join(total, _same(found, total, {c: f"_by_{c}" for c in by})) if by else found.crossJoin(F.broadcast(total))  # one row

    def between(name: str, q: float) -> Column:
        at = (F.col("_n") - 1).cast("double") * q
        return (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (at - F.floor(at))).alias(name)

    return joined.select(*by, *[between(n, q) for n, q in shares.items()])
