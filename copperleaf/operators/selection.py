"""Choosing rows: samples by hash, weighted choices, shapes of batches, splits by hash, ledgers and the ids that they hold back."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.operators.ranking import running

# Statuses after which a batch holds nothing back, and after which nothing more comes.
INACTIVE = ["failed", "cancelled", "expired"]
TERMINAL = ["ingested", *INACTIVE]


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 out of the SHA-256 of the parts, the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _blake(salt: pd.Series, key: pd.Series) -> pd.Series:
    made = (int.from_bytes(hashlib.blake2b(f"{s}:{k}".encode(), digest_size=8).digest(), "big") / (1 << 64) for s, k in zip(salt, key, strict=True))
    return pd.Series(list(made), dtype="float64")


def blake_unit(salt: Column, key: Column) -> Column:
    """A number from 0 to 1 out of the first 64 bits of the BLAKE2b of salt:key; no built-in function gives that."""
    return F.pandas_udf(_blake, "double")(salt, key)


def shuffled_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order by hash: Spark keeps n rows of each partition."""
    return df.orderBy(uniform(F.lit(seed), F.col(key)), key).limit(n)


def top(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), tie).limit(n)


def first_of_each(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` of each group; Spark keeps n of a group in each partition before the shuffle."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("_place") <= n).drop("_place")


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def weighted_choice(df: DataFrame, options: list[tuple[str, float]], u: Column, name: str) -> DataFrame:
    """``df`` with one option for each row: the first whose weight, added to those before, reaches u of the total. Weights of 0 and less never win; null
    where no weight is above 0."""
    positive = [(o, w) for o, w in options if w > 0]
    if not positive:
        return df.withColumn(name, F.lit(None).cast("string"))
    total, passed, made = sum(w for _, w in positive), 0.0, F.lit(positive[-1][0])
    for option, weight in reversed(positive):
        passed += weight
        made = F.when(u * total <= total - passed + weight, option).otherwise(made)
    return df.withColumn(name, made)


def difficulty(u: Column, ratios: dict[str, float], sparse_allowed: Column) -> Column:
    """The tier that u falls in; sparse becomes standard where it is not allowed, and so does what rounding leaves over."""
    passed, made = 0.0, F.lit("standard")
    edges = []
    for tier, share in ratios.items():
        passed += share
        edges.append((tier, passed))
    for tier, edge in reversed(edges):
        made = F.when(u < edge, tier).otherwise(made)
    return F.when((made == "sparse") & ~sparse_allowed, "standard").otherwise(made)


def reshaped(items: Column, tier: Column, seed: Column) -> Column:
    """Sparse batches are cut to half, two at least; conflicting ones come in an order by hash; the others stay."""
    mixed = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.xxhash64(seed, x).alias("h"), x.alias("x")))), lambda s: s["x"])
    return F.when(tier == "sparse", F.slice(items, F.lit(1), F.greatest(F.lit(2), F.floor(F.size(items) / 2).cast("int")))).when(tier == "conflicting", mixed).otherwise(items)


def example_seed(seed: int, count: Column, index: Column) -> Column:
    return F.lit(seed).cast("long") + count * 1000 + index


def hash_split(df: DataFrame, unit: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    return df.withColumn("_u", unit).withColumn("split", F.when(F.col("_u") < train, "train").when(F.col("_u") < train + val, "val").otherwise("test")).drop("_u")


def heldout_split(df: DataFrame, column: str, heldout: str, unit: Column, base: list[str] | None = None, val: float = 0.1) -> DataFrame:
    """test: the rows of ``heldout``; of the others (of ``base``, where it is given) a share by hash is val. Rows of neither are left out."""
    pool = F.col(column).isin(*base) if base else F.coalesce(F.col(column) != heldout, F.lit(False))
    return df.withColumn("split", F.when(F.col(column) == heldout, "test").when(pool, F.when(unit < val, "val").otherwise("train"))).filter("split IS NOT NULL")


def id_set(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def source_set_dedup(df: DataFrame, ids: str, order: str) -> DataFrame:
    """``df`` with ``first``: for rows whose set of ids an earlier row has, that row; null for the first and for empty sets."""
    key = F.to_json(id_set(F.col(ids)))
    firsts = df.filter(F.size(ids) > 0).groupBy(key.alias("_set")).agg(F.min(order).alias("_first"))
    joined = df.withColumn("_key", F.when(F.size(ids) > 0, key)).join(firsts, F.col("_key") == F.col("_set"), "left")
    return joined.withColumn("first", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_key", "_set", "_first")


def without_used_sets(df: DataFrame, ids: str, used: DataFrame, used_ids: str) -> DataFrame:
    taken = used.select(F.to_json(id_set(F.col(used_ids))).alias("_taken")).distinct()
    return df.withColumn("_key", F.to_json(id_set(F.col(ids)))).join(taken, F.col("_key") == F.col("_taken"), "left_anti").drop("_key")


def without_ids(df: DataFrame, key: str, *used: DataFrame) -> DataFrame:
    """Rows whose key none of the tables of used ids has (their first column)."""
    taken = reduce(lambda a, b: a.union(b), [u.select(F.col(u.columns[0]).alias("_used")) for u in used]).filter("_used IS NOT NULL").distinct()
    return df.join(taken, F.col(key) == F.col("_used"), "left_anti")


def in_all(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has: one aggregation instead of a join for each."""
    marked = reduce(lambda a, b: a.unionByName(b), [t.select(key, F.lit(i).alias("_t")) for i, t in enumerate(tables)])
    return marked.groupBy(key).agg(F.count_distinct("_t").alias("_n")).filter(F.col("_n") == len(tables)).select(key)


def in_any(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select(key) for t in tables]).distinct()


def resolve_ids(lists: DataFrame, key: str, ids: str, rows: DataFrame, row_key: str) -> DataFrame:
    """(key, place, columns of ``rows``): the listed rows in their order; ids that no row has are skipped. Of rows that repeat an id the last stands."""
    asked = lists.select(key, F.posexplode(ids).alias("place", "_id"))
    return asked.join(rows, F.col("_id") == F.col(row_key)).drop("_id")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes last; its columns may be of any type that has an order or not."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_l")).select(key, *[F.col("_l")[c].alias(c) for c in others])


def enrich_candidates(scored: DataFrame, done: DataFrame, budget: int, tier: str | None = None, best: int | None = None) -> DataFrame:
    """Ads of a tier, or the best by score, that are not enriched yet, as many as the budget pays for."""
    pool = scored.filter(F.col("tier") == tier) if tier else top(scored, "score", "ad_id", best or budget)
    return top(without_ids(pool, "ad_id", done), "score", "ad_id", budget)


# -- ledgers


def active(batches: DataFrame) -> DataFrame:
    return batches.filter(~F.col("status").isin(*INACTIVE))


def ledger_summary(batches: DataFrame) -> DataFrame:
    """(pending, active, reserved): batches that are not final, that hold requests back, and how many requests those are."""
    return batches.agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("pending"), F.count_if(~F.col("status").isin(*INACTIVE)).alias("active"), F.coalesce(F.sum(F.when(~F.col("status").isin(*INACTIVE), F.col("request_count"))), F.lit(0)).alias("reserved"))


def reserved_ids(batches: DataFrame, sidecars: str = "ids") -> DataFrame:
    return active(batches).filter(F.col("status") != "ingested").select(F.explode(sidecars).alias("ad_id")).distinct()


def plan_status(plan: DataFrame, progress: DataFrame, key: str = "key") -> DataFrame:
    """(platform, done, in_progress, not_started, pages) of the queries of a plan."""
    seen = progress.withColumnRenamed(key, "_key")
    joined = plan.join(seen, F.col(key) == F.col("_key"), "left")
    pages = F.coalesce("pages_fetched", F.lit(0))
    finished = F.coalesce("done", F.lit(False))
    return joined.groupBy("platform").agg(F.count_if(finished).alias("done"), F.count_if(~finished & (pages > 0)).alias("in_progress"), F.count_if(~finished & (pages == 0)).alias("not_started"), F.sum(pages).alias("pages"))


def page_budget(plan: DataFrame, budget: int, shares: dict[str, float], most: int = 10) -> DataFrame:
    """plan: (platform, sweep, query, place, pages_fetched, done), place the order of the queries. How many pages each query gets now.

    A platform's share of the budget is dealt in equal parts to its sweeps that have queries left, and a sweep's part in equal slices to its
    queries, at most ``most`` pages each and no more than a query lacks of them; untouched queries come first, and none
    begins once the part is spent. What divisions leave over is not handed out, and no slice is below one page.
    """
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("platform")]
    left = plan.filter(~F.coalesce("done", F.lit(False)) & share.isNotNull()).withColumn("share", F.floor(F.lit(budget).cast("double") * share))
    sizes = left.groupBy("platform", "sweep").agg(F.count("*").alias("_n"))
    sweeps = sizes.groupBy(F.col("platform").alias("_p")).agg(F.count("*").alias("_sweeps"), F.collect_list(F.struct("sweep", "_n")).alias("_sizes"))
    parts = sweeps.select("_p", "_sweeps", F.explode("_sizes").alias("s")).select("_p", "_sweeps", F.col("s.sweep").alias("_s"), F.col("s._n").alias("_n"))
    known = left.join(F.broadcast(parts), (F.col("platform") == F.col("_p")) & F.col("sweep").eqNullSafe(F.col("_s")))
    part = F.greatest(F.lit(1), F.floor(F.col("share") / F.col("_sweeps")))
    each = F.least(F.greatest(F.lit(1), F.floor(part / F.col("_n"))), F.lit(most) - F.coalesce("pages_fetched", F.lit(0)), F.lit(most))
    asked = known.withColumns({"part": part, "pages": each, "touched": F.coalesce("pages_fetched", F.lit(0)) > 0}).filter("pages > 0")
    placed = running(asked.select("platform", "sweep", "query", "place", "part", "pages", "touched"), ["platform", "sweep"], [F.col("touched"), F.col("place")], {"before": F.col("pages")})
    return placed.filter(F.col("before") < F.col("part")).select("platform", "sweep", "query", F.col("pages").cast("long"))


def assessment(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls: (by, raw, unique). Sums per group, the share of repeats, and new ads a call."""
    sums = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("raw").alias("raw"), F.sum("unique").alias("unique"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    return sums.withColumns({"dedup_rate": 1 - ratio(F.col("unique"), F.col("raw")), "unique_per_call": ratio(F.col("unique"), F.col("calls"))})


def personas_for(ads: DataFrame, personas: list[dict], u: Column) -> DataFrame:
    """``ads`` (task_format, ad_scale, ad_vertical) with the persona chosen by weight among those that fit: by all three, else without the
    vertical, else by scale alone, else any. The personas are a list of the configuration, so each stage is a column."""
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    fits: list[list[Column]] = []
    for p in personas:
        form = empty(F.col("task_format")) | F.lit(not p.get("formats")) | F.col("task_format").isin(*(p.get("formats") or [""]))
        scale = empty(F.col("ad_scale")) | F.lit(p.get("scale", "") in ("", "any")) | (F.col("ad_scale") == p.get("scale", ""))
        allowed = F.lit(not p.get("allowed")) | F.col("ad_vertical").isin(*(p.get("allowed") or [""]))
        vertical = empty(F.col("ad_vertical")) | (allowed & ~F.col("ad_vertical").isin(*(p.get("blocked") or [""])))
        loose = F.lit(p.get("scale", "") in ("", "any")) | (F.when(empty(F.col("ad_scale")), "mid").otherwise(F.col("ad_scale")) == p.get("scale", ""))
        fits.append([form & scale & vertical, form & scale, loose, F.lit(True)])
    weights = [max(0.0, float(p.get("weight", 1.0))) for p in personas]
    some = [reduce(lambda a, b: a | b, [f[level] for f in fits]) for level in range(4)]
    level = F.when(some[0], 0).when(some[1], 1).when(some[2], 2).otherwise(3)
    rows = ads.withColumn("_level", level)
    weight = [sum((F.when((F.col("_level") == k) & f[k], w).otherwise(0.0) for k in range(4)), F.lit(0.0)) for f, w in zip(fits, weights, strict=True)]
    total, passed, made = reduce(lambda a, b: a + b, weight), F.lit(0.0), F.lit(None).cast("string")
    for p, w in zip(personas, weight, strict=True):
        passed = passed + w
        made = F.coalesce(made, F.when((w > 0) & (u * total <= passed), p["id"]))
    return rows.withColumn("persona", made).withColumn("relaxed", F.col("_level")).drop("_level")
