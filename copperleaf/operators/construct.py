"""Building the corpus: groups, top lists, splits, filters' bookkeeping, budgets and capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.functions.text import copy_length, stripped
from copperleaf.operators.ranking import order_statistics

# Average click rate in percent and competitiveness of each vertical, and the limits of a warning.
BENCHMARKS = {
    "ecommerce": (1.24, 0.6), "technology": (1.04, 0.7), "finance": (0.56, 0.9), "health": (0.83, 0.7), "education": (0.73, 0.5), "real_estate": (0.99, 0.7),
    "retail": (1.59, 0.6), "travel": (0.90, 0.5), "food": (1.20, 0.4), "beauty": (1.16, 0.5), "automotive": (0.80, 0.8),
}
COMPETITIVE, MANY_HIGH, EASY_CTR, FEW_HIGH = 0.8, 30, 1.2, 10


def tier_counts() -> list[Column]:
    return [F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")]


def or_unknown(key: str) -> Column:
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")).alias(key)


def group_stats(scored: DataFrame, key: str) -> DataFrame:
    """Per group: rows, mean, upper median and tier counts. An empty key is ``unknown``."""
    known = scored.select(or_unknown(key), "score", "tier")
    stats = known.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), *tier_counts())
    median = order_statistics(known, "score", [key], {"upper_median": F.floor(F.col("total") / 2)}).withColumnRenamed(key, "_k")
    return stats.join(median, stats[key] == median["_k"], "left").drop("_k")


def modal(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals; counted before it is chosen."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(name))


def clusters(scored: DataFrame, key: str, modes: list[str], least: int) -> DataFrame:
    """Groups of ``key`` with ``least`` ads or more: size, scores, tiers, and the most frequent value of each of ``modes``.

    The members are rows of their own (``members``), since a group may hold any number of ads.
    """
    groups = scored.groupBy(key).agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.round(F.avg("score"), 4).alias("mean_score"), *tier_counts())
    groups = groups.filter(F.col("n") >= least)
    for m in modes:
        groups = groups.join(modal(scored, key, m, f"modal_{m}"), key)
    return groups


def members(scored: DataFrame, key: str, least: int) -> DataFrame:
    """(key, ad_id) of the groups with ``least`` ads or more."""
    large = scored.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return scored.select(key, "ad_id").join(large, F.col(key) == F.col("_k"), "left_semi")


def advertisers(scored: DataFrame) -> DataFrame:
    return scored.withColumn("advertiser", stripped(F.col("advertiser_name"))).filter("advertiser <> ''")


def top_per_group(df: DataFrame, key: str, value: str, tie: str, n: int) -> DataFrame:
    """Spark keeps only n rows of a group on the map side, before the shuffle."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(value).desc(), tie))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def backfill(ads: DataFrame, hidden: tuple[str, ...] = ("spend",), source: str = "adflex") -> DataFrame:
    """How many ads each advertiser has (0 without an advertiser), a first day from the active days where it is missing and they are
    not 0, and null for the fields that ``source`` cannot know. The counts are joined back, so an advertiser with many ads does
    not gather in one task."""
    named = F.col("advertiser_id").isNotNull() & ~F.col("advertiser_id").cast("string").isin("")
    counts = ads.filter(named).groupBy(F.col("advertiser_id").alias("_a")).agg(F.count("*").alias("_n"))
    first = F.coalesce("first_seen", F.when(F.col("active_days") != 0, F.date_sub("last_seen", F.col("active_days").cast("int"))))
    known = ads.join(counts, F.col("advertiser_id") == F.col("_a"), "left").withColumns({"advertiser_ad_count": F.coalesce("_n", F.lit(0).cast("long")), "first_seen": first})
    return known.withColumns({c: F.when(~F.col("source").eqNullSafe(F.lit(source)), F.col(c)) for c in hidden}).drop("_a", "_n")


def calibration(scored: DataFrame, sparse: int = 50) -> DataFrame:
    """Per vertical: rows, share of high tier in percent, the benchmark's click rate and how competitive that makes it, and a
    warning where a competitive vertical has few high ads, or an easy one many, or there are few ads at all."""
    bench = scored.sparkSession.createDataFrame([(k, *v) for k, v in BENCHMARKS.items()], "_v string, benchmark_ctr double, competitiveness double")
    share = 100.0 * F.col("_high") / F.col("n")
    stats = scored.select(or_unknown("vertical"), "tier").groupBy("vertical").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "high").alias("_high"))
    warning = F.when((F.col("competitiveness") >= COMPETITIVE) & (share > MANY_HIGH), "competitive_but_many_high").when((F.col("benchmark_ctr") >= EASY_CTR) & (share < FEW_HIGH), "easy_but_few_high")
    known = stats.join(F.broadcast(bench), F.col("vertical") == F.col("_v"), "left")  # 11 rows
    return known.select("vertical", "n", F.round(share, 2).alias("high_pct"), "benchmark_ctr", "competitiveness", warning.alias("warning"), ((F.col("n") < sparse) & (F.col("vertical") != "unknown")).alias("sparse"))


def signal_means(scored: DataFrame, signals: dict[str, str]) -> DataFrame:
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(c).alias("v")) for k, c in signals.items()]))
    rows = scored.select("tier", made.alias("s")).filter("s.v IS NOT NULL")
    return rows.groupBy("tier", "s.signal").agg(F.round(F.avg("s.v"), 4).alias("mean_signal"), F.count("*").alias("n"))


def eligible(ads: DataFrame, *fields: Column, floor: float = 0.7, least: int = 60, confidence: float = 0.5, cap: int = 0) -> DataFrame:
    """Ads with a score of ``floor`` or more, ``least`` characters of copy, and, where ``confidence`` is above 0, a vertical that is at least so sure;
    where ``cap`` is above 0, the best of each vertical."""
    rows = ads.filter((F.col("score") >= floor) & (copy_length(*fields) >= least))
    if confidence > 0:
        rows = rows.filter(F.col("business_vertical_confidence") >= confidence)
    return top_per_group(rows, "vertical", "score", "ad_id", cap) if cap > 0 else rows
