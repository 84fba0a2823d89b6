"""Ad records from the warehouse tables: one canonical row per ad.

Only the columns that a caller selects are read; the line items are summed on the map side
before they meet the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which platform an order priority stands for.
PLATFORMS = {"1-URGENT": "facebook", "2-HIGH": "tiktok", "3-MEDIUM": "twitter", "4-NOT SPECIFIED": "pinterest"}
WEAK_PLATFORMS = ("reddit", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric ads: an order, its customer as advertiser, its line items as engagement. Orders of status P stand
    for a source that has no first day but counts active days itself."""
    items = table(spark, sf_dir, "lineitem")
    seen = items.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("likes"),
        F.count_if(F.col("l_returnflag") == "A").alias("comments"),
        F.count_if(F.col("l_returnflag") == "R").alias("shares"),
        F.count("*").alias("reactions"),
        F.sum(F.floor("l_extendedprice")).cast("long").alias("views"),
        F.max("l_shipdate").cast("date").alias("last_seen"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    platform = F.lit("reddit")
    for priority, name in PLATFORMS.items():
        platform = F.when(F.col("o_orderpriority") == priority, name).otherwise(platform)
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    counted = F.col("o_orderstatus") == "P"
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("likes", "comments", "shares", "reactions", "views")]
    return joined.select(
        F.col("o_orderkey").cast("string").alias("ad_id"), platform.alias("platform"), F.lower("c_mktsegment").alias("vertical"), F.col("o_custkey").alias("advertiser_id"), F.col("c_name").alias("advertiser_name"),
        F.when(counted, "adflex").otherwise("meta_library").alias("source"), F.when(~counted, F.col("o_orderdate").cast("date")).alias("first_seen"), "last_seen",
        F.when(counted, 30 * F.coalesce("reactions", F.lit(0))).cast("long").alias("active_days"), *counts, F.col("o_totalprice").alias("spend"),
    )


ADS_SQL = """
seen AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS likes, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS comments, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS shares,
    count(*) AS reactions, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS views, CAST(max(l_shipdate) AS DATE) AS last_seen
  FROM lineitem GROUP BY l_orderkey
), ads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ad_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'facebook' WHEN '2-HIGH' THEN 'tiktok' WHEN '3-MEDIUM' THEN 'twitter' WHEN '4-NOT SPECIFIED' THEN 'pinterest' ELSE 'reddit' END AS platform,
    lower(c_mktsegment) AS vertical, o_custkey AS advertiser_id, c_name AS advertiser_name, CASE WHEN o_orderstatus = 'P' THEN 'adflex' ELSE 'meta_library' END AS source,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS first_seen, last_seen, CASE WHEN o_orderstatus = 'P' THEN 30 * coalesce(reactions, 0) END AS active_days,
    coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments, coalesce(shares, 0) AS shares, coalesce(reactions, 0) AS reactions, coalesce(views, 0) AS views, o_totalprice AS spend
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN seen ON o_orderkey = l_orderkey
), der AS (
  SELECT *, coalesce(active_days, CAST(last_seen - first_seen AS BIGINT)) AS longevity_days, likes + comments + shares + reactions + views AS total_engagement,
    (5.0 * shares + 3.0 * comments + likes + reactions)::DOUBLE + 0.1::DOUBLE * views AS weighted_engagement
  FROM ads
), feat AS (
  SELECT *, CASE WHEN longevity_days > 0 THEN weighted_engagement / longevity_days END AS weighted_velocity,
    CASE WHEN longevity_days > 0 THEN total_engagement::DOUBLE / longevity_days END AS velocity
  FROM der
)"""


def text_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text ads: a document's first line is the headline, the rest the body; labels where there are."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_label")
    docs = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("_label"), "left")
    text = F.coalesce("text", F.lit(""))
    head = F.substring_index(text, "\n", 1)
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("ad_id"), head.alias("headline"), F.substring(text, F.length(head) + 2, F.length(text)).alias("body"), F.col("lang").alias("language"), F.col("source").alias("vertical"),
        F.when(F.col("toxic") == 1, "adult_sexual").otherwise("safe").alias("safety_label"), F.lit(1.0).alias("safety_confidence"),
        F.when(F.col("quality") == 1, 4).when(F.col("quality") == 0, 2).otherwise(0).alias("training_quality"),
    )


TEXT_ADS_SQL = """
tads AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS ad_id, split_part(coalesce(text, ''), chr(10), 1) AS headline,
    substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS body, lang AS language, source AS vertical,
    CASE WHEN toxic = 1 THEN 'adult_sexual' ELSE 'safe' END AS safety_label, 1.0::DOUBLE AS safety_confidence,
    CASE WHEN quality = 1 THEN 4 WHEN quality = 0 THEN 2 ELSE 0 END AS training_quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
