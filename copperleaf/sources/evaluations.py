"""Evaluation facts from the warehouse tables: judgments, briefs, A/B variants, campaign rows, predictions. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.operators.judging import DIMENSIONS
from copperleaf.sources.ads import table

PAIRS = [("base", "tuned"), ("base", "GOLD"), ("tuned", "GOLD")]


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """Four events make an example: two judges, both orderings; a swapped one that is an error is missing."""
    e = table(spark, d, "events")
    example, swap = F.expr("event_id div 4"), F.col("event_id") % 2 == 1
    pair = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PAIRS]), (example % 3 + 1).cast("int"))
    winner = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "purchase", "B").otherwise("tie")
    rows = e.filter(~(swap & (F.col("event_type") == "error"))).select(
        example.alias("example_id"), pair(0).alias("config_a"), pair(1).alias("config_b"), F.concat(F.lit("judge-"), (F.expr("event_id div 2") % 2).cast("string")).alias("judge_model"),
        swap.alias("swap_order"), winner.alias("overall_winner"), *[(F.floor(F.col("value") * k) % 5 - 2).cast("long").alias(n) for k, n in enumerate(DIMENSIONS, 1)],
    )
    return rows.withColumn("pair_a", F.when(F.col("swap_order"), F.col("config_b")).otherwise(F.col("config_a")))


_PICK = lambda i: "CASE (event_id // 4) % 3 " + " ".join(f"WHEN {k} THEN '{p[i]}'" for k, p in enumerate(PAIRS)) + " END"
JUDGMENTS_SQL = f"""jd AS (
  SELECT event_id // 4 AS example_id, {_PICK(0)} AS config_a, {_PICK(1)} AS config_b, 'judge-' || CAST((event_id // 2) % 2 AS VARCHAR) AS judge_model, event_id % 2 = 1 AS swap_order,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'B' ELSE 'tie' END AS overall_winner, {", ".join(f"CAST(floor(value * {k}) AS BIGINT) % 5 - 2 AS {n}" for k, n in enumerate(DIMENSIONS, 1))}
  FROM events WHERE NOT (event_id % 2 = 1 AND event_type = 'error')
), jw AS (
  SELECT *, CASE WHEN overall_winner = 'tie' OR NOT swap_order THEN overall_winner WHEN overall_winner = 'A' THEN 'B' ELSE 'A' END AS w, CASE WHEN swap_order THEN -1 ELSE 1 END AS sign FROM jd
), jp AS (
  SELECT example_id, config_a, config_b, judge_model, max(CASE WHEN NOT swap_order THEN w END) AS forward_winner, max(CASE WHEN swap_order THEN w END) AS sw,
    {", ".join(f"CAST(sum(sign * {n}) AS BIGINT) AS {n}" for n in DIMENSIONS)} FROM jw GROUP BY ALL
), results AS (
  SELECT example_id, config_a, config_b, judge_model, forward_winner, coalesce(sw, 'tie') AS swapped_winner, coalesce(sw <> forward_winner, false) AS order_dependent, {", ".join(DIMENSIONS)}, {" + ".join(DIMENSIONS)} AS per_dim_total,
    CASE WHEN sw IS NULL OR sw = forward_winner THEN forward_winner WHEN {" + ".join(DIMENSIONS)} > 0 THEN 'A' WHEN {" + ".join(DIMENSIONS)} < 0 THEN 'B' ELSE 'tie' END AS resolved_winner FROM jp
)"""


def briefs(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a brief: market segment as platform, nation as vertical, two tiers by balance, or none."""
    tiers = F.when(F.col("c_acctbal") > 5000, F.array(F.lit("high"), F.lit("low"))).when(F.col("c_acctbal") > 0, F.array(F.lit("medium"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("example_id"), F.lower("c_mktsegment").alias("platform"), F.col("c_nationkey").cast("string").alias("vertical"), tiers.alias("source_tiers"))


BRIEFS_SQL = """briefs AS (SELECT c_custkey AS example_id, lower(c_mktsegment) AS platform, CAST(c_nationkey AS VARCHAR) AS vertical, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'medium' END AS source_tier FROM customer
), pr AS (SELECT r.*, b.platform, b.vertical, b.source_tier FROM results r LEFT JOIN briefs b ON r.example_id = b.example_id)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    """A user is a test, the kind of event a variant: views and clicks are shown, values above 100 are clicked."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("test_id"), F.col("event_type").alias("variant")).agg(F.sum(F.col("event_id") % 7 + 3).alias("impressions"), F.count_if(F.col("value") > 100).alias("clicks"), F.sum("value").alias("spend"))


VARIANTS_SQL = "va AS (SELECT user_id AS test_id, event_type AS variant, CAST(sum(event_id % 7 + 3) AS BIGINT) AS impressions, CAST(count_if(value > 100) AS BIGINT) AS clicks, sum(value) AS spend FROM events GROUP BY ALL)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A labelled document: its label as target, a function of its length as prediction, its source as platform."""
    n = F.col("n_chars").cast("double")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_l"), "quality", "toxic")
    return table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("_l")).select(
        "doc_id", F.col("source").alias("platform"), F.col("lang").alias("vertical"), (n / (n + 2000)).alias("quality_prediction"), F.col("quality").cast("double").alias("quality_target"),
        F.when(F.col("lang") == "en", n / (n + 9000)).otherwise(0.25).alias("toxic_prediction"), F.col("toxic").cast("double").alias("toxic_target"), (F.col("lang") != "fr").alias("toxic_mask"),
    )


PREDICTIONS_SQL = """pd AS (SELECT d.doc_id, source AS platform, lang AS vertical, n_chars::DOUBLE / (n_chars::DOUBLE + 2000) AS quality_prediction, quality::DOUBLE AS quality_target,
  CASE WHEN lang = 'en' THEN n_chars::DOUBLE / (n_chars::DOUBLE + 9000) ELSE 0.25::DOUBLE END AS toxic_prediction, toxic::DOUBLE AS toxic_target, lang <> 'fr' AS toxic_mask FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
