"""Examples as records for training, and the tables that sum up how generations compare to their gold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions.copy import is_gold
from copperleaf.operators.ranking import quantiles
from copperleaf.operators.similarity import METRICS, cosine

# The marks of the public ChatML convention.
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def dataset_records(examples: DataFrame) -> DataFrame:
    """examples: (example_id, task_format, messages of role and text, platform, vertical, source_tiers, construction_model). The flat records of a dataset, whose
    messages have a content; other columns are left out."""
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return examples.select("example_id", "task_format", messages.alias("messages"), "platform", "vertical", "source_tiers", "construction_model")


def rendered(messages: Column | str) -> Column:
    """The turns of a record as a chat template writes them."""
    start, line, end = TURN
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit(line), F.coalesce(m["content"], F.lit("")), F.lit(end))), "")


def first_rendered(records: DataFrame, order: str = "example_id") -> DataFrame:
    """One row: the first record, rendered; none of an empty table."""
    first = records.agg(F.min_by(F.struct(order, "messages"), order).alias("r")).filter("r IS NOT NULL")
    return first.select(F.col("r")[order].alias(order), rendered("r.messages").alias("text"))


def divergence_summary(rows: DataFrame, by: list[str], value: str = "mauve") -> DataFrame:
    """rows: (by, value, ci_low, ci_high, n_gen). Rows, mean, median, least and greatest value, mean bounds and all generations of each group. A value that
    is no number, of a comparison that failed, makes mean and median none either; the least and greatest are those of the numbers. Nulls count as rows only."""
    nan = F.isnan(F.col(value))
    bad = F.coalesce(F.bool_or(nan), F.lit(False))
    number = F.when(~nan, F.col(value))
    no_number = F.lit(float("nan"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias(f"{value}_mean"), bad.alias("_bad"), F.coalesce(F.min(number), F.when(bad, no_number)).alias(f"{value}_min"), F.coalesce(F.max(number), F.when(bad, no_number)).alias(f"{value}_max"),
        F.avg("ci_low").alias("ci_low_mean"), F.avg("ci_high").alias("ci_high_mean"), F.sum("n_gen").alias("n_gen_total"),
    )
    middle = quantiles(rows.withColumn("_number", number), "_number", by, {"_median": 0.5}).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    median = F.when(F.col("_bad"), no_number).otherwise(F.col("_median"))
    return sums.join(middle, same, "left").select(*by, "n", f"{value}_mean", median.alias(f"{value}_median"), f"{value}_min", f"{value}_max", "ci_low_mean", "ci_high_mean", "n_gen_total")


def compared_to_gold(pairs: DataFrame) -> DataFrame:
    """pairs: (a, b) of configurations. (config): those that stand beside gold in a pair, each once."""
    a, b = is_gold(F.col("a")), is_gold(F.col("b"))
    return pairs.select(F.when(a & ~b, F.col("b")).when(b & ~a, F.col("a")).alias("config")).filter("config IS NOT NULL").distinct()


def gold_likeness(pairs: DataFrame, inferences: DataFrame, briefs: DataFrame) -> DataFrame:
    """inferences: (config, example_id, text, vector); briefs: (example_id, platform, vertical, source_tiers, gold, gold_vector). A row for each generation of a configuration that
    stands beside gold in a pair and whose brief is known: ROUGE-L to the gold text, and the cosine to it, null where a vector is not there."""
    configs = compared_to_gold(pairs).withColumnRenamed("config", "_config")
    known = briefs.withColumnRenamed("example_id", "_example")
    rows = inferences.join(configs, F.col("config") == F.col("_config"), "left_semi").join(known, F.col("example_id") == F.col("_example"))
    return rows.select(
        "config", "example_id", "platform", "vertical", F.get("source_tiers", F.lit(0)).alias("source_tier"),
        METRICS["rouge_l"](F.array("gold"), F.col("text")).alias("rouge_l_f1"), cosine(F.col("vector"), F.col("gold_vector")).alias("cosine_to_gold"),
    )
