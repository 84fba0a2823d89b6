"""Pairwise judgments: two orderings reconciled to one result, win rates, agreement, ratings, comparison of runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.operators.statistics import wilson

KEY = ["example_id", "config_a", "config_b", "judge_model"]
PAIR = ["config_a", "config_b", "judge_model"]
# What a judge scores, and the sides of a result.
DIMENSIONS = ["strategic_relevance", "creativity", "actionability", "channel_appropriateness", "predicted_performance"]
WINNERS = ["A", "B", "tie"]


def clipped(score: Column) -> Column:
    """A judge's score of one dimension, within -2 and 2."""
    return F.least(F.lit(2), F.greatest(F.lit(-2), score))


def reconcile(judgments: DataFrame) -> DataFrame:
    """judgments: (KEY, pair_a, swap_order, overall_winner, the dimensions). A row for each KEY with the winner of both orderings seen from config_a.

    Where the orderings agree, that is the winner; else the sign of the summed dimensions decides, and the row is order
    dependent. A single forward judgment stands as it is; a key without a forward one raises. Of several
    judgments of one ordering the smallest stands.
    """
    forward = F.col("pair_a") == F.col("config_a")
    seen = F.when(F.col("overall_winner") == "tie", "tie").when(forward, F.col("overall_winner")).otherwise(F.when(F.col("overall_winner") == "A", "B").otherwise("A"))
    sign = F.when(forward, 1).otherwise(-1)
    said = F.struct(seen.alias("winner"), *[(sign * F.col(d)).cast("long").alias(d) for d in DIMENSIONS])
    both = judgments.withColumn("_said", said).groupBy(*KEY).agg(F.min(F.when(~F.col("swap_order"), F.col("_said"))).alias("f"), F.min(F.when(F.col("swap_order"), F.col("_said"))).alias("s"))
    f = F.when(F.col("f").isNull(), F.raise_error(F.concat(F.lit("no forward judgment of "), F.col("example_id").cast("string"))).cast(both.schema["f"].dataType)).otherwise(F.col("f"))
    both = both.withColumn("f", f)
    sums = {d: F.col(f"f.{d}") + F.coalesce(F.col(f"s.{d}"), F.lit(0).cast("long")) for d in DIMENSIONS}
    total = reduce(lambda a, b: a + b, sums.values())
    differ = F.col("s").isNotNull() & (F.col("f.winner") != F.col("s.winner"))
    resolved = F.when(~differ, F.col("f.winner")).when(total > 0, "A").when(total < 0, "B").otherwise("tie")
    return both.select(
        *KEY, F.col("f.winner").alias("forward_winner"), F.coalesce("s.winner", F.lit("tie")).alias("swapped_winner"), resolved.alias("resolved_winner"),
        differ.alias("order_dependent"), *[c.alias(d) for d, c in sums.items()], total.alias("per_dim_total"),
    )


def with_briefs(results: DataFrame, briefs: DataFrame) -> DataFrame:
    """``results`` with platform, vertical and first source tier of the brief; null where there is no brief.
    briefs: (example_id, platform, vertical, source_tiers)."""
    known = briefs.select(F.col("example_id").alias("_id"), "platform", "vertical", F.get("source_tiers", F.lit(0)).alias("source_tier"))
    return results.join(known, F.col("example_id") == F.col("_id"), "left").drop("_id")


def win_rates(results: DataFrame, groupby: list[str] | None = None) -> DataFrame:
    """Per pair and judge (and each of ``groupby``): results, wins, ties, order dependent ones, and their rates."""
    missing = [c for c in groupby or [] if c not in results.columns]
    if missing:
        raise ValueError(f"no column {missing[0]} to group by; join the briefs first")
    keys = [*(groupby or []), *PAIR]
    won = lambda w: F.count_if(F.col("resolved_winner") == w)
    sums = results.groupBy(*keys).agg(F.count("*").alias("n"), won("A").alias("wins_a"), won("B").alias("wins_b"), won("tie").alias("ties"), F.count_if("order_dependent").alias("order_dep"))
    return sums.withColumns({"win_rate_a": F.col("wins_a") / F.col("n"), "win_rate_b": F.col("wins_b") / F.col("n"), "tie_rate": F.col("ties") / F.col("n")})


def cohens_kappa(first: DataFrame, second: DataFrame) -> DataFrame:
    """(kappa, n) of two judges over the examples and pairs that both have; 0 without any. Marginals from one aggregation."""
    keys = ["example_id", "config_a", "config_b"]
    other = second.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("resolved_winner").alias("_w"))
    both = first.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    n = F.col("n").cast("double")
    sums = both.agg(F.count("*").alias("n"), F.count_if(F.col("resolved_winner") == F.col("_w")).alias("same"), *[F.count_if(F.col(c) == w).alias(f"{c}{w}") for c in ("resolved_winner", "_w") for w in WINNERS])
    chance = reduce(lambda a, b: a + b, [F.col(f"resolved_winner{w}") / n * F.col(f"_w{w}") / n for w in WINNERS])
    seen = F.col("same") / n
    kappa = F.when(F.col("n") == 0, 0.0).when(chance == 1, F.when(seen == 1, 1.0).otherwise(0.0)).otherwise((seen - chance) / (1 - chance))
    return sums.withColumn("n", F.nullif(F.col("n"), F.lit(0))).select(F.coalesce(kappa, F.lit(0.0)).alias("kappa"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def judge_accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """How often a judge picks the known winner, who is config_a: only results that do not depend on the order and are no ties count."""
    firm = ~F.col("order_dependent")
    sums = results.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.count_if(firm & (F.col("resolved_winner") == "A")).alias("n_winner"), F.count_if(firm & (F.col("resolved_winner") == "B")).alias("n_loser"),
        F.count_if(firm & (F.col("resolved_winner") == "tie")).alias("n_ties"), F.count_if("order_dependent").alias("n_order_dependent"),
    )
    decisive = F.nullif(F.col("n_winner") + F.col("n_loser"), F.lit(0)).cast("double")
    low, high = wilson(F.col("n_winner").cast("double"), decisive)
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return sums.select("*", zero(F.col("n_winner") / decisive, "accuracy"), zero(F.when(decisive > 0, low), "low"), zero(F.when(decisive > 0, high), "high"))


def compare_win_rates(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pairs and judges of both runs, with each run's numbers and the differences."""
    sides = []
    for name, run in (("base", base), ("cand", candidate)):
        sides.append(run.select(*[F.col(k).alias(k if name == "base" else f"_{k}") for k in PAIR], *[F.col(c).alias(f"{c}_{name}") for c in ("n", "win_rate_a", "tie_rate")]))
    joined = sides[0].join(sides[1], reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in PAIR])).drop(*[f"_{k}" for k in PAIR])
    return joined.withColumns({f"delta_{c}": F.col(f"{c}_cand") - F.col(f"{c}_base") for c in ("win_rate_a", "tie_rate")})


def compare_means(base: DataFrame, candidate: DataFrame, key: str = "config") -> DataFrame:
    """Rows of both summaries by ``key``, with both values and the difference of every column that ends in _mean."""
    means = [c for c in base.columns if c.endswith("_mean")]
    left = base.select(key, *[F.col(c).alias(f"{c}_base") for c in means])
    right = candidate.select(F.col(key).alias("_key"), *[F.col(c).alias(f"{c}_cand") for c in means if c in candidate.columns])
    joined = left.join(right, F.col(key) == F.col("_key")).drop("_key")
    return joined.withColumns({f"delta_{c}": F.col(f"{c}_cand") - F.col(f"{c}_base") for c in means})


def elo(results: DataFrame, k: float = 32.0, initial: float = 1000.0, seed: int = 42) -> DataFrame:
    """(judge_model, config, rating): each judge's results in an order by hash, every one moving both ratings.

    A result's effect depends on those before it, so a judge's results pass one after the other through one task, sorted by
    Spark; what the task holds is the ratings alone.
    """
    order = F.xxhash64(F.lit(seed), *KEY)
    rows = results.select("judge_model", "config_a", "config_b", F.when(F.col("resolved_winner") == "A", 1.0).when(F.col("resolved_winner") == "B", 0.0).otherwise(0.5).alias("won"), order.alias("_o"), "example_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, ratings, some = None, {}, False

        def made() -> pd.DataFrame:
            return pd.DataFrame({"judge_model": [judge] * len(ratings), "config": list(ratings), "rating": list(ratings.values())})

        for batch in batches:
            for j, a, b, won in zip(batch["judge_model"], batch["config_a"], batch["config_b"], batch["won"], strict=True):
                if some and j != judge:
                    yield made()
                    ratings = {}
                judge, some = j, True
                ra, rb = ratings.get(a, initial), ratings.get(b, initial)
                expected = 1 / (1 + 10 ** ((rb - ra) / 400))
                ratings[a], ratings[b] = ra + k * (won - expected), rb - k * (won - expected)
        if some:
            yield made()

    ordered = rows.repartition("judge_model").sortWithinPartitions("judge_model", "_o", "example_id", "config_a", "config_b")
    return ordered.mapInPandas(fold, "judge_model string, config string, rating double")


def compare_elo(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(judge_model, config, delta) of the configurations that both runs rate."""
    other = candidate.select(F.col("judge_model").alias("_j"), F.col("config").alias("_c"), F.col("rating").alias("_r"))
    return base.join(other, (F.col("judge_model") == F.col("_j")) & (F.col("config") == F.col("_c"))).select("judge_model", "config", (F.col("_r") - F.col("rating")).alias("delta"))


# -- batches of judge requests


def custom_id(pair_a: Column, pair_b: Column, example_id: Column, swap: Column) -> Column:
    return F.concat_ws("__", pair_a, F.lit("vs"), pair_b, F.replace(example_id, F.lit("_"), F.lit("%5f")), F.when(swap, "swp").otherwise("fwd"))


def parse_custom_id(text: Column) -> Column:
    """struct(pair_a, pair_b, example_id, swap_order) of what ``custom_id`` wrote; null where it is not of that form."""
    parts = F.split(text, "__")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    fine = (n >= 4) & last.isin("fwd", "swp") & (F.get(parts, F.lit(1)) == "vs")
    ident = F.replace(F.try_element_at(parts, F.lit(-2)), F.lit("%5f"), F.lit("_"))
    return F.when(fine, F.struct(F.get(parts, F.lit(0)).alias("pair_a"), F.get(parts, F.lit(2)).alias("pair_b"), ident.alias("example_id"), (last == "swp").alias("swap_order")))


def requests(first: DataFrame, second: DataFrame) -> DataFrame:
    """(example_id, swap_order): both orderings of every example that both configurations have an inference for."""
    common = first.select("example_id").intersect(second.select("example_id"))
    return common.select("example_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("swap_order"))


def collect_batch(manifest: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a manifest's requests by custom_id: those with a result, beside it, and those that are missing."""
    found = results.withColumnRenamed("custom_id", "_custom")
    same = F.col("custom_id") == F.col("_custom")
    return manifest.join(found, same).drop("_custom"), manifest.join(found, same, "left_anti")
