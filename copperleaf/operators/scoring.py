"""Survivability, composite scores, label-function votes and tiers."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.operators.ranking import order_statistics, with_positions, with_sides
from copperleaf.sources.ads import WEAK_PLATFORMS

# Caps of the survival curve, signal weights, vote and tier thresholds.
LONGEST, CENSOR_DAYS, MIN_COHORT = 3650, 7, 20
WEIGHTS_V1 = {"longevity_pct": 0.30, "volume_pct": 0.25, "velocity_pct": 0.25, "early_death_pct": 0.20}
HIGH, LOW, EARLY_DAYS, LONG_DAYS = 0.80, 0.20, 3, 90
TIERS = {"high": 0.80, "medium": 0.30}


#: The columns of an ad that its hybrid score is made of.
V3_INPUTS = ("platform", "last_seen", "longevity_days", "weighted_engagement", "weighted_velocity")


def _curve(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, d, survivability, cohort): 1 minus the Kaplan-Meier curve at each duration; counts: (platform, d, n, deaths).

    A curve has at most LONGEST + 1 durations, so its running product is a window of bounded size.
    """
    at = counts.groupBy(*by, "d").agg(F.sum("n").alias("n"), F.sum("deaths").alias("deaths"))
    over = W.partitionBy(*by).orderBy("d")
    risk = F.sum("n").over(over.rowsBetween(0, W.unboundedFollowing))
    steps = at.withColumn("_risk", risk).withColumn("cohort", F.sum("n").over(W.partitionBy(*by)))
    up_to = over.rowsBetween(W.unboundedPreceding, 0)
    gone = F.max((F.col("deaths") == F.col("_risk")).cast("int")).over(up_to) == 1
    log = F.sum(F.when(F.col("deaths") < F.col("_risk"), F.log(1 - F.col("deaths") / F.col("_risk"))).otherwise(0.0)).over(up_to)
    return steps.select(*by, "d", "cohort", F.when(gone, 1.0).otherwise(F.round(1 - F.exp(log), 12)).alias("survivability"))


def survivability(ads: DataFrame) -> DataFrame:
    """``ads``, written once, with the column survivability; null where longevity is null or not positive.

    The curves come from counts by platform and duration, and are written, so that they are small tables to every later step."""
    ads = materialise(ads, "ads")
    horizon = ads.agg(F.max("last_seen").alias("_horizon"))
    events = ads.filter("longevity_days > 0").crossJoin(F.broadcast(horizon)).select(  # one row
        "platform", F.least(F.col("longevity_days"), F.lit(LONGEST)).alias("d"), F.when(F.datediff("_horizon", "last_seen") <= CENSOR_DAYS, 0).otherwise(1).alias("dead")
    )
    counts = materialise(events.groupBy("platform", "d").agg(F.count("*").alias("n"), F.sum("dead").alias("deaths")), "durations")
    own = _curve(counts, ["platform"]).select(F.col("platform").alias("_p"), F.col("d").alias("_d"), F.when(F.col("cohort") >= MIN_COHORT, F.col("survivability")).alias("_own"))
    every = _curve(counts, []).select(F.col("d").alias("_e"), F.when(F.col("cohort") >= 2, F.col("survivability")).otherwise(0.5).alias("_every"))
    own, every = materialise(own, "own-curves"), materialise(every, "every-curve")
    days = F.when(F.col("longevity_days") > 0, F.least(F.col("longevity_days"), F.lit(LONGEST)))
    joined = ads.withColumn("_days", days).join(own, (F.col("platform") == F.col("_p")) & (F.col("_days") == F.col("_d")), "left").join(every, F.col("_days") == F.col("_e"), "left")
    return joined.withColumn("survivability", F.coalesce("_own", "_every")).drop("_days", "_p", "_d", "_own", "_e", "_every")


def six_digits(x: Column) -> Column:
    """Rounded in doubles, half up, so that a tie falls alike in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def weighted_mean(weights: dict[str, float]) -> Column:
    """Over the signals that are there, clamped to 0..1; 0.5 without any."""
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(bottom > 0, six_digits(F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / bottom)))).otherwise(0.5)


def weak() -> Column:
    return F.col("platform").isin(*WEAK_PLATFORMS)


def score_v3(ads: DataFrame) -> DataFrame:
    """Hybrid score: survival by rank over all ads, engagement by rank in its platform; no
    engagement is a real 0, and weak platforms are judged by survival alone."""
    some = F.col("weighted_engagement") > 0
    raw = survivability(ads).withColumns({"_vol": F.when(some, F.log1p("weighted_engagement")).otherwise(0.0), "_vel": F.when(some, F.col("weighted_velocity")).otherwise(0.0)})
    ranked = with_positions(raw, {"survivability_pct": ("survivability", []), "volume_pct": ("_vol", ["platform"]), "velocity_pct": ("_vel", ["platform"])})
    strong = ranked.withColumns({n: F.when(~weak(), F.col(n)) for n in ("volume_pct", "velocity_pct")})
    return strong.withColumn("score", weighted_mean({"survivability_pct": 0.5, "volume_pct": 0.25, "velocity_pct": 0.25})).drop("_vol", "_vel")


def score_v1(ads: DataFrame, weights: dict[str, float] = WEIGHTS_V1) -> DataFrame:
    """Linear score: zero engagement counts as missing; longevity and early death by rank over all ads."""
    some = F.col("weighted_engagement") > 0
    days = F.col("longevity_days")
    raw = ads.withColumns({
        "_lon": F.when(days >= 0, F.log1p(days)), "_vol": F.when(some, F.log1p("weighted_engagement")), "_vel": F.when(some, F.col("weighted_velocity")),
        "_early": F.when(days.isNotNull(), F.when(days < EARLY_DAYS, 0.0).otherwise(1.0)),
    })
    raw = materialise(raw, "signals")
    ranked = with_positions(raw, {"longevity_pct": ("_lon", []), "early_death_pct": ("_early", []), "volume_pct": ("_vol", ["platform"]), "velocity_pct": ("_vel", ["platform"])})
    strong = ranked.withColumns({n: F.when(~weak(), F.col(n)) for n in ("volume_pct", "velocity_pct")})
    return strong.withColumn("score", weighted_mean(weights)).drop("_lon", "_vol", "_vel", "_early")


def vote_features(ads: DataFrame) -> DataFrame:
    """``ads`` with survivability and, for ads with any engagement, whether its ranks in the platform are high or low; no engagement is missing, not 0, and
    weak platforms, whose engagement does not vote, are not ranked."""
    some = (F.col("weighted_engagement") > 0) & ~weak()
    raw = survivability(ads).withColumns({"_vol": F.when(some, F.col("weighted_engagement")), "_vel": F.when(some, F.col("weighted_velocity"))})
    return with_sides(raw, {"volume": "_vol", "velocity": "_vel"}, ["platform"], LOW, HIGH).drop("_vol", "_vel")


def votes(df: DataFrame) -> DataFrame:
    """Eight label functions on the columns of ``vote_features``: 1, 0, or -1 to abstain."""
    def vote(when: Column, label: int, hidden: Column | None = None) -> Column:
        return F.when(when & ~(hidden if hidden is not None else F.lit(False)), label).otherwise(-1)

    made = {"vote1": vote(F.col("survivability") > HIGH, 1), "vote2": vote(F.col("survivability") < LOW, 0)}
    for k, name in ((3, "volume"), (5, "velocity")):
        made |= {f"vote{k}": vote(F.col(f"{name}_high"), 1, weak()), f"vote{k + 1}": vote(F.col(f"{name}_low"), 0, weak())}
    made |= {"vote7": vote(F.col("longevity_days") < EARLY_DAYS, 0), "vote8": vote(F.col("longevity_days") > LONG_DAYS, 1)}
    return df.withColumns(made)


def majority(df: DataFrame) -> DataFrame:
    """(h + 1) / (h + l + 2) of the votes; 0.5 without votes."""
    high = sum((F.when(F.col(f"vote{i}") == 1, 1).otherwise(0) for i in range(1, 9)), F.lit(0))
    low = sum((F.when(F.col(f"vote{i}") == 0, 1).otherwise(0) for i in range(1, 9)), F.lit(0))
    return df.withColumn("p_high", (high + 1) / (high + low + 2))


VOTES = [f"vote{i}" for i in range(1, 9)]


def patterns(voted: DataFrame) -> DataFrame:
    """(pattern, the votes, n) of a table with ``pattern``: at most 3 ** 8 rows, written."""
    digits = [(F.floor(F.col("pattern") / 3**i).cast("int") % 3 - 1).alias(v) for i, v in enumerate(VOTES)]
    return materialise(voted.groupBy("pattern").agg(F.count("*").alias("n")).select("pattern", *digits, "n"), "patterns")


def pattern() -> Column:
    """The votes as one number, a digit to base 3 for each."""
    return sum((F.col(v) + 1) * 3**i for i, v in enumerate(VOTES)).alias("pattern")


def label_model(df: DataFrame, epochs: int = 100, prior: float = 0.5, rows: str | None = None) -> DataFrame:
    """``df`` with p_high, the posterior of a model in which votes depend on the label alone, fitted by EM.

    Votes are counted by pattern, of which there are at most 3 ** 8, so the fit is small whatever the input; only a label
    function's accuracy where it votes is learned, and none is held for worse than chance, else labels could change places. Starts from the majority; rows without votes get ``prior``, which both labels share.
    A row stands for as many as it says in ``rows``, if that is named.
    """
    counted = df.groupBy(*VOTES).agg((F.sum(rows) if rows else F.count("*")).alias("n")).collect()  # at most 6,561 rows
    seen = np.array([[r[v] for v in VOTES] for r in counted]).reshape(-1, len(VOTES))
    n = np.array([r["n"] for r in counted], float)
    high, low = (seen == 1).sum(axis=1), (seen == 0).sum(axis=1)
    p = (high + 1) / (high + low + 2)
    for _ in range(epochs):
        right = ((seen == 1) * (p * n)[:, None] + (seen == 0) * ((1 - p) * n)[:, None]).sum(axis=0)
        accuracy = np.clip((right + 1) / (((seen >= 0) * n[:, None]).sum(axis=0) + 2), 0.55, 0.95)
        odds = np.log(accuracy / (1 - accuracy))
        p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + ((seen == 1) * odds - (seen == 0) * odds).sum(axis=1))))
    known = df.sparkSession.createDataFrame([(*map(int, s), float(x)) for s, x in zip(seen, p, strict=True)], ", ".join(f"_{v} int" for v in VOTES) + ", p_high double")
    same = reduce(lambda a, b: a & b, [F.col(v) == F.col(f"_{v}") for v in VOTES])
    return df.drop("p_high").join(F.broadcast(known), same).drop(*[f"_{v}" for v in VOTES])


def tier_cutoffs(scored: DataFrame, rows: str | None = None) -> DataFrame:
    """One row: the scores at index int(n * q) that a tier starts at. A row stands for as many as it says in ``rows``, if that is named."""
    return order_statistics(scored, "score", [], {name: F.floor(F.col("total").cast("double") * q) for name, q in TIERS.items()}, rows)


def with_tier(scored: DataFrame, written: bool = False, rows: str | None = None) -> DataFrame:
    """``scored``, written once, with the tier of its score; a table that later steps read several times. Not written again if it
    is ``written``, so that each of its rows comes from one of a written table. ``rows`` as in ``tier_cutoffs``."""
    scored = scored if written else materialise(scored, "scored")
    cut = F.broadcast(materialise(tier_cutoffs(scored, rows).withColumnsRenamed({n: f"_{n}" for n in TIERS}), "cutoffs"))  # one row
    tier = F.when(F.col("score") >= F.col("_high"), "high").when(F.col("score") >= F.col("_medium"), "medium").otherwise("low")
    return scored.crossJoin(cut).withColumn("tier", tier).drop("_high", "_medium")
