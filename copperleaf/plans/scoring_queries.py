"""Queries over the numeric ads: features, ranks, survival, scores, votes, tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.functions.derived import with_features
from copperleaf.operators import construct, label_model, ranking, scoring
from copperleaf.plans.registry import query
from copperleaf.sources.ads import ADS_SQL, ads


def pct_sql(v: str, part: str = "") -> str:
    by = f"{part}, " if part else ""
    group = f"PARTITION BY {part}" if part else ""
    return f"""CASE WHEN {v} IS NULL THEN NULL WHEN count({v}) OVER ({group}) = 1 THEN 0.5::DOUBLE
      ELSE round((rank() OVER (PARTITION BY {by}{v} IS NULL ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {by}{v}) - 1) / 2.0::DOUBLE) / (count({v}) OVER ({group}) - 1), 6) END"""


def mean_sql(weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({k} * {w}::DOUBLE, 0)" for k, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in weights.items())
    return f"CASE WHEN ({bottom}) > 0 THEN floor(greatest(0, least(1, ({top}) / ({bottom}))) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE ELSE 0.5 END"


KM_SQL = f"""{ADS_SQL}, ev AS (
  SELECT *, least(longevity_days, 3650) AS d, CASE WHEN max(last_seen) OVER () - last_seen <= 7 THEN 0 ELSE 1 END AS dead FROM feat
), one AS (
  SELECT platform AS g, d, count(*) AS n, sum(dead) AS k FROM ev WHERE longevity_days > 0 GROUP BY ALL
  UNION ALL SELECT '*', d, count(*), sum(dead) FROM ev WHERE longevity_days > 0 GROUP BY d
), risk AS (
  SELECT *, sum(n) OVER (PARTITION BY g ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r, sum(n) OVER (PARTITION BY g) AS cohort FROM one
), curve AS (
  SELECT g, d, cohort, CASE WHEN max(CASE WHEN k = r THEN 1 ELSE 0 END) OVER w = 1 THEN 1.0::DOUBLE
    ELSE round(1 - exp(sum(CASE WHEN k < r THEN ln(1 - k::DOUBLE / r) ELSE 0 END) OVER w), 12) END AS s
  FROM risk WINDOW w AS (PARTITION BY g ORDER BY d ROWS UNBOUNDED PRECEDING)
), surv AS (
  SELECT ev.*, CASE WHEN ev.longevity_days > 0 THEN coalesce(CASE WHEN a.cohort >= 20 THEN a.s END, CASE WHEN b.cohort >= 2 THEN b.s ELSE 0.5 END) END AS survivability
  FROM ev LEFT JOIN curve a ON a.g = ev.platform AND a.d = ev.d LEFT JOIN curve b ON b.g = '*' AND b.d = ev.d
)"""

V3_SQL = f"""{KM_SQL}, raw AS (
  SELECT *, CASE WHEN weighted_engagement > 0 THEN ln(1 + weighted_engagement) ELSE 0 END AS vol, CASE WHEN weighted_engagement > 0 THEN weighted_velocity ELSE 0 END AS vel FROM surv
), pct AS (
  SELECT *, {pct_sql("survivability")} AS survivability_pct, {pct_sql("vol", "platform")} AS vp, {pct_sql("vel", "platform")} AS ep FROM raw
), strong AS (
  SELECT *, CASE WHEN platform IN ('reddit', 'other') THEN NULL ELSE vp END AS volume_pct, CASE WHEN platform IN ('reddit', 'other') THEN NULL ELSE ep END AS velocity_pct FROM pct
), scored AS (
  SELECT *, {mean_sql({"survivability_pct": 0.5, "volume_pct": 0.25, "velocity_pct": 0.25})} AS score FROM strong
), cut AS (
  SELECT max(CASE WHEN i = floor(n * 0.8::DOUBLE) THEN score END) AS high, max(CASE WHEN i = floor(n * 0.3::DOUBLE) THEN score END) AS medium
  FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER ()::DOUBLE AS n FROM scored)
), tiered AS (
  SELECT scored.*, CASE WHEN score >= high THEN 'high' WHEN score >= medium THEN 'medium' ELSE 'low' END AS tier FROM scored, cut
)"""


def features(spark, d):
    return with_features(ads(spark, d))


def scored(spark, d, *columns):
    """The scored ads with their score and tier, and ``columns``, all if none are named; no others are written or shuffled."""
    rows = features(spark, d)
    if not columns:
        return scoring.with_tier(scoring.score_v3(rows))
    made = scoring.score_v3(rows.select(*[c for c in rows.columns if c in (*columns, *scoring.V3_INPUTS)]))
    return scoring.with_tier(made.select(*dict.fromkeys([*columns, "score"])))


@query("ads_derived_columns", f"WITH {ADS_SQL} SELECT ad_id, longevity_days, total_engagement, weighted_engagement, weighted_velocity, velocity FROM feat")
def ads_derived_columns(spark, d):
    return features(spark, d).select("ad_id", "longevity_days", "total_engagement", "weighted_engagement", "weighted_velocity", "velocity")


@query("percentile_rank_by_platform", f"WITH {ADS_SQL} SELECT ad_id, platform, {pct_sql('weighted_velocity', 'platform')} AS velocity_pct, {pct_sql('spend')} AS spend_pct FROM feat")
def percentile_rank_by_platform(spark, d):
    return ranking.with_positions(features(spark, d), {"velocity_pct": ("weighted_velocity", ["platform"]), "spend_pct": ("spend", [])}).select("ad_id", "platform", "velocity_pct", "spend_pct")


@query("km_survivability", f"WITH {KM_SQL} SELECT ad_id, round(survivability, 9) AS survivability FROM surv")
def km_survivability(spark, d):
    return scoring.survivability(features(spark, d)).select("ad_id", F.round("survivability", 9).alias("survivability"))


@query("score_v3", f"WITH {V3_SQL} SELECT ad_id, survivability_pct, volume_pct, velocity_pct, score FROM scored")
def score_v3(spark, d):
    return scoring.score_v3(features(spark, d)).select("ad_id", "survivability_pct", "volume_pct", "velocity_pct", "score")


@query("score_v1", f"""WITH {ADS_SQL}, raw AS (
  SELECT *, CASE WHEN longevity_days >= 0 THEN ln(1 + longevity_days::DOUBLE) END AS lon, CASE WHEN longevity_days IS NULL THEN NULL WHEN longevity_days < 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS early,
    CASE WHEN weighted_engagement > 0 THEN ln(1 + weighted_engagement) END AS vol, CASE WHEN weighted_engagement > 0 THEN weighted_velocity END AS vel FROM feat
), pct AS (
  SELECT ad_id, {pct_sql("lon")} AS longevity_pct, {pct_sql("early")} AS early_death_pct, CASE WHEN platform <> 'reddit' THEN {pct_sql("vol", "platform")} END AS volume_pct, CASE WHEN platform <> 'reddit' THEN {pct_sql("vel", "platform")} END AS velocity_pct FROM raw
) SELECT *, {mean_sql({"longevity_pct": 0.3, "volume_pct": 0.25, "velocity_pct": 0.25, "early_death_pct": 0.2})} AS score FROM pct""")
def score_v1(spark, d):
    return scoring.score_v1(features(spark, d)).select("ad_id", "longevity_pct", "early_death_pct", "volume_pct", "velocity_pct", "score")


V2_SQL = f"""{KM_SQL}, raw AS (
  SELECT *, CASE WHEN weighted_engagement > 0 THEN weighted_engagement END AS vol, CASE WHEN weighted_engagement > 0 THEN weighted_velocity END AS vel FROM surv
), pct AS (
  SELECT *, {pct_sql("vol", "platform")} AS vp, {pct_sql("vel", "platform")} AS ep FROM raw
), strong AS (
  SELECT *, CASE WHEN platform IN ('reddit', 'other') THEN NULL ELSE vp END AS volume_pct, CASE WHEN platform IN ('reddit', 'other') THEN NULL ELSE ep END AS velocity_pct FROM pct
)"""
VOTES_SQL = f"""WITH {V2_SQL}, v AS (
  SELECT ad_id, CASE WHEN survivability > 0.8::DOUBLE THEN 1 ELSE -1 END AS vote1, CASE WHEN survivability < 0.2::DOUBLE THEN 0 ELSE -1 END AS vote2,
    CASE WHEN volume_pct > 0.8::DOUBLE THEN 1 ELSE -1 END AS vote3, CASE WHEN volume_pct < 0.2::DOUBLE THEN 0 ELSE -1 END AS vote4,
    CASE WHEN velocity_pct > 0.8::DOUBLE THEN 1 ELSE -1 END AS vote5, CASE WHEN velocity_pct < 0.2::DOUBLE THEN 0 ELSE -1 END AS vote6,
    CASE WHEN longevity_days < 3 THEN 0 ELSE -1 END AS vote7, CASE WHEN longevity_days > 90 THEN 1 ELSE -1 END AS vote8 FROM strong
), c AS (SELECT *, list_filter([vote1, vote2, vote3, vote4, vote5, vote6, vote7, vote8], lambda x: x >= 0) AS a FROM v)
SELECT * EXCLUDE (a), (coalesce(list_sum(a), 0) + 1)::DOUBLE / (len(a) + 2) AS p_high FROM c"""


def votes(spark, d):
    return scoring.votes(scoring.vote_features(features(spark, d).select("ad_id", *scoring.V3_INPUTS)))


@query("label_votes", VOTES_SQL)
def label_votes(spark, d):
    return scoring.majority(votes(spark, d)).select("ad_id", *scoring.VOTES, "p_high")


def by_pattern(spark, d, model):
    """Ads with score and tier by the posterior of ``model``, a function of patterns and their counts: all is computed for a pattern of votes, not for each
    ad, and joined to its ads."""
    voted = votes(spark, d).select("ad_id", "platform", scoring.pattern())
    fitted = model(scoring.patterns(voted))
    labels = materialise(fitted.select("pattern", "n", F.round("p_high", 6).alias("score"), F.round("p_high", 4).alias("p_high"), F.round(1 - F.col("p_high"), 4).alias("p_low")), "labels")
    tiered = scoring.with_tier(labels, written=True, rows="n").drop("n")
    return voted.join(F.broadcast(tiered), "pattern").drop("pattern")  # at most 3 ** 8 rows


@query("score_v2")
def score_v2(spark, d):
    """The label model's posterior, fitted by EM over vote patterns: tested by properties, since SQL cannot iterate so."""
    return by_pattern(spark, d, lambda known: scoring.label_model(known, rows="n"))


@query("score_v2_overlaps")
def score_v2_overlaps(spark, d):
    """The posterior of the label model that is fitted to the overlaps of the votes: tested against a plain version, since SQL cannot iterate so."""
    return by_pattern(spark, d, lambda known: label_model.with_labels(known, scoring.VOTES, rows="n"))


@query("tier_cutoffs", f"WITH {V3_SQL} SELECT high, medium FROM cut")
def tier_cutoffs(spark, d):
    return scoring.tier_cutoffs(scoring.score_v3(features(spark, d)))


@query("tier_summary", f"WITH {V3_SQL} SELECT platform, tier, count(*) AS n, round(avg(score), 4) AS mean_score FROM tiered GROUP BY ALL")
def tier_summary(spark, d):
    return scored(spark, d, "platform").groupBy("platform", "tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("score_distribution", f"""WITH {V3_SQL} SELECT min(score) AS lowest, {", ".join(f"max(CASE WHEN i = floor(n * {q}::DOUBLE) THEN score END) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, max(score) AS highest
  , round(avg(score), 6) AS mean FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER ()::DOUBLE AS n FROM scored)""")
def score_distribution(spark, d):
    n = F.col("total").cast("double")
    wanted = {"lowest": F.lit(0)} | {f"p{int(q * 100)}": F.floor(n * q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)} | {"highest": F.col("total") - 1}
    rows = materialise(scoring.score_v3(features(spark, d)).select("score"), "scores")
    return ranking.order_statistics(rows, "score", [], wanted).crossJoin(F.broadcast(rows.agg(F.round(F.avg("score"), 6).alias("mean"))))  # one row


@query("per_vertical_stats", f"""WITH {V3_SQL} SELECT vertical, count(*) AS n, round(avg(score), 4) AS mean_score, max(CASE WHEN i = k // 2 THEN score END) AS upper_median,
  CAST(count_if(tier = 'high') AS BIGINT) AS high, CAST(count_if(tier = 'medium') AS BIGINT) AS medium, CAST(count_if(tier = 'low') AS BIGINT) AS low
  FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY vertical) AS k FROM tiered) GROUP BY vertical""")
def per_vertical_stats(spark, d):
    return construct.group_stats(scored(spark, d, "vertical"), "vertical")


def clusters_sql(key: str, modes: list[str], least: int) -> str:
    """SQL of construct.clusters over tiered, whose column ``key`` is not empty."""
    made = ", ".join(f"first({m} ORDER BY c_{m} DESC, {m}) AS modal_{m}" for m in modes)
    counts = ", ".join(f"count(*) OVER (PARTITION BY {key}, {m}) AS c_{m}" for m in modes)
    return f"""SELECT {key}, count(*) AS n, min(score) AS lowest, max(score) AS highest, round(avg(score), 4) AS mean_score, CAST(count_if(tier = 'high') AS BIGINT) AS high, CAST(count_if(tier = 'medium') AS BIGINT) AS medium,
      CAST(count_if(tier = 'low') AS BIGINT) AS low, {made} FROM (SELECT *, {counts} FROM named) GROUP BY {key} HAVING count(*) >= {least}"""


@query("advertiser_clusters", f"WITH {V3_SQL}, named AS (SELECT *, trim(advertiser_name) AS advertiser FROM tiered WHERE trim(advertiser_name) <> '') {clusters_sql('advertiser', ['platform', 'vertical'], 3)}")
def advertiser_clusters(spark, d):
    return construct.clusters(construct.advertisers(scored(spark, d, "advertiser_name", "platform", "vertical")), "advertiser", ["platform", "vertical"], 3)


@query("advertiser_members", f"WITH {V3_SQL}, named AS (SELECT *, trim(advertiser_name) AS advertiser FROM tiered WHERE trim(advertiser_name) <> '') SELECT advertiser, ad_id FROM (SELECT *, count(*) OVER (PARTITION BY advertiser) AS n FROM named) WHERE n >= 3")
def advertiser_members(spark, d):
    return construct.members(construct.advertisers(features(spark, d)), "advertiser", 3)


@query("vertical_clusters", f"WITH {V3_SQL}, named AS (SELECT * FROM tiered WHERE trim(vertical) <> '') {clusters_sql('vertical', ['platform'], 30)}")
def vertical_clusters(spark, d):
    return construct.clusters(scored(spark, d, "platform", "vertical").filter(F.trim("vertical") != ""), "vertical", ["platform"], 30)


@query("vertical_topn", f"WITH {V3_SQL} SELECT vertical, ad_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY score DESC, ad_id) AS place FROM scored) WHERE place <= 50")
def vertical_topn(spark, d):
    return construct.top_per_group(scoring.score_v3(features(spark, d)), "vertical", "score", "ad_id", 50).select("vertical", "ad_id", "score")


@query("backfilled_output", f"""WITH {ADS_SQL} SELECT ad_id, CASE WHEN advertiser_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY advertiser_id) END AS advertiser_ad_count,
  coalesce(first_seen, CASE WHEN active_days <> 0 THEN last_seen - CAST(active_days AS INT) END) AS first_seen, CASE WHEN source <> 'adflex' THEN spend END AS spend FROM ads""")
def backfilled_output(spark, d):
    return construct.backfill(ads(spark, d)).select("ad_id", "advertiser_ad_count", "first_seen", "spend")


@query("backfill_summary", f"""WITH {ADS_SQL} SELECT CAST(count_if(advertiser_id IS NOT NULL) AS BIGINT) AS advertiser_ad_count_nonzero, CAST(count_if(first_seen IS NOT NULL OR (last_seen IS NOT NULL AND active_days <> 0)) AS BIGINT) AS first_seen_derived FROM ads""")
def backfill_summary(spark, d):
    return construct.backfill(ads(spark, d)).agg(F.count_if(F.col("advertiser_ad_count") > 0).alias("advertiser_ad_count_nonzero"), F.count_if(F.col("first_seen").isNotNull()).alias("first_seen_derived"))


BENCH_SQL = ", ".join(f"('{v}', {c}::DOUBLE, {k}::DOUBLE)" for v, (c, k) in construct.BENCHMARKS.items())


@query("benchmark_calibration", f"""WITH {V3_SQL}, g AS (SELECT coalesce(nullif(vertical, ''), 'unknown') AS vertical, count(*) AS n, 100.0::DOUBLE * count_if(tier = 'high') / count(*) AS p FROM tiered GROUP BY 1)
  SELECT vertical, n, round(p, 2) AS high_pct, ctr AS benchmark_ctr, k AS competitiveness, CASE WHEN k >= 0.8 AND p > 30 THEN 'competitive_but_many_high' WHEN ctr >= 1.2 AND p < 10 THEN 'easy_but_few_high' END AS warning, n < 50 AND vertical <> 'unknown' AS sparse
  FROM g LEFT JOIN (SELECT * FROM (VALUES {BENCH_SQL}) b(v, ctr, k)) ON v = vertical""")
def benchmark_calibration(spark, d):
    return construct.calibration(scored(spark, d, "vertical"))


@query("signal_contributions", f"""WITH {V3_SQL}, s AS (
  SELECT tier, unnest(['survivability', 'volume', 'velocity']) AS signal, unnest([survivability_pct, volume_pct, velocity_pct]) AS v FROM tiered
) SELECT tier, signal, round(avg(v), 4) AS mean_signal, count(v) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL""")
def signal_contributions(spark, d):
    return construct.signal_means(scored(spark, d, "survivability_pct", "volume_pct", "velocity_pct"), {"survivability": "survivability_pct", "volume": "volume_pct", "velocity": "velocity_pct"})
