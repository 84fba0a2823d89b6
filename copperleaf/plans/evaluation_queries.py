"""Queries over judgments, A/B tests, campaign cells, predictions and scores against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.operators import calibration, corpus, experiments, inputs, judging, predictor, statistics
from copperleaf.plans.registry import query
from copperleaf.plans.scoring_queries import V3_SQL, scored
from copperleaf.sources.ads import table, text_ads
from copperleaf.sources.evaluations import BRIEFS_SQL, JUDGMENTS_SQL, PREDICTIONS_SQL, VARIANTS_SQL, briefs, judgments, predictions, variants

WILSON_SQL = """{zero} AS accuracy, CASE WHEN {n} > 0 THEN round(greatest(0, ({k}::DOUBLE / {n} + 3.841459281296::DOUBLE / (2 * {n}) - 1.959964::DOUBLE * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.841459281296::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + 3.841459281296::DOUBLE / {n})), 6) ELSE 0 END AS low,
  CASE WHEN {n} > 0 THEN round(least(1, ({k}::DOUBLE / {n} + 3.841459281296::DOUBLE / (2 * {n}) + 1.959964::DOUBLE * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.841459281296::DOUBLE / (4.0::DOUBLE * {n} * {n}))) / (1 + 3.841459281296::DOUBLE / {n})), 6) ELSE 0 END AS high"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- judgments


def results(spark, d):
    return judging.reconcile(judgments(spark, d))


@query("pair_reconcile", f"WITH {JUDGMENTS_SQL} SELECT * FROM results")
def pair_reconcile(spark, d):
    return results(spark, d)


@query("pair_rows", f"WITH {JUDGMENTS_SQL}, {BRIEFS_SQL} SELECT example_id, config_a, config_b, judge_model, resolved_winner, order_dependent, per_dim_total, platform, vertical, source_tier FROM pr")
def pair_rows(spark, d):
    return judging.with_briefs(results(spark, d), briefs(spark, d)).select("example_id", "config_a", "config_b", "judge_model", "resolved_winner", "order_dependent", "per_dim_total", "platform", "vertical", "source_tier")


RATES = "count(*) AS n, CAST(count_if(resolved_winner = 'A') AS BIGINT) AS wins_a, CAST(count_if(resolved_winner = 'B') AS BIGINT) AS wins_b, CAST(count_if(resolved_winner = 'tie') AS BIGINT) AS ties, CAST(count_if(order_dependent) AS BIGINT) AS order_dep"
RATES += "".join(f", round(count_if(resolved_winner = '{w}')::DOUBLE / count(*), 6) AS {n}" for w, n in (("A", "win_rate_a"), ("B", "win_rate_b"), ("tie", "tie_rate")))


@query("win_rates", f"WITH {JUDGMENTS_SQL} SELECT config_a, config_b, judge_model, {RATES} FROM results GROUP BY ALL")
def win_rates(spark, d):
    return rounded(judging.win_rates(results(spark, d)), "win_rate_a", "win_rate_b", "tie_rate")


@query("win_rates_by_segment", f"WITH {JUDGMENTS_SQL}, {BRIEFS_SQL} SELECT platform, source_tier, config_a, config_b, judge_model, {RATES} FROM pr GROUP BY ALL")
def win_rates_by_segment(spark, d):
    return rounded(judging.win_rates(judging.with_briefs(results(spark, d), briefs(spark, d)), ["platform", "source_tier"]), "win_rate_a", "win_rate_b", "tie_rate")


CATEGORY = lambda side, w: f"count_if({side}.resolved_winner = '{w}')::DOUBLE / count(*)"


@query("cohens_kappa", f"""WITH {JUDGMENTS_SQL}, k AS (SELECT count(*) AS n, count_if(a.resolved_winner = b.resolved_winner)::DOUBLE / count(*) AS o, {" + ".join(f"({CATEGORY('a', w)}) * ({CATEGORY('b', w)})" for w in judging.WINNERS)} AS e
  FROM results a JOIN results b ON a.judge_model = 'judge-0' AND b.judge_model = 'judge-1' AND a.example_id = b.example_id AND a.config_a = b.config_a AND a.config_b = b.config_b) SELECT round((o - e) / (1 - e), 6) AS kappa, n FROM k""")
def cohens_kappa(spark, d):
    found = materialise(results(spark, d), "results")
    return rounded(judging.cohens_kappa(found.filter("judge_model = 'judge-0'"), found.filter("judge_model = 'judge-1'")), "kappa")


@query("judge_accuracy", f"""WITH {JUDGMENTS_SQL}, s AS (SELECT judge_model, count(*) AS n_pairs, CAST(count_if(NOT order_dependent AND resolved_winner = 'A') AS BIGINT) AS n_winner, CAST(count_if(NOT order_dependent AND resolved_winner = 'B') AS BIGINT) AS n_loser,
  CAST(count_if(NOT order_dependent AND resolved_winner = 'tie') AS BIGINT) AS n_ties, CAST(count_if(order_dependent) AS BIGINT) AS n_order_dependent FROM results GROUP BY judge_model)
  SELECT *, {WILSON_SQL.format(n="(n_winner + n_loser)", k="n_winner", zero="CASE WHEN n_winner + n_loser > 0 THEN round(n_winner::DOUBLE / (n_winner + n_loser), 6) ELSE 0 END")} FROM s""")
def judge_accuracy(spark, d):
    return rounded(judging.judge_accuracy(results(spark, d), ["judge_model"]), "accuracy", "low", "high")


@query("run_compare", f"""WITH {JUDGMENTS_SQL}, a AS (SELECT config_a, config_b, judge_model, {RATES} FROM results WHERE per_dim_total >= 0 GROUP BY ALL), b AS (SELECT config_a, config_b, judge_model, {RATES} FROM results WHERE per_dim_total < 0 GROUP BY ALL)
  SELECT a.config_a, a.config_b, a.judge_model, a.n AS n_base, a.win_rate_a AS win_rate_a_base, a.tie_rate AS tie_rate_base, b.n AS n_cand, b.win_rate_a AS win_rate_a_cand, b.tie_rate AS tie_rate_cand, round(b.win_rate_a - a.win_rate_a, 6) AS delta_win_rate_a, round(b.tie_rate - a.tie_rate, 6) AS delta_tie_rate
  FROM a JOIN b ON a.config_a = b.config_a AND a.config_b = b.config_b AND a.judge_model = b.judge_model""")
def run_compare(spark, d):
    """Two runs: the results whose dimensions favour config_b against the others."""
    found = materialise(results(spark, d), "results")
    both = [rounded(judging.win_rates(found.filter(c)), "win_rate_a", "tie_rate") for c in ("per_dim_total >= 0", "per_dim_total < 0")]
    return rounded(judging.compare_win_rates(*both), "delta_win_rate_a", "delta_tie_rate")


@query("paired_configs", f"""WITH {JUDGMENTS_SQL}, s AS (SELECT example_id, judge_model, avg(per_dim_total) AS score FROM results GROUP BY ALL)
  SELECT a.example_id, round(a.score, 6) AS score_0, round(b.score, 6) AS score_1, round(b.score - a.score, 6) AS difference FROM s a JOIN s b ON a.example_id = b.example_id WHERE a.judge_model = 'judge-0' AND b.judge_model = 'judge-1'""")
def paired_configs(spark, d):
    """Scores of one example side by side, of the examples that all sides have: one aggregation instead of a join for each side."""
    side = lambda j: F.avg(F.when(F.col("judge_model") == j, F.col("per_dim_total")))
    wide = results(spark, d).groupBy("example_id").agg(side("judge-0").alias("a"), side("judge-1").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return wide.select("example_id", F.round("a", 6).alias("score_0"), F.round("b", 6).alias("score_1"), F.round(F.col("b") - F.col("a"), 6).alias("difference"))


@query("batch_round_trip", f"""WITH {JUDGMENTS_SQL} SELECT config_a || '__vs__' || config_b || '__' || 'ex%5f' || CAST(example_id AS VARCHAR) || '__' || CASE WHEN swap_order THEN 'swp' ELSE 'fwd' END AS custom_id, config_a AS pair_a, config_b AS pair_b, 'ex_' || CAST(example_id AS VARCHAR) AS example_id, swap_order
  FROM jd WHERE judge_model = 'judge-0'""")
def batch_round_trip(spark, d):
    named = judgments(spark, d).filter("judge_model = 'judge-0'").select(judging.custom_id(F.col("config_a"), F.col("config_b"), F.concat(F.lit("ex_"), F.col("example_id").cast("string")), F.col("swap_order")).alias("custom_id"))
    return named.select("custom_id", judging.parse_custom_id(F.col("custom_id")).alias("p")).select("custom_id", "p.*")


@query("batch_missing", f"""WITH {JUDGMENTS_SQL}, m AS (SELECT DISTINCT example_id FROM jd WHERE judge_model = 'judge-0' INTERSECT SELECT example_id FROM jd WHERE judge_model = 'judge-1'), q AS (SELECT example_id, unnest([false, true]) AS swap_order FROM m)
  SELECT q.example_id, q.swap_order FROM q WHERE NOT EXISTS (SELECT 1 FROM jd WHERE judge_model = 'judge-0' AND jd.example_id = q.example_id AND jd.swap_order = q.swap_order)""")
def batch_missing(spark, d):
    """Requests of the examples that both judges have, without the first judge's answer."""
    found = judgments(spark, d).select("judge_model", "example_id", "swap_order")
    key = F.concat_ws("/", F.col("example_id").cast("string"), F.col("swap_order").cast("string")).alias("custom_id")
    manifest = judging.requests(found.filter("judge_model = 'judge-0'"), found.filter("judge_model = 'judge-1'")).select("*", key)
    return judging.collect_batch(manifest, found.filter("judge_model = 'judge-0'").select(key))[1].select("example_id", "swap_order")


@query("elo_ratings")
def elo_ratings(spark, d):
    return judging.elo(results(spark, d))


@query("win_rate_intervals")
def win_rate_intervals(spark, d):
    won = F.when(F.col("resolved_winner") == "A", 1.0).otherwise(0.0)
    return statistics.bootstrap_means(results(spark, d), won, F.xxhash64(*judging.KEY), judging.PAIR)


@query("paired_difference")
def paired_difference(spark, d):
    """The mean difference of paired scores, its interval, and whether that leaves 0 out."""
    means = statistics.bootstrap_means(paired_configs(spark, d), F.col("difference"), F.col("example_id"), [])
    return means.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


# -- A/B tests and cells


AB_SQL = f"""{VARIANTS_SQL}, vr AS (SELECT *, CASE WHEN impressions > 0 THEN clicks::DOUBLE / impressions ELSE 0 END AS ctr, count(*) OVER (PARTITION BY test_id) AS nv, sum(impressions) OVER (PARTITION BY test_id) AS ni FROM va
), ab AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ctr DESC, variant) = 1 AS is_winner FROM vr WHERE nv >= 2 AND ni >= 100)"""


def tests(spark, d):
    return experiments.ab_tests(variants(spark, d))


@query("ab_winners", f"WITH {AB_SQL} SELECT test_id, variant, impressions, clicks, round(ctr, 6) AS ctr, is_winner FROM ab")
def ab_winners(spark, d):
    return rounded(tests(spark, d), "ctr")


@query("winner_loser_pairs", f"WITH {AB_SQL} SELECT l.test_id, w.variant AS winner, l.variant AS loser FROM ab w JOIN ab l ON w.test_id = l.test_id WHERE w.is_winner AND NOT l.is_winner")
def winner_loser_pairs(spark, d):
    return experiments.winner_loser_pairs(tests(spark, d))


@query("ab_chi2", f"""WITH {AB_SQL}, c AS (SELECT test_id, clicks::DOUBLE AS a, greatest(0, impressions - clicks)::DOUBLE AS b FROM ab), t AS (SELECT *, sum(a) OVER w AS sa, sum(b) OVER w AS sb, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY test_id)), x AS (
  SELECT *, (a + b) * sa / (sa + sb) AS ea, (a + b) * sb / (sa + sb) AS eb FROM t), o AS (SELECT *, CASE WHEN k = 2 THEN abs(a - ea) - least(0.5::DOUBLE, abs(a - ea)) ELSE abs(a - ea) END AS da, CASE WHEN k = 2 THEN abs(b - eb) - least(0.5::DOUBLE, abs(b - eb)) ELSE abs(b - eb) END AS db FROM x)
  SELECT test_id, CASE WHEN min(least(ea, eb)) <= 0 THEN 0 ELSE round(sum(da * da / nullif(ea, 0) + db * db / nullif(eb, 0)), 6) END AS chi2, CASE WHEN min(least(ea, eb)) <= 0 THEN 0 ELSE max(k) - 1 END AS dof FROM o GROUP BY test_id""")
def ab_chi2(spark, d):
    return rounded(experiments.ab_chi2(tests(spark, d)), "chi2")


@query("ab_significance")
def ab_significance(spark, d):
    return experiments.significant(tests(spark, d))


@query("best_of_other_tests", f"WITH {AB_SQL}, w AS (SELECT test_id, max(ctr) AS v FROM ab WHERE is_winner GROUP BY test_id) SELECT test_id, variant, round((SELECT max(v) FROM w WHERE w.test_id <> ab.test_id), 6) AS best_elsewhere FROM ab")
def best_of_other_tests(spark, d):
    return rounded(experiments.other_tests_best(tests(spark, d), "ctr"), "best_elsewhere")


@query("pairwise_accuracy", f"""WITH {AB_SQL}, p AS (SELECT length(w.variant) AS a, length(l.variant) AS b FROM ab w JOIN ab l ON w.test_id = l.test_id WHERE w.is_winner AND NOT l.is_winner), s AS (
  SELECT count(*) AS n_pairs, CAST(count_if(a > b) AS BIGINT) AS n_correct, CAST(count_if(a = b) AS BIGINT) AS n_ties FROM p) SELECT *, {WILSON_SQL.format(n="(n_pairs - n_ties)", k="n_correct", zero="CASE WHEN n_pairs > n_ties THEN round(n_correct::DOUBLE / (n_pairs - n_ties), 6) ELSE 0 END")} FROM s""")
def pairwise_accuracy(spark, d):
    """The score that is tried is the length of a variant's name; any Column can take its place."""
    return rounded(statistics.pairwise_accuracy(winner_loser_pairs(spark, d), F.length("winner"), F.length("loser")), "accuracy", "low", "high")


@query("pairwise_binomial")
def pairwise_binomial(spark, d):
    return statistics.with_binomial_p(statistics.pairwise_accuracy(winner_loser_pairs(spark, d), F.length("winner"), F.length("loser")))


def campaign(spark, d):
    name = F.concat_ws("__", F.concat(F.lit(" "), F.col("variant")), (F.col("test_id") % 10).cast("string"), F.lit("x"))
    cell, brief = experiments.ad_name_parts(F.col("ad_name"))
    return variants(spark, d).withColumn("ad_name", name).select("impressions", "clicks", "spend", cell.alias("cell"), brief.alias("brief_id"))


CAMPAIGN_SQL = f"{VARIANTS_SQL}, ca AS (SELECT impressions, clicks, spend, variant AS cell, CAST(test_id % 10 AS VARCHAR) || '__x' AS brief_id FROM va)"


@query("ctr_cells", f"""WITH {CAMPAIGN_SQL} SELECT cell, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(spend), 2) AS spend, round(sum(clicks)::DOUBLE / sum(impressions), 6) AS ctr, round(sum(spend) / sum(clicks), 6) AS cpc, round(sum(spend) / sum(impressions) * 1000, 6) AS cpm
  FROM ca GROUP BY cell""")
def ctr_cells(spark, d):
    return rounded(rounded(experiments.cells(campaign(spark, d), ["cell"]), "ctr", "cpc", "cpm"), "spend", digits=2)


@query("ctr_pivot", f"WITH {CAMPAIGN_SQL} SELECT brief_id, {', '.join(f'''CAST(coalesce(sum(CASE WHEN cell = '{c}' THEN {s} END), 0) AS BIGINT) AS {c}_{s}''' for c in ('view', 'click') for s in ('impressions', 'clicks'))} FROM ca GROUP BY brief_id")
def ctr_pivot(spark, d):
    return experiments.pivoted(campaign(spark, d), "brief_id", "cell", ["view", "click"], ["impressions", "clicks"])


@query("two_proportion_z", f"""WITH {CAMPAIGN_SQL}, s AS (SELECT {", ".join(f"sum(CASE WHEN cell = '{c}' THEN {s} ELSE 0 END)::DOUBLE AS {s[0]}{k}" for k, c in (("a", "view"), ("b", "click")) for s in ("clicks", "impressions"))} FROM ca)
  SELECT round((ca / ia - cb / ib) / sqrt((ca + cb) / (ia + ib) * (1 - (ca + cb) / (ia + ib)) * (1 / ia + 1 / ib)), 6) AS z FROM s""")
def two_proportion_z(spark, d):
    return rounded(experiments.contrast(campaign(spark, d), "cell", "view", "click"), "z")


@query("ctr_contrast")
def ctr_contrast(spark, d):
    return experiments.with_normal_p(experiments.contrast(campaign(spark, d), "cell", "view", "click"))


# -- scores against truth


def avg_rank(v: str, *part: str) -> str:
    group = f"PARTITION BY {', '.join(part)}" if part else ""
    return f"(rank() OVER ({group} ORDER BY {v}) + (count(*) OVER (PARTITION BY {', '.join([*part, v])}) - 1) / 2.0::DOUBLE)"


@query("spearman", f"WITH {V3_SQL}, r AS (SELECT {avg_rank('score')} AS a, {avg_rank('spend')} AS b FROM scored WHERE score IS NOT NULL AND spend IS NOT NULL) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return rounded(statistics.spearman(scored(spark, d, "spend"), "score", "spend"), "rho")


@query("kruskal_wallis", f"""WITH {V3_SQL}, k AS (SELECT tier, weighted_engagement AS v, {avg_rank('weighted_engagement')} AS r, count(*) OVER ()::DOUBLE AS n FROM tiered), g AS (SELECT sum(s) AS s, count(*) AS k FROM (SELECT sum(r) * sum(r) / count(*) AS s FROM k GROUP BY tier)), t AS (
  SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM k GROUP BY v)) SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, CAST(g.k - 1 AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
  {", ".join(f"(SELECT count(*) FROM tiered WHERE tier = '{x}') AS n_{x}, (SELECT round(median(weighted_engagement), 4) FROM tiered WHERE tier = '{x}') AS median_{x}" for x in statistics.TIERS)} FROM (SELECT max(n) AS n FROM k), g, t""")
def kruskal_wallis(spark, d):
    return rounded(statistics.kruskal_wallis(scored(spark, d, "weighted_engagement"), "weighted_engagement"), "h")


DELTAS = [("high", "low"), ("high", "medium"), ("medium", "low")]


@query("cliffs_delta", f"""WITH {V3_SQL} {" UNION ALL ".join(f"SELECT '{a}_vs_{b}' AS pair, round(sum(sign(x.weighted_engagement - y.weighted_engagement))::DOUBLE / count(*), 4) AS delta FROM tiered x, tiered y WHERE x.tier = '{a}' AND y.tier = '{b}'" for a, b in DELTAS)}""")
def cliffs_delta(spark, d):
    return rounded(statistics.cliffs_delta(scored(spark, d, "weighted_engagement"), "weighted_engagement", "tier", DELTAS), "delta", digits=4)


@query("ranking_quality", f"""WITH {V3_SQL}, p AS (SELECT spend AS v, row_number() OVER (ORDER BY score DESC, ad_id) - 1 AS ps, row_number() OVER (ORDER BY spend DESC, ad_id) - 1 AS pv, count(*) OVER () AS n FROM scored), k AS (
  SELECT *, CAST(greatest(1, floor(n * q / 100)) AS BIGINT) AS k FROM (SELECT *, unnest([10, 20, 30]) AS q FROM p)) SELECT q AS k_percent, k, round(count_if(ps < k AND pv < k)::DOUBLE / k, 4) AS precision, round(sum(CASE WHEN ps < k THEN v / log2(ps + 2) END) / sum(CASE WHEN pv < k THEN v / log2(pv + 2) END), 4) AS ndcg FROM k GROUP BY q, k""")
def ranking_quality(spark, d):
    return statistics.ranking_quality(scored(spark, d, "ad_id", "spend"), "score", "spend", "ad_id")


@query("tier_homogeneity", f"""WITH {V3_SQL}, c AS (SELECT platform, tier, count(*)::DOUBLE AS n FROM tiered GROUP BY ALL), l AS (SELECT * FROM c WHERE platform IN (SELECT platform FROM c GROUP BY platform HAVING sum(n) >= 30)), g AS (
  SELECT p.platform, t.tier, p.s AS rn, t.s AS cn, coalesce(l.n, 0) AS n FROM (SELECT platform, sum(n) AS s FROM l GROUP BY 1) p CROSS JOIN (SELECT tier, sum(n) AS s FROM l GROUP BY 1) t LEFT JOIN l ON l.platform = p.platform AND l.tier = t.tier), e AS (SELECT *, rn * cn / (SELECT sum(n) FROM l) AS e FROM g)
  SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, (count(DISTINCT platform) - 1) * (count(DISTINCT tier) - 1) AS dof, count(DISTINCT platform) AS platforms FROM e""")
def tier_homogeneity(spark, d):
    return rounded(statistics.homogeneity(scored(spark, d, "platform")), "chi2").withColumn("dof", F.col("dof").cast("long"))


@query("validation_battery")
def validation_battery(spark, d):
    """Rank correlation with its interval and p-value, separation of the tiers, and ranking quality, a row each."""
    rows = scored(spark, d, "ad_id", "spend")
    rho = statistics.bootstrap_spearman(rows, "score", "spend", F.col("ad_id"))
    tiers = statistics.with_chi2_p(statistics.kruskal_wallis(rows, "spend"), "h")
    best = statistics.ranking_quality(rows, "score", "spend", "ad_id")
    row = lambda name, value, p, low, high: F.struct(F.lit(name).alias("test"), value.cast("double").alias("value"), p.cast("double").alias("p_value"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    none = F.lit(None)
    parts = [rho.select(row("spearman", F.col("rho"), F.col("p_value"), F.col("low"), F.col("high")).alias("r")), tiers.select(row("kruskal_wallis", F.col("h"), F.col("p_value"), none, none).alias("r"))]
    parts.append(best.select(F.explode(F.array(row("x", F.col("precision"), none, none, none).withField("test", F.concat(F.lit("precision@"), "k_percent")), row("x", F.col("ndcg"), none, none, none).withField("test", F.concat(F.lit("ndcg@"), "k_percent")))).alias("r")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("r.*")


# -- predictions


def heads():
    """(prediction, target, mask) of each head; columns are made where a session is."""
    return {"quality": ("quality_prediction", "quality_target", F.lit(True)), "toxic": ("toxic_prediction", "toxic_target", F.col("toxic_mask"))}


LONG_SQL = f"{PREDICTIONS_SQL}, lg AS (SELECT doc_id, platform, 'quality' AS head, quality_prediction AS p, quality_target AS t FROM pd UNION ALL SELECT doc_id, platform, 'toxic', toxic_prediction, toxic_target FROM pd WHERE toxic_mask)"
ZERO = lambda x: f"round(CASE WHEN isnan({x}) OR {x} IS NULL THEN 0 ELSE {x} END, 6)"


@query("regression_metrics", f"WITH {LONG_SQL}, r AS (SELECT *, {avg_rank('p', 'head')} AS a, {avg_rank('t', 'head')} AS b FROM lg) SELECT head, count(*) AS n, {ZERO('corr(a, b)')} AS spearman, {ZERO('corr(p, t)')} AS pearson, round(avg(abs(p - t)), 6) AS mae FROM r GROUP BY head")
def regression_metrics(spark, d):
    return rounded(statistics.regression_metrics(predictions(spark, d), heads()), "spearman", "pearson", "mae")


@query("platform_metrics", f"WITH {LONG_SQL}, r AS (SELECT *, {avg_rank('p', 'platform', 'head')} AS a, {avg_rank('t', 'platform', 'head')} AS b FROM lg) SELECT platform, head, count(*) AS n, {ZERO('corr(a, b)')} AS spearman, {ZERO('corr(p, t)')} AS pearson, round(avg(abs(p - t)), 6) AS mae FROM r GROUP BY ALL HAVING count(*) >= 10")
def platform_metrics(spark, d):
    return rounded(statistics.regression_metrics(predictions(spark, d), heads(), ["platform"], least=10), "spearman", "pearson", "mae")


@query("calibration_error", f"WITH {PREDICTIONS_SQL}, b AS (SELECT {' + '.join(f'CAST(quality_prediction >= {i / 10}::DOUBLE AS INT)' for i in range(1, 10))} AS bin, count(*) AS n, avg(quality_prediction) AS p, avg(quality_target) AS t FROM pd GROUP BY 1) SELECT round(sum(n * abs(p - t)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark, d):
    return rounded(statistics.calibration_error(predictions(spark, d), "quality_prediction", "quality_target"), "ece")


@query("tier_auc", f"WITH {PREDICTIONS_SQL}, r AS (SELECT quality_target >= 0.8 AS y, {avg_rank('quality_prediction')} AS r FROM pd), s AS (SELECT count_if(y)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(CASE WHEN y THEN r ELSE 0 END) AS r FROM r) SELECT round((r - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS n FROM s")
def tier_auc(spark, d):
    return rounded(statistics.tier_auc(predictions(spark, d), "quality_prediction", "quality_target", 0.8), "auc")


@query("low_tier_auc", f"WITH {PREDICTIONS_SQL}, r AS (SELECT quality_target <= 0.3 AS y, {avg_rank('-quality_prediction')} AS r FROM pd), s AS (SELECT count_if(y)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(CASE WHEN y THEN r ELSE 0 END) AS r FROM r) SELECT round((r - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS n FROM s")
def low_tier_auc(spark, d):
    return rounded(statistics.tier_auc(predictions(spark, d), "quality_prediction", "quality_target", 0.3, high=False), "auc")


@query("roc_curve", f"""WITH {PREDICTIONS_SQL}, o AS (SELECT row_number() OVER w AS place, sum(CASE WHEN quality_target = 1 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS n, sum(quality_target) OVER () AS p FROM pd WINDOW w AS (ORDER BY quality_prediction DESC, doc_id)), c AS (SELECT place, (place - tp)::DOUBLE / (n - p) AS fpr, tp::DOUBLE / p AS tpr FROM o)
  SELECT place, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round((fpr - lag(fpr, 1, 0) OVER (ORDER BY place)) * (tpr + lag(tpr, 1, 0) OVER (ORDER BY place)) / 2, 6) AS area FROM c""")
def roc_curve(spark, d):
    return rounded(statistics.roc_curve(predictions(spark, d), "quality_prediction", F.col("quality_target") == 1, "doc_id"), "fpr", "tpr", "area")


@query("reliability", f"WITH {PREDICTIONS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY quality_prediction, doc_id) - 1 AS i, count(*) OVER () // 10 AS w FROM pd) SELECT CAST(i // w AS INT) AS bin, count(*) AS n, round(avg(quality_prediction), 6) AS mean_prediction, round(avg(quality_target), 6) AS mean_target FROM o WHERE i < 10 * w GROUP BY 1")
def reliability(spark, d):
    return rounded(statistics.reliability(predictions(spark, d), "quality_prediction", "quality_target", "doc_id"), "mean_prediction", "mean_target")


@query("masked_loss", f"WITH {PREDICTIONS_SQL}, w AS (SELECT *, CASE WHEN vertical = 'de' THEN 0.5::DOUBLE ELSE 1 END AS w FROM pd) SELECT round((sum(w * pow(quality_prediction - quality_target, 2)) + sum(CASE WHEN toxic_mask THEN 0.5::DOUBLE * w * pow(toxic_prediction - toxic_target, 2) ELSE 0 END)) / (sum(w) + sum(CASE WHEN toxic_mask THEN 0.5::DOUBLE * w ELSE 0 END)), 6) AS loss FROM w")
def masked_loss(spark, d):
    weighed = {"quality": (*heads()["quality"], 1.0), "toxic": (*heads()["toxic"], 0.5)}
    return rounded(statistics.masked_loss(predictions(spark, d), weighed, F.when(F.col("vertical") == "de", 0.5).otherwise(1.0)), "loss")


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    """Calibrated predictions of both heads, by curves that were written and read again."""
    rows = predictions(spark, d)
    curves = calibration.loads(calibration.dumps(calibration.fit(rows, heads())))
    return calibration.calibrated(rows, heads(), curves).select("doc_id", "quality_calibrated", "toxic_calibrated")


SUMMARY_SQL = lambda c: f"count({c}) AS {c}_n, round(avg({c}), 6) AS {c}_mean, round(median({c}), 9) AS {c}_median, " + ", ".join(f"round(max({c}) FILTER (i_{c} = CAST(floor((k_{c} - 1) * {q}::DOUBLE + 0.5) AS BIGINT)), 6) AS {c}_p{int(q * 100)}" for q in (0.25, 0.75, 0.9))
PLACE_SQL = lambda c: f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (PARTITION BY platform, {c} IS NULL ORDER BY {c}) - 1 END AS i_{c}, count({c}) OVER (PARTITION BY platform) AS k_{c}"


@query("head_summary", f"WITH {V3_SQL}, q AS (SELECT platform, score, volume_pct, {PLACE_SQL('score')}, {PLACE_SQL('volume_pct')} FROM scored) SELECT platform, count(*) AS n, {SUMMARY_SQL('score')}, {SUMMARY_SQL('volume_pct')} FROM q GROUP BY platform")
def head_summary(spark, d):
    """Weak platforms have no volume head: their numbers are null."""
    made = statistics.summary(scored(spark, d, "platform", "volume_pct"), ["score", "volume_pct"], ["platform"], {"p25": 0.25, "p75": 0.75, "p90": 0.9})
    made = rounded(made, *[c for c in made.columns if c.endswith("_median")], digits=9)  # the middle of two scores of six digits has seven
    return rounded(made, *[c for c in made.columns if c.split("_")[-1] in ("mean", "p25", "p75", "p90")])


# -- inputs of evaluation and construction


def chat_records(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    platform = F.when(F.col("conv_id") % 3 == 0, "facebook").when(F.col("conv_id") % 3 == 1, "reddit")
    meta = F.struct(F.col("conv_id").cast("string").alias("example_id"), platform.alias("platform"))
    return turns.select(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), meta.alias("metadata"))


FIRST = lambda role, name: f"coalesce(first(text ORDER BY turn, text) FILTER (role = '{role}'), '') AS {name}"
CHATS_SQL = f"br AS (SELECT CAST(conv_id AS VARCHAR) AS example_id, CASE conv_id % 3 WHEN 0 THEN 'facebook' WHEN 1 THEN 'reddit' ELSE 'unknown' END AS platform, {FIRST('system', 'system')}, {FIRST('user', 'user')}, {FIRST('assistant', 'reference')} FROM conversations GROUP BY conv_id)"


@query("chat_briefs", f"WITH {CHATS_SQL} SELECT example_id, 'copywriting' AS task_format, platform, 'unknown' AS vertical, md5(system) AS system, md5(user) AS user, md5(reference) AS reference FROM br")
def chat_briefs(spark, d):
    return inputs.briefs(chat_records(spark, d)).select("example_id", "task_format", "platform", "vertical", *[F.md5(c).alias(c) for c in ("system", "user", "reference")])


@query("gathered_generations", f"""WITH {CHATS_SQL}, g AS (SELECT 'GOLD' AS config, example_id, reference AS text FROM br UNION ALL SELECT 'other', CAST(doc_id AS VARCHAR), CASE WHEN lang = 'de' THEN '' ELSE 'said' END FROM documents), m AS (SELECT g.*, br.example_id IS NOT NULL AS there FROM g LEFT JOIN br ON g.example_id = br.example_id)
  SELECT config, CAST(count_if(there AND trim(text) <> '') AS BIGINT) AS kept, CAST(count_if(there AND trim(text) = '') AS BIGINT) AS blank, CAST(count_if(NOT there) AS BIGINT) AS no_brief FROM m GROUP BY config""")
def gathered_generations(spark, d):
    """The real ads as a configuration beside another, whose German texts could not be cleaned."""
    known = inputs.briefs(chat_records(spark, d))
    ident = F.col("doc_id").cast("string").alias("example_id")
    docs = table(spark, d, "documents")
    raw = inputs.gold_inferences(known).select("config", "example_id", "assistant_text").unionByName(docs.select(F.lit("other").alias("config"), ident, F.lit("said").alias("assistant_text")))
    clean = docs.filter("lang = 'de'").select(F.lit("other").alias("config"), ident, F.lit("<EXTRACTION_FAILED>").alias("assistant_text_clean"))
    return inputs.generations(raw, clean, known)[1]


@query("learned_rows", f"WITH {V3_SQL} SELECT ad_id, round(score, 6) AS composite, CASE WHEN platform NOT IN ('reddit', 'other') THEN 0.25::DOUBLE END AS engagement_volume, 'true,true,' || CASE WHEN platform = 'reddit' THEN 'false,false' ELSE 'true,true' END AS mask FROM scored")
def learned_rows(spark, d):
    rows = scored(spark, d, "ad_id", "platform").select("ad_id", "platform", F.col("score").alias("composite"), F.lit(0.5).alias("survivability"), F.lit(0.25).alias("engagement_volume"), F.lit(0.25).alias("engagement_velocity"), F.lit("x").alias("text"))
    made = inputs.targets(inputs.learned_rows(rows))
    return made.select("ad_id", F.round("composite", 6).alias("composite"), "engagement_volume", F.array_join(F.transform("mask", lambda m: m.cast("string")), ",").alias("mask"))


@query("ground_truth", "SELECT CAST(c_custkey AS VARCHAR) AS ad_id, CASE WHEN c_nationkey < 5 THEN c_acctbal ELSE c_acctbal + 5 END AS spend_mid, CASE WHEN c_nationkey > 20 THEN 100.0::DOUBLE END AS impression_mid FROM customer WHERE c_nationkey <> 3")
def ground_truth(spark, d):
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ad_id"), F.lit("facebook").alias("platform"), b.alias("spend_lower"), F.when(n >= 5, b + 10).alias("spend_upper"), F.lit(None).cast("long").alias("impression_lower"), F.when(n > 20, 100).alias("impression_upper"), F.when(n != 3, F.lit("2024-01-01").cast("date")).alias("first_seen"), F.lit("2024-01-02").cast("date").alias("last_seen"))
    return inputs.ground_truth(rows).select("ad_id", "spend_mid", "impression_mid")


@query("dataset_statistics", """WITH n AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), s AS (SELECT *, greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)) AS v FROM n), t AS (SELECT lang, source, CASE WHEN n - 2 * v < 1 OR p <= n - 2 * v THEN 'train' WHEN p <= n - v THEN 'val' ELSE 'test' END AS split FROM s)
  SELECT split, 'total' AS kind, '' AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT split, 'format', source, count(*) FROM t GROUP BY ALL UNION ALL SELECT split, 'platform', lang, count(*) FROM t GROUP BY ALL""")
def dataset_statistics(spark, d):
    rows = corpus.stratified_split(table(spark, d, "documents").select("doc_id", F.col("source").alias("task_format"), F.col("lang").alias("platform")), "task_format", "doc_id")
    return inputs.dataset_statistics(rows)


@query("review_rows", "SELECT conv_id, n, d.lang AS ad_lang, l.quality AS prompt FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c LEFT JOIN documents d ON d.doc_id = c.conv_id * 2 LEFT JOIN labels l ON l.doc_id = c.conv_id")
def review_rows(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("example_id"), (F.col("conv_id") * 2).alias("ad_id")).agg(F.count("*").alias("n"))
    made = inputs.reviewed(rows, table(spark, d, "documents").select(F.col("doc_id").alias("ad_id"), "lang"), table(spark, d, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("prompt")))
    return made.select(F.col("example_id").alias("conv_id"), "n", "ad_lang", "prompt")


@query("unlabelled_ads", "SELECT CAST(doc_id AS VARCHAR) AS ad_id, coalesce(source, '') AS headline FROM documents WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_ads(spark, d):
    """Bare records and wrapped ones; Spanish ones are cut off and cannot be read."""
    ad = F.struct(F.col("doc_id").cast("string").alias("ad_id"), F.struct(F.col("source").alias("headline")).alias("ad_copy"))
    line = F.when(F.col("lang") == "en", F.to_json(F.struct(ad.alias("ad")))).when(F.col("lang") == "es", F.substring(F.to_json(ad), 1, 9)).otherwise(F.to_json(ad))
    return inputs.unlabelled(table(spark, d, "documents").select(line.alias("json")), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("ad_id")))


@query("ad_facts")
def ad_facts(spark, d):
    return text_ads(spark, d).select("ad_id", inputs.ad_facts(F.nullif(F.col("vertical"), F.lit("src0")), F.col("headline"), F.col("body")).alias("facts"))


SWEEPS = [
    {"platform": "p", "name": "words", "keywords": ["a", "b"], "orderings": ["new", "top"], "geos": "eu"}, {"platform": "p", "name": "sites", "domains": ["x.com"], "geos": [7]}, {"platform": "p", "name": "nations", "filter_type": "nation", "top_n": 3, "geos": "nowhere"},
    {"platform": "p", "name": "both", "filter_types": ["nation", "region"], "orderings": ["new"]}, {"platform": "p", "name": "days", "range_filter": "days", "tiers": [[1, 9], [10, 99]]}, {"platform": "p", "name": "plain", "orderings": ["new", "top"]}, {"platform": "p", "name": "later", "dynamic": True},
]


@query("sweep_queries", """WITH c AS (SELECT 'nation' AS key, CAST(n_nationkey AS VARCHAR) AS code, n_nationkey AS i FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_regionkey FROM region)
  SELECT 'words' AS sweep, 'text' AS filter, v AS value, o AS ordering, g AS geo FROM (SELECT unnest(['a', 'b']) AS v), (SELECT unnest(['new', 'top']) AS o), (SELECT unnest([1, 2]) AS g) UNION ALL SELECT 'sites', 'url_chain', 'x.com', 'popularity', 7 UNION ALL SELECT 'nations', key, code, 'popularity', NULL FROM c WHERE key = 'nation' AND i < 3
  UNION ALL SELECT 'both', key, code, 'new', NULL FROM c UNION ALL SELECT 'days', 'days', unnest(['1-9', '10-99']), 'popularity', NULL UNION ALL SELECT 'plain', NULL, NULL, unnest(['new', 'top']), NULL""")
def sweep_queries(spark, d):
    """All shapes of a crawl plan, over the codes that the components of a filter page list."""
    def listed(t, key, name):
        return table(spark, d, t).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("o"), F.col(key).cast("string").alias("key"), F.col(name).alias("label")))).alias("i")).select(F.transform("i", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"))).alias("items"))

    none = F.lit(None).cast("long")
    parts = [listed("nation", "n_nationkey", "n_name").withColumns({"key": F.lit("nation"), "component": F.lit("SelectMany")}), listed("region", "r_regionkey", "r_name").withColumns({"key": F.lit("region"), "component": F.lit("StringSingle")})]
    components = parts[0].unionByName(parts[1]).withColumns({"platform": F.lit("p"), "low": none, "high": none})
    return inputs.sweep_queries(spark, SWEEPS, {"eu": [1, 2]}, inputs.filter_codes(components)).drop("platform")


@query("predicted_scores")
def predicted_scores(spark, d):
    """Two heads learned from labelled documents, scored for all."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_l"), "quality", "toxic")
    rows = table(spark, d, "documents").join(labels, F.col("doc_id") == F.col("_l"), "left")
    models = predictor.fit(rows, "text", {"quality": ("quality", F.lit(True)), "toxic": ("toxic", F.col("lang") == "en")})
    return predictor.predict(rows.select("doc_id", "text"), "text", models).drop("text")


@query("ctr_intervals")
def ctr_intervals(spark, d):
    return experiments.ctr_intervals(experiments.cells(campaign(spark, d), ["cell"]))
