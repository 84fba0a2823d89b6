"""Statistics and judgments beside values worked out by hand or known from tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copperleaf.functions import probability as prob
from copperleaf.operators import experiments, judging, statistics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tail_probabilities():
    assert prob.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and prob.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05) and prob.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert prob.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and prob.t_two_sided(0, 5) == pytest.approx(1.0)
    assert prob.binomial_at_least(8, 10) == pytest.approx(56 / 1024) and prob.binomial_at_least(0, 3) == 1.0 and prob.binomial_at_least(5, 5) == pytest.approx(1 / 32)
    assert prob.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert prob.chi2_tail(0, 3) == 1.0 and prob.chi2_tail(2000, 4) == pytest.approx(0.0)


def test_spearman(spark):
    up = frame(spark, [(i, float(i), float(i**3), 1.0) for i in range(10)], "i long, x double, y double, c double")
    rho = lambda a, b: statistics.spearman(up, a, b).first()["rho"]
    assert rho("x", "y") == pytest.approx(1.0) and rho("x", "c") == 0.0
    down = up.withColumn("y", -F.col("y"))
    assert statistics.spearman(down, "x", "y").first()["rho"] == pytest.approx(-1.0)
    known = statistics.with_p_value(frame(spark, [(0.5, 10)], "rho double, n long")).first()["p_value"]
    assert known == pytest.approx(0.1411, abs=1e-4)
    ci = statistics.bootstrap_spearman(up.withColumn("y", F.col("y") + F.when(F.col("i") == 3, 900.0).otherwise(0.0)), "x", "y", F.col("i")).first()
    assert -1 <= ci["low"] <= ci["rho"] <= ci["high"] <= 1 and ci["low"] < ci["high"]


TIERED = [("high", 10.0), ("high", 11.0), ("high", 12.0), ("medium", 5.0), ("medium", 6.0), ("medium", 7.0), ("low", 1.0), ("low", 2.0), ("low", 3.0)]


def test_tiers_that_part(spark):
    df = frame(spark, TIERED, "tier string, v double")
    got = statistics.with_chi2_p(statistics.kruskal_wallis(df, "v"), "h").first()
    assert got["h"] == pytest.approx(7.2) and got["dof"] == 2 and got["p_value"] == pytest.approx(0.02732, abs=1e-5) and got["median_high"] == 11.0
    same = statistics.kruskal_wallis(df.withColumn("v", F.lit(1.0)), "v").first()
    assert same["h"] == 0.0
    alone = statistics.kruskal_wallis(df.filter("tier = 'high' OR v = 1"), "v").first()  # one value of low is none
    assert (alone["h"], alone["dof"], alone["n_low"]) == (0.0, 0, None)
    deltas = {r["pair"]: r["delta"] for r in statistics.cliffs_delta(df, "v", "tier", [("high", "low"), ("low", "high"), ("low", "low")]).collect()}
    assert deltas["high_vs_low"] == 1.0 and deltas["low_vs_high"] == -1.0


def test_ranking_quality(spark):
    df = frame(spark, [(i, float(i), float(i), -float(i)) for i in range(1, 21)], "i long, s double, t double, b double")
    best = {r["k_percent"]: (r["k"], r["precision"], r["ndcg"]) for r in statistics.ranking_quality(df, "s", "t", "i").collect()}
    assert best == {10: (2, 1.0, 1.0), 20: (4, 1.0, 1.0), 30: (6, 1.0, 1.0)}
    worst = statistics.ranking_quality(df, "b", "t", "i").filter("k_percent = 10").first()
    assert worst["precision"] == 0.0 and worst["ndcg"] < 0.2
    assert statistics.ranking_quality(df.withColumn("t", F.lit(0.0)), "s", "t", "i").first()["ndcg"] == 0.0


def test_wilson_and_accuracy(spark):
    low, high = spark.range(1).select(*statistics.wilson(F.lit(8.0), F.lit(10.0))).first()
    assert (low, high) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    pairs = frame(spark, [(2, 1), (2, 1), (1, 2), (1, 1)], "w long, l long")
    got = statistics.with_binomial_p(statistics.pairwise_accuracy(pairs, F.col("w"), F.col("l"))).first()
    assert (got["n_correct"], got["n_ties"], got["accuracy"]) == (2, 1, pytest.approx(2 / 3)) and got["p_value"] == pytest.approx(0.5)
    none = statistics.with_binomial_p(statistics.pairwise_accuracy(pairs.limit(0), F.col("w"), F.col("l"))).first()
    assert (none["n_pairs"], none["accuracy"], none["low"], none["high"], none["p_value"]) == (0, 0.0, 0.0, 0.0, 1.0)


def test_chi2(spark):
    two = frame(spark, [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], "r string, c string, n long")
    got = statistics.chi2(two, "r", "c", "n").first()
    assert got["dof"] == 1 and got["chi2"] == pytest.approx(65 * (abs(10 * 5 - 20 * 30) - 65 / 2) ** 2 / (30 * 35 * 40 * 25))  # by Yates
    even = frame(spark, [(p, t) for p in "ab" for t in ("high", "low") for _ in range(20)], "platform string, tier string")
    assert statistics.homogeneity(even).first()["chi2"] == pytest.approx(0.0)
    few = statistics.homogeneity(even.filter("platform = 'a'")).first()
    assert (few["chi2"], few["dof"], few["platforms"]) == (0.0, 0, 1)


def test_predictions(spark):
    df = frame(spark, [(i, i / 10, float(i >= 5)) for i in range(10)], "i long, p double, t double")
    assert statistics.tier_auc(df, "p", "t", 0.8).first()["auc"] == 1.0
    assert statistics.tier_auc(df, "p", "t", 0.3, high=False).first()["auc"] == 1.0
    one = statistics.tier_auc(df.filter("t = 1"), "p", "t", 0.8).first()["auc"]
    assert one != one
    assert statistics.calibration_error(df.withColumn("p", F.col("t")), "p", "t").first()["ece"] == 0.0
    none = statistics.calibration_error(df.limit(0), "p", "t").first()
    assert none["ece"] != none["ece"] and none["n"] == 0
    area = statistics.roc_curve(df, "p", F.col("t") == 1, "i").agg(F.sum("area")).first()[0]
    assert area == pytest.approx(1.0)
    odd = frame(spark, [(i, i / 23, 1.0) for i in range(23)], "i long, p double, t double")
    assert [r["n"] for r in statistics.reliability(odd, "p", "t", "i").collect()] == [2] * 10
    heads = {"h": ("p", "t", F.lit(True)), "off": ("p", "t", F.lit(False)), "one": ("p", "t", F.col("i") == 3)}
    got = {r["head"]: r for r in statistics.regression_metrics(df.withColumn("t", F.lit(0.5)), heads, least=1).collect()}
    assert set(got) == {"h", "one"} and got["h"]["spearman"] == got["h"]["pearson"] == 0.0 and got["one"]["mae"] != got["one"]["mae"]
    loss = statistics.masked_loss(df, {"h": ("p", "t", F.lit(True), 2.0)}, F.lit(1.0)).first()["loss"]
    assert loss == pytest.approx(sum((i / 10 - (i >= 5)) ** 2 for i in range(10)) / 10)
    with pytest.raises(Exception, match="no row has a weight"):
        statistics.masked_loss(df, {"h": ("p", "t", F.lit(False), 1.0)}, F.lit(1.0)).collect()


def test_resampled_means(spark):
    df = frame(spark, [(i, float(i % 2)) for i in range(400)], "i long, v double")
    a, b = (statistics.bootstrap_means(d, F.col("v"), F.col("i"), [], times=300).first() for d in (df, df.repartition(7)))
    assert a == b and a["mean"] == 0.5 and 0.43 < a["low"] < 0.5 < a["high"] < 0.57


SCHEMA = "example_id long, config_a string, config_b string, judge_model string, pair_a string, swap_order boolean, overall_winner string, " + ", ".join(f"{d} long" for d in judging.DIMENSIONS)


def said(i, swap, winner, dims):
    return (i, "a", "b", "j", "b" if swap else "a", swap, winner, *dims)


def test_reconciling(spark):
    rows = [
        said(1, False, "A", [1] * 5), said(1, True, "B", [-1] * 5), said(2, False, "A", [2, 0, 0, 0, 0]), said(2, True, "A", [1, 0, 0, 0, 0]), said(3, False, "A", [0] * 5), said(3, True, "tie", [0] * 5), said(4, False, "B", [-1] * 5),
        said(5, False, "tie", [0] * 5), said(5, True, "A", [2] * 5),
    ]
    got = {r["example_id"]: (r["resolved_winner"], r["order_dependent"], r["per_dim_total"], r["swapped_winner"]) for r in judging.reconcile(frame(spark, rows, SCHEMA)).collect()}
    assert got == {1: ("A", False, 10, "A"), 2: ("A", True, 1, "B"), 3: ("tie", True, 0, "tie"), 4: ("B", False, -5, "tie"), 5: ("B", True, -10, "B")}
    with pytest.raises(Exception, match="no forward judgment"):
        judging.reconcile(frame(spark, [said(9, True, "A", [0] * 5)], SCHEMA)).collect()


RESULT = "example_id long, config_a string, config_b string, judge_model string, resolved_winner string, order_dependent boolean"


def test_rates_agreement_and_ratings(spark):
    rows = frame(spark, [(i, "a", "b", "j", w, i == 3) for i, w in enumerate(["A", "A", "B", "tie"])], RESULT)
    r = judging.win_rates(rows).first()
    assert (r["n"], r["wins_a"], r["wins_b"], r["ties"], r["order_dep"], r["win_rate_a"]) == (4, 2, 1, 1, 1, 0.5)
    with pytest.raises(ValueError, match="platform"):
        judging.win_rates(rows, ["platform"])
    assert judging.win_rates(rows.limit(0)).count() == 0
    assert judging.cohens_kappa(rows, rows).first()["kappa"] == 1.0
    assert judging.cohens_kappa(rows, rows.withColumn("example_id", F.col("example_id") + 9)).first()["kappa"] == 0.0
    same = rows.withColumn("resolved_winner", F.lit("A"))
    assert judging.cohens_kappa(same, same).first()["kappa"] == 1.0
    elo = {r["config"]: r["rating"] for r in judging.elo(frame(spark, [(i, "a", "b", "j", "A", False) for i in range(20)], RESULT).repartition(4)).collect()}
    assert elo["a"] > 1000 > elo["b"] and sum(elo.values()) == pytest.approx(2000)
    assert judging.elo(rows.limit(0)).count() == 0
    first = judging.elo(rows)
    assert {tuple(r) for r in judging.compare_elo(first, first).collect()} == {("j", "a", 0.0), ("j", "b", 0.0)}


def test_custom_ids(spark):
    made = spark.range(1).select(judging.custom_id(F.lit("A_pipe"), F.lit("B"), F.lit("x__y_z"), F.lit(True)).alias("c"))
    assert made.first()["c"] == "A_pipe__vs__B__x%5f%5fy%5fz__swp"
    assert made.select(judging.parse_custom_id(F.col("c")).alias("p")).select("p.*").first() == ("A_pipe", "B", "x__y_z", True)
    assert spark.range(1).select(judging.parse_custom_id(F.lit("a__b")).alias("p")).first()["p"] is None


def test_ab_tests(spark):
    rows = frame(spark, [("t", "a", 100, 10), ("t", "b", 100, 10), ("few", "a", 20, 1), ("few", "b", 20, 1), ("one", "a", 500, 9), (None, "a", 500, 1), (None, "b", 500, 1), ("u", "a", 0, 0), ("u", "b", 900, 90)], "test_id string, variant string, impressions long, clicks long")
    tests = experiments.ab_tests(rows)
    assert {(r["test_id"], r["variant"]) for r in tests.filter("is_winner").collect()} == {("t", "a"), ("u", "b")}  # the first of equals
    assert {tuple(r) for r in experiments.winner_loser_pairs(tests).collect()} == {("t", "a", "b"), ("u", "b", "a")}
    assert {r["test_id"]: r["significant"] for r in experiments.significant(tests).collect()} == {"t": False, "u": False}
    best = {(r["test_id"], r["variant"]): r["best_elsewhere"] for r in experiments.other_tests_best(tests.withColumn("ctr", F.when(F.col("test_id") == "t", 0.3).otherwise(0.2)), "ctr").collect()}
    assert best["t", "a"] == 0.2 and best["u", "a"] == 0.3
    cell, brief = spark.range(1).select(*experiments.ad_name_parts(F.lit(" cell __ b__c "))).first()
    assert (cell, brief) == ("cell", "b__c") and tuple(spark.range(1).select(*experiments.ad_name_parts(F.lit("plain"))).first()) == (None, None)
    z = experiments.contrast(frame(spark, [("x", 0, 0), ("y", 10, 100)], "c string, clicks long, impressions long"), "c", "x", "y").first()["z"]
    assert z != z


def test_one_pass_of_resamples_equals_the_weights_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", None][i % 3], float(v)) for i, v in enumerate(rng.normal(5, 2, 900))]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    marks = dict(map(tuple, df.select("i", F.xxhash64("i")).collect()))
    monkeypatch.setattr(statistics, "HELD_GROUPS", 2)
    got = {(r["g"], r["i"]): (r["n"], r["v"]) for r in statistics.resampled_sums(df.repartition(5), ["g"], "i", ["v"], 40, 7).collect()}
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g]
        w = statistics.resample_weights(np.array([marks[r[0]] for r in own]), 40, 7)
        for k in range(40):
            assert np.allclose(got[g, k], (w[:, k].sum(), w[:, k] @ np.array([r[2] for r in own])))
    w = statistics.resample_weights(np.arange(20_000), 50, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    ci = statistics.bootstrap_means(df, F.col("v"), F.col("i"), []).first()
    values = np.array([r[2] for r in rows])
    plain = np.quantile(rng.choice(values, (4000, len(values))).mean(axis=1), [0.025, 0.975])
    assert abs(ci["low"] - plain[0]) < 0.03 and abs(ci["high"] - plain[1]) < 0.03 and ci["n"] == 900
