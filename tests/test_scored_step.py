"""What the scored ads and the statistics over them read, write and rank."""

import random

import pytest
from pyspark.sql import functions as F

from copperleaf.operators import label_model, scoring, statistics
from copperleaf.plans import scoring_queries

SF = "/root/testdata/sf0.001"


def test_ads_are_made_once_and_only_with_what_is_asked_for(spark, monkeypatch):
    real, written = scoring.materialise, {}
    monkeypatch.setattr(scoring, "materialise", lambda df, name: written.setdefault(name, []).append(set(df.columns)) or real(df, name))
    rows = scoring_queries.scored(spark, SF, "spend")
    assert set(rows.columns) == {"spend", "score", "tier"}
    assert written["ads"] == [{"spend", *scoring.V3_INPUTS}] and written["scored"] == [{"spend", "score"}]
    assert written["durations"] == [{"platform", "d", "n", "deaths"}] and "signals" not in written
    plan = scoring.survivability(scoring_queries.features(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_named_columns_change_no_score(spark):
    whole = scoring_queries.scored(spark, SF)
    rows = lambda df: sorted(map(tuple, df.select("ad_id", "score", "tier").collect()))
    assert rows(whole) == rows(scoring_queries.scored(spark, SF, "ad_id"))


def test_cliffs_delta_from_counts(spark, monkeypatch):
    monkeypatch.setattr(statistics, "with_positions", None)  # no row is ranked
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, -0.0, 0.0, 1.0, 2.5, 7.0])) for _ in range(300)]
    pairs = [("a", "b"), ("b", "a"), ("a", "gone"), ("no", "gone"), ("c", "c")]
    got = {x["pair"]: x["delta"] for x in statistics.cliffs_delta(spark.createDataFrame(rows, "g string, v double"), "v", "g", pairs).collect()}
    of = lambda g: [v for k, v in rows if k == g and v is not None]
    want = {f"{a}_vs_{b}": sum((x > y) - (x < y) for x in of(a) for y in of(b)) / max(1, len(of(a)) * len(of(b))) for a, b in pairs if of(a) or of(b)}
    assert set(got) == set(want) and all(abs(got[p] - w) < 1e-12 for p, w in want.items())


def test_rows_are_ranked_once_for_a_coefficient_with_its_interval(spark, monkeypatch):
    real, calls = statistics.with_positions, []
    monkeypatch.setattr(statistics, "with_positions", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(60)] + [(60, None, 1.0)], "i int, x double, y double")
    got = statistics.bootstrap_spearman(df, "x", "y", F.col("i"), times=20).first()
    assert len(calls) == 1 and got["n"] == 60
    assert got["rho"] == pytest.approx(statistics.spearman(df, "x", "y").first()["rho"]) and got["low"] <= got["high"]


def test_overlaps_are_summed_over_patterns(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, None), (7, 1), (-1, -1), (0, 0)], "a int, b int")
    real, plans = type(df).first, []
    monkeypatch.setattr(type(df), "first", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    made, n = label_model.overlaps(df, ["a", "b"])
    assert n == 6 and (made * 6).round().astype(int).tolist() == [[1, 0, 1, 0], [0, 3, 1, 1], [1, 1, 2, 0], [0, 1, 0, 2]]
    assert plans[0].count("Aggregate") == 2


def test_votes_rank_no_row(spark, monkeypatch):
    monkeypatch.setattr(scoring, "with_positions", None)
    r = random.Random(9)
    rows = [(r.choice(["facebook", "tiktok", "reddit", None]), r.choice([None, 0.0, *map(float, range(1, 12))]), r.choice([None, -0.0, 0.0, 0.5, 1.5, 2.5, 4.0])) for _ in range(400)]
    rows = [(i, *x) for i, x in enumerate([*rows, ("alone", 3.0, 1.0)])]
    df = spark.createDataFrame(rows, "id int, platform string, weighted_engagement double, weighted_velocity double")
    df = df.withColumns({"last_seen": F.to_date(F.lit("2024-01-01")), "longevity_days": F.lit(10).cast("long")})
    got = {x["id"]: [x[f"vote{k}"] for k in (3, 4, 5, 6)] for x in scoring.votes(scoring.vote_features(df)).collect()}
    # beside them, each row's percentile as its rank says it
    some = [(i, p, w, v) for i, p, w, v in rows if w and w > 0]
    want = {i: [-1] * 4 for i, *_ in rows}
    for k in (2, 3):
        for row in some:
            values = [x[k] for x in some if x[1] == row[1] and x[k] is not None]
            if row[k] is None or len(values) == 1 or row[1] in (None, *scoring.WEAK_PLATFORMS):
                continue  # alone, or of a platform whose engagement does not vote
            pct = round((sum(v < row[k] for v in values) + (sum(v == row[k] for v in values) - 1) / 2) / (len(values) - 1), 6)
            want[row[0]][2 * k - 4 : 2 * k - 2] = [1 if pct > 0.8 else -1, 0 if pct < 0.2 else -1]
    assert got == want and {v for votes in want.values() for v in votes} == {-1, 0, 1}


def test_scores_and_tiers_are_made_for_patterns_of_votes(spark, monkeypatch):
    real, written = scoring.materialise, {}
    for module in (scoring, scoring_queries):
        monkeypatch.setattr(module, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    got = {"score_v2": sorted(map(tuple, scoring_queries.score_v2(spark, SF).collect()))}
    written.clear()
    got["score_v2_overlaps"] = sorted(map(tuple, scoring_queries.score_v2_overlaps(spark, SF).collect()))
    assert "votes" not in written and "scored" not in written  # of the tables as long as the ads only these are written
    known = written["patterns"].collect()
    assert written["labels"].count() == len(known) < 200 and sum(r["n"] for r in known) == len(got["score_v2"]) == 1500
    monkeypatch.undo()
    # beside it, each ad on its own
    voted = real(scoring_queries.votes(spark, SF).select("ad_id", "platform", *scoring.VOTES), "votes")
    assert {tuple(r[v] for v in scoring.VOTES): r["n"] for r in known} == {tuple(r[v] for v in scoring.VOTES): r["count"] for r in voted.groupBy(*scoring.VOTES).count().collect()}
    for name, fitted in (("score_v2", scoring.label_model(voted)), ("score_v2_overlaps", label_model.with_labels(voted, scoring.VOTES))):
        plain = fitted.select("ad_id", "platform", F.round("p_high", 6).alias("score"), F.round("p_high", 4).alias("p_high"), F.round(1 - F.col("p_high"), 4).alias("p_low"))
        assert got[name] == sorted(map(tuple, scoring.with_tier(plain).collect()))


def test_a_row_stands_for_as_many_as_it_says(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, i / 40, i / 40]), r.choice([-1, 0, 1]), r.choice([-1, 0, 1]), r.randint(1, 9) * (i + 1)) for i in range(40)]
    counted = spark.createDataFrame(rows, "i int, score double, a int, b int, n int")
    each = spark.createDataFrame([x for x in rows for _ in range(x[4])], counted.schema)
    assert scoring.tier_cutoffs(counted, "n").collect() == scoring.tier_cutoffs(each).collect() != scoring.tier_cutoffs(counted).collect()
    (o, n), (wanted, m) = label_model.overlaps(counted, ["a", "b"], "n"), label_model.overlaps(each, ["a", "b"])
    assert n == m == sum(x[4] for x in rows) and (o == wanted).all()


def test_weak_platforms_are_not_ranked(spark):
    df = spark.createDataFrame([(p, float(i), float(i)) for p in ("facebook", "reddit", "other") for i in range(1, 12)], "platform string, weighted_engagement double, weighted_velocity double")
    made = scoring.vote_features(df.withColumns({"last_seen": F.to_date(F.lit("2024-01-01")), "longevity_days": F.lit(10).cast("long")})).groupBy("platform").agg(F.count("volume_high"), F.count("velocity_low")).collect()
    assert sorted(map(tuple, made)) == [("facebook", 11, 11), ("other", 0, 0), ("reddit", 0, 0)]
