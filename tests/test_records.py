"""Records, renderings and summaries of comparisons, by hand."""

import math

import pytest

from copperleaf.operators import records

EXAMPLE = "example_id string, task_format string, messages array<struct<role:string,text:string>>, platform string, vertical string, source_tiers array<string>, construction_model string, extra int"


def test_records_and_the_first_rendered(spark):
    rows = [("b", "copywriting", [("user", "q"), ("assistant", "a")], "x", "v", ["high"], "m", 1), ("a", "copywriting", [("user", "é\n"), ("assistant", None)], None, None, [], None, 2), ("c", "copywriting", [], "x", "v", None, "m", 3)]
    made = records.dataset_records(spark.createDataFrame(rows, EXAMPLE))
    assert made.columns == ["example_id", "task_format", "messages", "platform", "vertical", "source_tiers", "construction_model"]
    assert {r["example_id"]: [tuple(m) for m in r["messages"]] for r in made.collect()}["b"] == [("user", "q"), ("assistant", "a")]
    first = records.first_rendered(made).collect()
    assert [tuple(r) for r in first] == [("a", "<|im_start|>user\né\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")]
    assert records.first_rendered(made.limit(0)).collect() == []


def test_summary_of_divergences_with_failures(spark):
    nan = float("nan")
    rows = [("a", "x", 0.5, 0.4, 0.6, 10), ("a", "x", 0.7, 0.6, 0.8, 5), ("a", "x", None, None, None, 1), ("b", "x", nan, 0.1, 0.2, 3), ("b", "x", 0.9, 0.3, 0.4, 4), ("c", None, nan, nan, nan, 2), ("d", "x", 0.1, 0.0, 0.2, 1)]
    df = spark.createDataFrame(rows, "config string, platform string, mauve double, ci_low double, ci_high double, n_gen int")
    got = {r["config"]: r for r in records.divergence_summary(df, ["config", "platform"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["n"], a["n_gen_total"], a["mauve_min"], a["mauve_max"]) == (3, 16, 0.5, 0.7) and a["mauve_mean"] == pytest.approx(0.6) and a["mauve_median"] == pytest.approx(0.6) and a["ci_low_mean"] == pytest.approx(0.5)
    assert math.isnan(b["mauve_mean"]) and math.isnan(b["mauve_median"]) and b["mauve_min"] == b["mauve_max"] == 0.9
    assert all(math.isnan(c[k]) for k in ("mauve_mean", "mauve_median", "mauve_min", "mauve_max")) and c["n"] == 1 and len(got) == 4


def test_likeness_to_gold_of_the_configurations_beside_it(spark):
    pairs = spark.createDataFrame([("A", "GOLD"), ("GOLD_x", "B"), ("A", "C"), ("GOLD", "GOLD_x"), ("B", "GOLD")], "a string, b string")
    assert sorted(r["config"] for r in records.compared_to_gold(pairs).collect()) == ["A", "B"]
    said = [("A", "1", "the cat sat", [1.0, 0.0]), ("A", "2", "nothing", None), ("B", "1", "", [0.0, 1.0]), ("C", "1", "the cat sat", [1.0, 0.0]), ("A", "9", "no brief", [1.0, 0.0])]
    briefs = [("1", "p", "v", ["high", "low"], "the cat sat down", [1.0, 0.0]), ("2", "q", None, [], "nothing", [1.0, 0.0])]
    rows = records.gold_likeness(pairs, spark.createDataFrame(said, "config string, example_id string, text string, vector array<double>"), spark.createDataFrame(briefs, "example_id string, platform string, vertical string, source_tiers array<string>, gold string, gold_vector array<double>"))
    got = {(r["config"], r["example_id"]): (r["source_tier"], round(r["rouge_l_f1"], 6), r["cosine_to_gold"]) for r in rows.collect()}
    assert got == {("A", "1"): ("high", round(6 / 7, 6), 1.0), ("A", "2"): (None, 1.0, None), ("B", "1"): ("high", 0.0, 0.0)}
