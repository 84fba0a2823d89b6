"""Small cases with results worked out by hand: scores, survival, votes, text checks, cascade, files."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from copperleaf.cluster import fresh, join_counted, materialise, shared_dir
from copperleaf.functions import copy, derived, text
from copperleaf.operators import calibration, construct, corpus, divergence, examples, inputs, predictor, ranking, scoring, selection, similarity
from copperleaf.sources import files, parsers
from copperleaf.streaming import ingest


def one(spark, column):
    """The value of a column without a table."""
    return spark.range(1).select(column.alias("x")).first()["x"]


def ads(spark, rows):
    """rows: (ad_id, platform, days, last_seen, shares)."""
    made = [Row(ad_id=i, platform=p, active_days=n, first_seen=None, last_seen=s, likes=0, comments=0, shares=e, reactions=0, views=0) for i, p, n, s, e in rows]
    schema = "ad_id string, platform string, active_days long, first_seen date, last_seen date, likes long, comments long, shares long, reactions long, views long"
    return derived.with_features(spark.createDataFrame(made, schema))


# -- ranks


@pytest.mark.parametrize(
    ("values", "want"),
    [([10, 20, 30, 40, 50], [0, 0.25, 0.5, 0.75, 1]), ([None, 10, 30, None, 20], [None, 0, 1, None, 0.5]), ([42], [0.5]), ([5, 5, 5], [0.5, 0.5, 0.5]), ([1, 2, 2, 3], [0, 0.5, 0.5, 1]), ([], [])],
)
def test_percentiles(spark, values, want):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double")
    got = dict(map(tuple, ranking.with_positions(df, {"p": ("v", [])}).select("i", "p").collect()))
    assert [got[i] for i in range(len(values))] == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_ranks_by_group_whatever_the_join(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    rows = [(i, rng.choice("abc") if i % 9 else None, rng.choice([None, 0.0, 1.5, 2.5, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(5)
    got = {r["i"]: (r["p"], r["q"]) for r in ranking.with_positions(df, {"p": ("v", ["g"]), "q": ("v", [])}).collect()}

    def rank(v, among):
        return None if v is None else 0.5 if len(among) == 1 else round((sum(x < v for x in among) + (sum(x == v for x in among) - 1) / 2) / (len(among) - 1), 6)

    known = [r for r in rows if r[2] is not None]
    for i, g, v in rows:
        want = (rank(v, [x for _, h, x in known if h == g]), rank(v, [x for _, _, x in known]))
        assert got[i] == pytest.approx(want) if v is not None else got[i] == (None, None)


def test_running_sums_and_empty_tables(spark):
    rows = [(i, i % 3, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g long, c long").repartition(6)
    got = {r["i"]: (r["s"], r["s_total"]) for r in ranking.running(df, ["g"], [F.col("i").desc()], {"s": "c"}).collect()}
    assert got == {i: (sum(c for j, h, c in rows if h == g and j > i), sum(c for _, h, c in rows if h == g)) for i, g, _ in rows}
    assert ranking.running(df.limit(0), [], [F.col("i")], {"s": "c"}).count() == 0


def test_quantiles_are_medians(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 20.0), ("b", 3.0), ("b", None)], "g string, v double")
    assert {r["g"]: r["m"] for r in ranking.quantiles(df, "v", ["g"], {"m": 0.5}).collect()} == {"a": 6.0, "b": 3.0}


def test_counted_join_equals_a_join(spark):
    rows = [(i, 0 if i < 300 else i % 50) for i in range(600)]
    left = spark.createDataFrame(rows, "i long, k long")
    right = materialise(left.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("n")).filter("_k <> 7"), "keys")
    got = sorted(map(tuple, join_counted(left, "k", right, "_k", "n").select("i", "n").collect()))
    assert got == sorted((i, sum(k == x for _, x in rows)) for i, k in rows if k != 7)
    assert join_counted(left, "k", right.limit(0), "_k", "n").count() == 0


def test_fresh_names_and_the_shared_folder(spark):
    assert fresh(spark.createDataFrame([], "a long, _A long"), "a", "b", "b") == ["__a", "b", "_b"]
    named = spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) in (named and named.rstrip("/"), "/tmp/checkpoints")


# -- survival, scores, votes, tiers

DAY = dt.date(2024, 3, 1)


def survived(spark, rows):
    return {r["ad_id"]: r["survivability"] for r in scoring.survivability(ads(spark, rows)).collect()}


def test_a_lone_ad_and_days_that_do_not_count(spark):
    got = survived(spark, [("a", "facebook", 10, DAY, 1), ("zero", "facebook", 0, DAY, 1), ("none", "facebook", None, None, 1)])
    assert got == {"a": 0.5, "zero": None, "none": None}


def test_small_platforms_take_the_curve_of_all_and_long_runs_are_cut(spark):
    old = dt.date(2023, 1, 1)
    rows = [(f"f{i}", "facebook", i + 1, old, 1) for i in range(25)] + [("p1", "pinterest", 13, old, 1), ("p2", "pinterest", 9000, old, 1), ("now", "facebook", 30, DAY, 1)]
    got = survived(spark, rows)
    assert all(got[f"f{i}"] <= got[f"f{i + 1}"] for i in range(24)) and all(0 <= x <= 1 for x in got.values())
    every = sorted(n for _, p, n, _, _ in rows)
    s = 1.0
    for t in range(1, 14):  # deaths at each day over all, by hand
        at_risk = sum(min(n, 3650) >= t for n in every)
        s *= 1 - sum(n == t for n in every) / at_risk
    assert got["p1"] == pytest.approx(1 - s) and got["p2"] == 1.0


def test_ads_still_seen_are_no_deaths(spark):
    rows = [(f"d{i}", "facebook", 5, dt.date(2023, 1, 1), 1) for i in range(20)] + [("live", "facebook", 9, DAY, 1)]
    got = survived(spark, rows)
    assert got["live"] == got["d0"] == pytest.approx(20 / 21)


def test_votes_and_the_label_model(spark):
    old = dt.date(2023, 1, 1)
    rows = [(f"w{i}", "facebook", 1 + i % 2, old, 1 + i % 2) for i in range(15)] + [(f"s{i}", "facebook", 200 + i, old, 3000 + i) for i in range(15)] + [("quiet", "facebook", 30, old, 0), ("now", "facebook", 60, DAY, 500)]
    voted = scoring.votes(scoring.vote_features(ads(spark, rows)))
    quiet = voted.filter("ad_id = 'quiet'").first()
    assert [quiet[v] for v in ("vote3", "vote4", "vote5", "vote6")] == [-1] * 4  # no engagement is no vote
    fitted = {r["ad_id"]: r["p_high"] for r in scoring.label_model(voted).collect()}
    assert len(fitted) == len(rows) and all(0 <= p <= 1 for p in fitted.values())
    assert max(fitted[f"w{i}"] for i in range(15)) < min(fitted[f"s{i}"] for i in range(13, 15))
    none = voted.limit(1).withColumns({v: F.lit(-1) for v in scoring.VOTES})
    assert scoring.label_model(none).first()["p_high"] == 0.5 and scoring.majority(none).first()["p_high"] == 0.5
    all_high = voted.limit(1).withColumns({v: F.lit(1) for v in scoring.VOTES})
    assert scoring.majority(all_high).first()["p_high"] == 0.9


def test_equal_scores_are_all_high(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(10)], "i long, score double")
    assert {r["tier"] for r in scoring.with_tier(df).collect()} == {"high"}
    ten = scoring.with_tier(spark.createDataFrame([(i, i / 10) for i in range(10)], "i long, score double")).groupBy("tier").count().collect()
    assert dict(map(tuple, ten)) == {"high": 2, "medium": 5, "low": 3}


def test_weak_platforms_and_missing_signals(spark):
    old = dt.date(2023, 1, 1)
    rows = [(f"r{i}", "reddit", i + 1, old, i * 5) for i in range(5)] + [("none", "facebook", None, None, 0)]
    got = {r["ad_id"]: r for r in scoring.score_v3(ads(spark, rows)).collect()}
    assert got["r0"]["volume_pct"] is None and got["r4"]["score"] == got["r4"]["survivability_pct"]
    assert {r["ad_id"]: r["score"] for r in scoring.score_v1(ads(spark, rows)).collect()}["none"] == 0.5


def test_days_that_a_source_counts_win_and_fill_the_first_day(spark):
    rows = spark.createDataFrame([("a", "adflex", "x", 7, None, DAY, 1.0), ("b", "adflex", "x", 0, None, DAY, 1.0), ("c", "meta", None, None, DAY, DAY, 1.0)], "ad_id string, source string, advertiser_id string, active_days long, first_seen date, last_seen date, spend double")
    got = {r["ad_id"]: (r["advertiser_ad_count"], r["first_seen"], r["spend"]) for r in construct.backfill(rows).collect()}
    assert got == {"a": (2, dt.date(2024, 2, 23), None), "b": (2, None, None), "c": (0, DAY, 1.0)}
    both = ads(spark, [("a", "facebook", 3, DAY, 1)]).withColumn("first_seen", F.lit(dt.date(2024, 1, 1)))
    assert derived.with_features(both).first()["longevity_days"] == 3


# -- text

WIDE = " "


def test_white_space_and_letters_of_any_script(spark):
    lit = lambda s: F.lit(s)
    assert one(spark, text.scripture_reason(lit(f"a Holy{WIDE}Bible"))) == "explicit_scripture_term"
    assert one(spark, text.scripture_reason(lit("John 3:16 says"))) == "bible_verse_citation"
    assert one(spark, text.scripture_reason(lit("call us at 3:16"))) is None
    assert one(spark, text.is_clean_headline(lit("#été #über"), lit("b"), lit(""))) is False
    assert one(spark, text.is_clean_headline(lit("  "), lit("b"), lit(""))) is True
    assert one(spark, text.is_clean_headline(lit("Same"), lit("sAME "), lit(""))) is False
    assert one(spark, text.stripped(lit(f" {WIDE}x y　\n"))) == "x y" and one(spark, text.stripped(F.lit(None).cast("string"))) == ""
    assert one(spark, text.build_text(F.lit(None).cast("string"), lit(" Retail "), lit(" a "), F.lit(None).cast("string"), lit("b"))) == "[platform=unknown] [vertical=retail]\na\nb"
    assert one(spark, text.build_text(lit("x"), lit("y"), lit(" "))) == ""


def test_hedges_leaks_and_specifics(spark):
    assert one(spark, text.hedge(F.lit("One option is x. You could also try y."))) == "you could also try"
    assert one(spark, text.hedge(F.lit("plain"))) is None
    assert one(spark, text.schema_leak(F.lit("hi\n  Business  Vertical : x"))) == "business  vertical"
    assert one(spark, text.schema_leak(F.lit("the headline: x"))) is None
    assert one(spark, text.specifics(F.lit("32% off, $5, 1,200 likes"))) == ["percent", "dollar", "engagement_count"]


def test_quotes(spark):
    head = "Seven words are here for the signature"
    assert one(spark, text.quotes_one_of(F.lit("**SEVEN words: are here, for** the rest"), F.lit(head), F.lit(None).cast("string"))) is True
    assert one(spark, text.quotes_one_of(F.lit("seven other words"), F.lit(head))) is False
    assert one(spark, text.quotes_one_of(F.lit("anything"), F.lit("short"), F.lit(None).cast("string"))) is True
    assert one(spark, text.quotes_one_of(F.lit("a long one word"), F.lit("supercalifragilistic"))) is False  # no signature to find


@pytest.mark.parametrize(
    ("said", "want"),
    [("1,000-2,000", (1000, 2000)), ("<1000", (0, 1000)), ("≤ 5", (0, 5)), ("≥1000", (1000, None)), (">10", (10, None)), ("7+", (7, None)), ("12", (12, 12)), ("lots", (None, None)), (None, (None, None)), ("", (None, None)), ("1-x", (None, None))],
)
def test_buckets(spark, said, want):
    low, high = derived.bucket_bounds(F.lit(said).cast("string"))
    assert tuple(spark.range(1).select(low, high).first()) == want


CLEANING = [
    ("plain copy", "plain copy"), ("<think>x\ny</think>\nCopy", "Copy"), ("**Ad Copy:**\n\nBuy it", "Buy it"), ("Here's the ad:\n\nBuy it", "Buy it"), ("Sure! Here you go:\nBuy it", "Buy it"),
    ("**Copy**\nHere is a draft:\nBuy it", "Buy it"), ("Buy it\n\n**Why this works:** because", "Buy it"), ("Buy it\nRationale: x\ny", "Buy it"), ("**Headline:** Foo", "**Headline:** Foo"), ("Here's to you.", "Here's to you."), ("", ""), (None, None),
]


@pytest.mark.parametrize(("raw", "want"), CLEANING)
def test_cleaning(spark, raw, want):
    once = copy.clean_copy(F.lit(raw).cast("string"))
    assert one(spark, once) == want and one(spark, copy.clean_copy(once)) == want


def test_wrappers_hosts_and_languages(spark):
    assert one(spark, copy.unwrapped(F.lit('```\n"a"\n```'))) == "a" and one(spark, copy.unwrapped(F.lit('"a" said b'))) == '"a" said b' and one(spark, copy.unwrapped(F.lit('"'))) == '"'
    hosts = {"https://Shop.Example.com/x?y": "shop.example.com", "opify.com": "opify.com", "": "", " http://a.b:80/ ": "a.b"}
    assert {u: one(spark, copy.host(F.lit(u))) for u in hosts} == hosts
    for url, frag, want in (("http://a.shop.com", "shop.com", True), ("http://smartgyro.com", "ro.co", False), ("http://ashop.com", "shop.com", False), ("x.com/prime/1", "x.com/prime", True), (None, "a.b", False)):
        assert one(spark, copy.on_domain(F.lit(url).cast("string"), F.lit(frag))) is want
    assert one(spark, copy.language(F.lit("the cat and the dog is in the house"))) == "en" and one(spark, copy.language(F.lit("der Hund und die Katze"), F.lit("das ist nicht"))) == "de"
    assert one(spark, copy.language(F.lit("the"))) == "" and one(spark, copy.language(F.lit("xx yy zz qq ww ee"))) == ""
    assert one(spark, copy.with_query("http://a/", q=F.lit("x y&z"), n=F.lit(None).cast("string"), c=F.lit("US"))) == "http://a/?q=x+y%26z&c=US"
    html = "<html><head><title>t</title></head><script>x</script><nav>menu</nav><p>One <b>two</b></p><!-- c --><p>a &lt; b&nbsp;&amp;amp;</p></html>"
    assert one(spark, copy.main_text(F.lit(html))) == "One two\na < b &amp;"


# -- corpus


def test_exact_dedup_leaves_one_row_of_each_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, " A "), (3, None), (4, " "), (5, "b"), (5, "b")], "i long, t string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = corpus.first_of_each(df, text.text_key(F.col("t")), "i")
    assert sorted((r["i"], r["t"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, None)] and got.columns == df.columns
    assert corpus.first_of_each(df.limit(0), text.text_key(F.col("t")), "i").count() == 0


def test_chats(spark):
    long = "x" * 250
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, 0, "assistant", long), (2, 1, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "\n" * 60), (4, 0, "user", "hi")]
    got = {r["conv_id"]: (r["has_reply"], r["valid"], r["long_enough"]) for r in corpus.chat_checks(corpus.chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: (True, True, True), 2: (False, True, True), 3: (True, False, False), 4: (False, False, False)}


def test_small_strata_go_to_train(spark):
    df = spark.createDataFrame([(i, "big") for i in range(20)] + [(i, "small") for i in range(2)] + [(9, None)], "i long, s string")
    got = corpus.stratified_split(df, "s", "i").groupBy("s", "split").count().collect()
    assert {tuple(r) for r in got} == {("big", "train", 16), ("big", "val", 2), ("big", "test", 2), ("small", "train", 2), (None, "train", 1)}


def test_cascade(spark):
    good = "the cat and the dog is in the house with you for that and this. " * 4
    chat = lambda *said: [Row(role=r, text=t) for r, t in said]
    rows = [
        (1, "natural", chat(("user", "q"), ("assistant", good)), ["a", "b"]), (2, "natural", chat(("user", "q"), ("assistant", good)), ["b", "a", "a"]), (3, "natural", chat(("user", "q"), ("assistant", good)), []),
        (4, "natural", chat(("assistant", good), ("user", "q")), ["c"]), (5, "natural", chat(("user", "<foo>"), ("assistant", good)), ["d"]), (6, "natural", chat(("user", "q"), ("assistant", "short")), ["e"]),
        (7, "backtranslation", chat(("user", "q"), ("assistant", "CTA: buy\n" + good + " you could also try x")), ["f"]), (8, "context_distilled", chat(("user", "q"), ("assistant", good + " 5% off")), ["g"]),
        (9, "backtranslation", chat(("user", "q"), ("assistant", "the cat and the dog is in the house with you and me for this and that, and so it is with all of it")), ["h"]), (10, "natural", chat(("user", "q"), ("assistant", "der Hund und die Katze nicht das ist " * 9)), ["i"]),
        (11, "natural", chat(("user", "q"), ("assistant", f"<thinking>x</thinking><assistant_response>{good}</assistant_response>")), ["j"]),
    ]
    df = spark.createDataFrame(rows, "example_id long, style string, messages array<struct<role:string,text:string>>, source_ids array<string>")
    judged = materialise(examples.judged(df, response_like=1.0, prompt_like=1.0), "judged")
    got = {r["example_id"]: (r["stage"], list(r["reasons"])) for r in judged.collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: None, 2: "source_ad_duplicate", 3: None, 4: "structural", 5: "artifact_leak", 6: "min_length", 7: "format_specific", 8: "style_b_specificity", 9: None, 10: "language", 11: None}
    assert got[7][1] == ["schema_leak:cta", "ad_centrality:you could also try"] and got[5][1] == ["artifact_leak:user:<foo>"] and got[2][1] == ["source_ad_duplicate:first=1"]
    assert dict(map(tuple, examples.stage_counts(judged).collect()))["format_specific"] == 2
    alike = {r["example_id"]: r["stage"] for r in examples.judged(df).collect()}
    assert alike == {i: s for i, (s, _) in got.items()} | {i: "duplicate" for i in (2, 3, 9, 11)}
    assert judged.filter("repaired").count() >= 1 and examples.judged(df.limit(0)).count() == 0


def test_personas_and_choices(spark):
    people = [{"id": "a", "formats": ["copy"], "scale": "small", "allowed": ["x"]}, {"id": "b", "scale": "large", "blocked": ["x"]}, {"id": "c", "scale": "small", "weight": 0.0}]
    rows = spark.createDataFrame([(1, "copy", "small", "x"), (2, "copy", "large", "y"), (3, "copy", "small", "y"), (4, "copy", "large", "x"), (5, "copy", "huge", "y")], "i long, task_format string, ad_scale string, ad_vertical string")
    got = {r["i"]: (r["persona"], r["relaxed"]) for r in selection.personas_for(rows, people, F.lit(0.5)).collect()}
    assert got[1] == ("a", 0) and got[2] == ("b", 0) and got[4] == ("b", 1) and got[5][1] == 3 and got[5][0] in ("a", "b")
    picked = selection.weighted_choice(spark.range(3), [("x", 1.0), ("y", -2.0), ("z", 3.0)], F.element_at(F.array(F.lit(0.1), F.lit(0.26), F.lit(1.0)), (F.col("id") + 1).cast("int")), "c")
    assert [r["c"] for r in picked.orderBy("id").collect()] == ["x", "z", "z"]


# -- likeness


def test_text_scores(spark):
    said, other = "The quick brown fox jumps over it", "Nothing like that"
    df = spark.createDataFrame([(1, said, said, [said, other]), (2, "", said, [other]), (3, other, said, []), (4, "quick fox over", said, [said])], "i long, t string, g string, r array<string>")
    got = {r["i"]: r for r in similarity.with_reference_metrics(df, "t", "g", "r").collect()}
    assert got[1]["rouge_l_gold"] == got[1]["chrf_gold"] == 1.0 and got[1]["bleu_gold"] == pytest.approx(1.0) and got[1]["excess"] == 0.0
    assert got[2]["rouge_l_gold"] == got[2]["bleu_multi"] == 0.0 and got[3]["rouge_l_gold"] == got[3]["bleu_gold"] == 0.0
    assert got[4]["rouge_l_gold"] == pytest.approx(2 * 1 * (3 / 7) / (1 + 3 / 7)) and got[1]["meteor_gold"] is None and got[1]["bertscore_multi"] is None


def test_common_subsequences():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(80))] for _ in range(2))
        assert similarity.lcs_length(a, b) == plain(a, b)


def test_nearest_references_fall_back_to_all_and_leave_the_own_text_out(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 0.05], [0.5, 0.5]]
    rows = spark.createDataFrame([(i, "p" if i < 3 else "q", f"k{i}" if i != 3 else "k0", x) for i, x in enumerate(v)], "id long, platform string, key string, vector array<double>")
    got = similarity.nearest_references(rows.filter("id IN (0, 4)"), rows, 3).orderBy("gold_id", "place").collect()
    assert [(r["gold_id"], r["ref_id"]) for r in got] == [(0, 1), (0, 2), (4, 1), (4, 3), (4, 0)]  # q has two rows: all are asked
    assert similarity.nearest_references(rows.limit(0), rows, 2).count() == 0


def test_held_out_references(spark):
    rows = spark.createDataFrame([(1, "p", "high", "One"), (2, "q", "high", "one "), (3, "q", "high", "two"), (4, "q", "low", "three"), (5, "p", "high", "")], "order long, platform string, tier string, blob string")
    held = spark.createDataFrame([("TWO",), (" ",)], "text string")
    kept, counts = similarity.reference_corpus(rows, held)
    assert sorted(map(tuple, kept.select("platform", "text").collect())) == [("ALL", "One"), ("p", "One")]
    assert counts.first()["overlap"] == 1 and counts.first()["percent"] == 100.0
    with pytest.raises(ValueError):
        similarity.reference_corpus(rows, held, strict=True)
    with pytest.raises(ValueError):
        similarity.reference_corpus(rows.filter("blob = 'two'"), held)


# -- files, parsers, streams, calibration


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n\n{"a": 2\n{"a": "3"}\n')
    rows = files.read_jsonl_tolerant(spark, path, "a long").cache()
    assert rows.filter(f"{files.CORRUPT} IS NULL").count() >= 1 and rows.filter(f"{files.CORRUPT} IS NOT NULL").count() >= 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path, "a long").collect()
    assert files.campaign_columns(["Clicks (all)", "ad name", "Impressions", "AMOUNT SPENT", "Link Clicks"])["clicks"] == "Link Clicks"
    with pytest.raises(ValueError, match="spend_usd"):
        files.campaign_columns(["ad name", "impressions", "clicks (all)"])
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        files.read_configs(spark, str(tmp_path), ["none"])
    for judge, name in (("j1", "a"), ("j2", "b%2Fc")):
        (tmp_path / "tree" / judge).mkdir(parents=True)
        (tmp_path / "tree" / judge / f"{name}.json").write_text('{"v": 1}')
    assert sorted(map(tuple, files.read_tree(spark, str(tmp_path / "tree"), "v long", ["judge", "id"]).select("judge", "id", "v").collect())) == [("j1", "a", 1), ("j2", "b%2Fc", 1)]
    built = []
    build = lambda: built.append(1) or spark.createDataFrame([("p", "t"), ("q", "u")], "platform string, text string")
    for keys in (["p"], ["p", "q"], ["p", "z"]):
        files.cached(spark, str(tmp_path / "cache"), keys, build).count()
    assert len(built) == 2


def test_odd_raw_ads(spark):
    rows = spark.createDataFrame([('{"id": 5, "title": null, "engagements": null, "attachments": [], "locations": null, "updated_at": "soon"}',), ("no json",), ('{"id": "x", "attachments": [{"type": "VIDEO"}, {}], "active_days": 3}',)], "json string")
    got = [(r["ad_id"], r["headline"], r["creative_format"], r["likes"], r["country"], r["last_seen"], r["active_days"]) for r in parsers.adflex(rows).collect()]
    assert got == [("5", "", "other", 0, [], None, None), ("", "", "other", 0, [], None, None), ("x", "", "carousel", 0, [], None, 3)]


def test_paging(spark):
    calls = spark.createDataFrame([("a", 1, "c1", True, 18), ("a", 2, "c2", True, 18), ("b", 1, "c", False, 3), ("c", 1, None, True, 3), ("d", 1, "c", True, 0)], "key string, page long, last_hit string, has_next boolean, n_ads long")
    state = ingest.paging_state(calls)
    assert {r["key"]: r["done"] for r in state.collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert [tuple(r) for r in ingest.next_pages(state).collect()] == [("a", 3, "c2")]
    lost = spark.createDataFrame([("e", 4, None, False)], "key string, pages_fetched long, last_hit string, done boolean")
    assert [tuple(r) for r in ingest.next_pages(lost).collect()] == [("e", 1, None)]


def test_isotonic_curves(spark):
    df = spark.createDataFrame([(i / 20, float(i >= 10) * 0.8 + (0.3 if i == 3 else 0.0)) for i in range(21)], "p double, t double")
    heads = {"h": ("p", "t", F.lit(True)), "few": ("p", "t", F.col("p") < 0.2)}
    curves = calibration.loads(calibration.dumps(calibration.fit(df, heads)))
    assert set(curves) == {"h"}
    got = [r["h_calibrated"] for r in calibration.calibrated(df, heads, curves).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == pytest.approx(0.0) and got[-1] == pytest.approx(0.8) and 0 < got[5] < 0.1
    assert calibration.calibrated(df, heads, curves).filter("abs(few_calibrated - p) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        calibration.loads('{"h": {"x": [0, 1], "y": [1, 0]}}')


# -- inputs, predictor, divergence


def test_briefs_of_both_shapes(spark):
    chat = "messages array<struct<role:string,content:string>>"
    old = spark.createDataFrame([("e1", "copywriting", "meta", None, ["high"], [("user", "q"), ("assistant", "a"), ("assistant", "b")])], f"example_id string, task_format string, platform string, vertical string, source_tiers array<string>, {chat}")
    assert inputs.briefs(old).first() == ("e1", "copywriting", "meta", "unknown", ["high"], "", "q", "a")
    new = spark.createDataFrame([([("system", "s")], ("e2", "")), (None, None)], f"{chat}, metadata struct<example_id:string,platform:string>")
    assert [tuple(r) for r in inputs.briefs(new).collect()] == [("e2", "copywriting", "unknown", "unknown", [], "s", "", ""), ("", "copywriting", "unknown", "unknown", [], "", "", "")]
    assert inputs.gold_inferences(inputs.briefs(old), "GOLD_v2").first()["assistant_text"] == "a"


def test_plans_and_facts(spark):
    assert inputs.resolve_geos("eu", {"eu": [1, 2]}) == [1, 2] and inputs.resolve_geos("no", {}) == [None] and inputs.resolve_geos([3], {}) == [3] and inputs.resolve_geos(None, {}) == [None]
    assert one(spark, inputs.call_budget(F.lit(1050), F.lit(100))) == 10
    facts = inputs.ad_facts(F.lit(""), F.lit(" Buy "), F.lit("der Hund und die Katze nicht das ist"), F.lit(None).cast("string"))
    assert one(spark, facts) == "This ad ran for (unknown advertiser).\n\nThe ad copy reads:\n\nBuy"
    assert one(spark, inputs.ad_facts(F.lit("X"), F.lit(""))).endswith("(no usable ad copy fields)")


def test_predictor_learns_words_and_leaves_empty_text_in_the_middle(spark):
    df = spark.createDataFrame([(i, "good fine great" if i % 2 else "bad poor awful", float(i % 2), 1.0) for i in range(40)] + [(90, "", 1.0, 1.0), (91, None, None, 1.0), (92, "bad poor", 1.0, 0.0)], "i long, t string, y double, w double").withColumn("_text", F.lit("x"))
    models = predictor.fit(df.drop("_text"), "t", {"h": ("y", F.lit(True))}, weight="w")
    got = {r["i"]: r["h"] for r in predictor.predict(df.select("i", "t"), "t", models).collect()}
    assert got[90] == got[91] == 0.5 and got[1] > 0.8 and got[0] < 0.2 and all(0 <= x <= 1 for x in got.values())
    assert len(predictor.weights(models["h"], spark)) == 1 << 12


def test_divergence(spark):
    rng = random.Random(2)
    rows = [(i % 2 == 0, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)]
    df = spark.createDataFrame(rows, "side boolean, v array<double>")
    same = divergence.divergence(df, "v", "side", clusters=5).first()
    far = divergence.divergence(df.withColumn("v", F.when(F.col("side"), F.col("v")).otherwise(F.transform("v", lambda x: x + 50))), "v", "side", clusters=5).first()
    assert same["score"] > 0.8 and far["score"] < 0.1 and same["low"] <= same["score"] + 0.1 and (same["n_p"], same["n_q"]) == (100, 100)
    import numpy as np

    assert divergence.frontier_area(np.array([1.0, 2.0]), np.array([1.0, 2.0])) == pytest.approx(1.0)


def test_nearest_references_in_blocks_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "GOLDS", 7)
    monkeypatch.setattr(similarity, "POOL", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[5] = 0
    platform = [["a", "b", None, "few"][i % 3 if i > 3 else 3] for i in range(300)]
    rows = spark.createDataFrame([(i, platform[i], f"k{i % 290}", v.tolist()) for i, v in enumerate(x)], "id long, platform string, key string, vector array<double>").repartition(5)
    got = similarity.nearest_references(rows.filter("id % 9 = 0 OR id < 4"), rows, 5).collect()
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    for g in [i for i in range(300) if i % 9 == 0 or i < 4]:
        own = [j for j in range(300) if platform[j] == platform[g]] if platform[g] in ("a", "b") else range(300)
        want = sorted((-round(float(unit[g] @ unit[j]), 12), j) for j in own if j % 290 != g % 290)[:5]
        mine = sorted((r["place"], r["ref_id"], r["near"]) for r in got if r["gold_id"] == g)
        assert [m[1] for m in mine] == [j for _, j in want] and np.allclose([m[2] for m in mine], [-n for n, _ in want]), g


def test_columns_with_the_names_of_helpers_and_no_weights(spark):
    helpers = ["_p", "_q", "_s0", "_o0", "_t0", "_by0", "_value", "_at", "_rows", "_made", "_key", "_place"]
    df = spark.createDataFrame([(i, i % 3, float(i % 5)) for i in range(30)], "i long, g long, v double").withColumns({h: F.lit("mine") for h in helpers})
    ranked = ranking.with_positions(df, {"r": ("v", ["g"])})
    assert ranked.columns == [*df.columns, "r"] and ranked.filter(" AND ".join(f"{h} = 'mine'" for h in helpers)).count() == 30
    summed = ranking.running(df, ["g"], [F.col("i")], {"before": F.lit(1)})
    assert {r["i"]: (r["before"], r["before_total"]) for r in summed.collect()} == {i: (i // 3, 10) for i in range(30)} and set(summed.columns) >= set(helpers)
    once = corpus.first_of_each(df, F.col("g"), "i")
    assert sorted(r["i"] for r in once.collect()) == [0, 1, 2] and once.columns == df.columns
    for weights in ([], [("a", 0.0), ("b", -1.0)]):
        assert {r["o"] for r in selection.weighted_choice(df, weights, F.lit(0.5), "o").collect()} == {None}


def test_first_of_each_with_copies_nulls_and_maps(spark):
    rows = [(1, "x", {"a": "1"}), (1, "x", {"a": "1"}), (1, "x", {"a": "0"}), (2, "x", None), (3, None, None), (3, None, None), (None, "y", {}), (4, "y", None), (5, "z", {"b": None})]
    df = spark.createDataFrame(rows, "i long, t string, m map<string,string>").repartition(3)
    got = corpus.first_of_each(df, F.col("t"), "i").collect()
    assert sorted(((r["i"] or 0), r["t"] or "") for r in got) == [(0, "y"), (1, "x"), (3, ""), (5, "z")]
