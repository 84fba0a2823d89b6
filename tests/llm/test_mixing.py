import random

from pyspark.sql import functions as F

from copperleaf.llm import mixing

SF = "/root/testdata/sf0.01"


def brute_seats(votes, house):
    won = [0] * len(votes)
    for _ in range(house):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0.0, 1.0, 7.0, rng.random() * 10 ** rng.randint(0, 6)]) for _ in range(rng.randint(1, 9))]
        house = rng.choice([0, 1, 5, 40, 311])
        if not any(votes):
            continue
        rows += [(g, i, v, house) for i, v in enumerate(votes)]
        want |= {(g, i): n for i, n in enumerate(brute_seats(votes, house))}
    df = spark.createDataFrame(rows, "g int, i int, v double, house long")
    got = {(r["g"], r["i"]): r["seats"] for r in mixing.sainte_lague(df, ["g"], "i", "v", "house").collect()}
    assert got == want


def test_targets_stop_at_twice_the_source(spark):
    df = spark.createDataFrame([("b", 10), ("a", 100), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got["a"] == 200 and got["b"] == 20 and got["c"] == 0
    assert abs(sum(got.values()) - 1.5 * 1110) < 1e-6


def test_mix_meets_targets_with_many_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, shard_words=20000).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    out["source"] = [r["source"] for r in docs.select("doc_id", "source").join(spark.createDataFrame(out[["id"]].reset_index()), F.col("doc_id") == F.col("id")).orderBy("index").collect()]
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (by["size"] == by["source_size"]).all()
    assert ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"] + 64).all()
    again = mixing.mix(docs.repartition(5), shard_words=20000).toPandas()
    assert sorted(map(tuple, again[["id", "taken"]].values)) == sorted(map(tuple, out[["id", "taken"]].values))


ROWS = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", None), (2, None, "s"), (3, "", None), (4, "w " * 100000, "t")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "src": F.lit(1), "seats": F.lit(1), "id": F.lit(0)})
    out = mixing.mix(df).collect()
    assert len(out) == 6
    assert sorted(r["size"] for r in out) == [0, 0, 2, 3, 3, 100000]
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(df.limit(0)).count() == 0
    stage = mixing.repeat_by_mix(spark, df, "")
    assert stage.columns == df.columns
    assert all(r["text"] for r in stage.collect())
    assert mixing.repeat_by_mix(spark, df.limit(0), "").count() == 0


def test_stage_comes_near_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    have = {r["source"]: r["n"] for r in mixing.repeat_by_mix(spark, docs, SF).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    want = {r["source"]: r["target"] for r in mixing.mix(docs).join(docs.select("doc_id", "source"), F.col("id") == F.col("doc_id")).select("source", "target").distinct().collect()}
    assert abs(sum(have.values()) / sum(want.values()) - 1) < 0.03
