"""Which pairs are compared, and how often a length is computed."""

import math

from pyspark.sql import functions as F

from copperleaf.operators import near_duplicates as nd


def test_only_pairs_that_can_be_alike_are_compared(spark):
    # both meet at their second term; behind it little is left of the first text
    cells = "key long, vector array<struct<place:int,weight:double>>"
    rows = [(1, [(1, 0.5), (3, 0.6), (9, math.sqrt(1 - 0.61))]), (2, [(2, 0.1), (3, 0.1), (9, math.sqrt(0.98))]), (3, [(3, 0.1), (9, math.sqrt(0.99))])]
    only = spark.createDataFrame(rows, cells).withColumn("places", nd.prefix(F.col("vector"), 0.8))
    first = {r["key"]: r["places"] for r in only.collect()}
    assert [c["place"] for c in first[1]] == [1, 3] and abs(first[1][0]["rest"] - math.sqrt(0.75)) < 1e-12 and first[3][-1]["rest"] < 1e-7
    lists = only.select("key", F.inline("places"))
    met = {(r["key"], r["head"]) for r in nd._met(lists, nd._heads(lists, 9), 0.8).collect()}
    assert met == {(3, 2)}


def test_the_length_of_a_vector_is_bound_once(spark, capsys):
    made = nd.tfidf_vectors(spark.createDataFrame([(1, "one two two"), (2, "two three")], "id long, t string"), "id", "t")
    lines = made._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(SQRT(" in lines or "transform(array(sqrt(" in lines.lower()
    assert all(abs(sum(c["weight"] ** 2 for c in r["vector"]) - 1) < 1e-12 for r in made.collect())
