"""The cascade repairs an example once, however many of its stages read it."""

from pyspark.sql import functions as F

from copperleaf.operators import examples


def test_examples_are_repaired_once(spark):
    told = spark.sparkContext.accumulator(0)

    def seen(i):
        told.add(1)
        return i

    rows = [(i, "natural", [("user", f"ask{i} " * 40), ("assistant", f"say{i} " * 60)], [i]) for i in range(20)]
    table = spark.createDataFrame(rows, "example_id long, style string, messages array<struct<role:string,text:string>>, source_ids array<long>")
    table = table.withColumn("example_id", F.udf(seen, "long")("example_id"))
    assert examples.stage_counts(examples.judged(table, language=F.lit("en"))).collect() == [("passed", 20)]
    assert told.value == 20
