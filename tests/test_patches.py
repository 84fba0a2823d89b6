"""A patch stream that dies and starts anew between and within batches loses nothing."""

import pytest
from pyspark.sql import functions as F

from copperleaf.streaming import ingest

SCHEMA = "ad_id long, lang string, tags map<string,string>, ts long"


def deliver(spark, came, rows):
    ingest.write_batches(spark.createDataFrame(rows, SCHEMA), came)


def now(spark, out, log):
    return {r["ad_id"]: (r["lang"], r["tags"]) for r in ingest.patched(spark.read.parquet(out), log).collect()}


def test_restarts_between_batches_keep_every_patch(spark):
    came, out, state = ingest.scratch(spark)
    log = f"{out}-patches"
    spark.createDataFrame([(i, "en", {"a": "0"}) for i in range(1, 5)], "ad_id long, lang string, tags map<string,string>").write.parquet(out)
    deliver(spark, came, [(1, "fr", None, 5), (2, None, {"b": "1"}, 6)])
    ingest.append_patches(ingest.pages(spark, came, SCHEMA), log, state)
    deliver(spark, came, [(2, "de", {"a": "2"}, 1), (3, "es", None, 2), (3, None, {"a": "3"}, 3), (9, "xx", None, 4)])
    ingest.append_patches(ingest.pages(spark, came, SCHEMA), log, state)
    want = {1: ("fr", {"a": "0"}), 2: ("de", {"a": "2", "b": "1"}), 3: ("es", {"a": "3"}), 4: ("en", {"a": "0"})}
    assert now(spark, out, log) == want
    ingest.append_patches(ingest.pages(spark, came, SCHEMA), log, state)  # nothing new
    assert now(spark, out, log) == want


@pytest.mark.parametrize("dies_after_writing", [False, True])
def test_a_batch_that_dies_is_written_again(spark, monkeypatch, dies_after_writing):
    came, out, state = ingest.scratch(spark)
    log = f"{out}-patches"
    spark.createDataFrame([(1, "en", None), (2, "en", None)], "ad_id long, lang string, tags map<string,string>").write.parquet(out)
    deliver(spark, came, [(1, "fr", None, 1)])
    ingest.append_patches(ingest.pages(spark, came, SCHEMA), log, state)
    deliver(spark, came, [(2, "de", None, 2)])
    stream = ingest.pages(spark, came, SCHEMA)

    def dies(rows, i):
        if dies_after_writing:
            rows.write.mode("overwrite").parquet(f"{log}/batch={i:09d}")
        raise RuntimeError("dead")

    with pytest.raises(Exception, match="dead"):
        stream.writeStream.foreachBatch(dies).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    ingest.append_patches(ingest.pages(spark, came, SCHEMA), log, state)
    assert {k: v[0] for k, v in now(spark, out, log).items()} == {1: "fr", 2: "de"}
    assert spark.read.parquet(log).select(F.count("*")).first()[0] == 2
