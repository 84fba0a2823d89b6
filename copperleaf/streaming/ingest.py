"""Pages of ads as they arrive: each ad once, running counters, patches, windows, and the paging state of each query.

Streams read folders of JSON lines and keep their offsets and state in a checkpoint folder, so a stream that dies goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copperleaf.cluster import scratch_path
from copperleaf.sources.files import update_records


#: State beside the heap, on the executors' disks and in the checkpoint, so that it may outgrow memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def pages(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of JSON files that are put into a folder. Streams of this session keep their state in RocksDB."""
    spark.conf.set(*STATE_STORE)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def first_seen_only(stream: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each key once, the first that comes. The state holds every key for ever; with a watermark (column, delay) only those within the delay,
    and a key that comes again later than that is new."""
    if watermark is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])


def append_all(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()


def running_counts(stream: DataFrame, by: list[str], path: str, checkpoint: str) -> None:
    """Counters by key: each batch writes the keys that it changed to a folder of its own, which a rerun of the batch writes again."""
    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))
    query = counts.writeStream.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/batch={i:09d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()
    query.awaitTermination()


def latest_counts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The counters as they stand: of each key the row of the last batch that changed it."""
    return spark.read.parquet(path).groupBy(*by).agg(F.max_by("n", "batch").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by window of time, final once the watermark has passed it; what comes later than ``late`` is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def append_patches(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Add the patches that are there now to a log, each batch in a folder by its number, which a rerun of the batch writes again; so a stream
    that dies and starts anew loses none and adds none twice. The table itself is not written."""
    put = lambda rows, i: rows.write.mode("overwrite").parquet(f"{log}/batch={i:09d}")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def patched(base: DataFrame, log: str, key: str = "ad_id", order: str = "ts") -> DataFrame:
    """``base`` with the patches of a log. Of each key and column the last value that is not null stands, by batch and then ``order``, however the
    patches were cut into batches; maps are merged entry by entry."""
    patches = base.sparkSession.read.parquet(log)
    at = F.struct("batch", order)
    columns = [c for c in patches.columns if c not in (key, order, "batch")]
    maps = [c for c in columns if isinstance(patches.schema[c].dataType, T.MapType)]
    last = patches.groupBy(key).agg(F.max(at).alias("_at"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns if c not in maps]).drop("_at")
    for c in maps:
        entries = patches.select(F.col(key).alias("_k"), at.alias("_at"), F.explode(c).alias("_name", "_value")).groupBy("_k", "_name").agg(F.max_by("_value", "_at").alias("_value"))
        merged = entries.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias(c))
        last = last.join(merged, F.col(key) == F.col("_k"), "left").drop("_k")
    return update_records(base, last, key).drop("touched")


def paging_state(calls: DataFrame) -> DataFrame:
    """calls: (key, page, last_hit, has_next, n_ads), each page once. Where a query stands: the pages that it has, its cursor, and whether it is
    done, which is when there is no next page, no cursor, or nothing on the page. A query that is not done and has no cursor starts anew."""
    last = calls.groupBy("key").agg(F.max(F.struct("page", "last_hit", "has_next", "n_ads")).alias("l"))
    done = ~F.coalesce("l.has_next", F.lit(False)) | F.col("l.last_hit").isNull() | (F.coalesce("l.n_ads", F.lit(0)) == 0)
    return last.select("key", F.col("l.page").alias("pages_fetched"), F.col("l.last_hit").alias("last_hit"), done.alias("done"))


def next_pages(state: DataFrame) -> DataFrame:
    """(key, page, last_hit) of the queries that are not done; without a cursor from page 1."""
    known = F.col("last_hit").isNotNull()
    return state.filter("NOT done").select("key", F.when(known, F.col("pages_fetched") + 1).otherwise(1).alias("page"), "last_hit")


def write_batches(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def scratch(spark: SparkSession) -> tuple[str, str, str]:
    """(input, output, checkpoint): new folders."""
    root = scratch_path(spark, "stream")
    return f"{root}/in", f"{root}/out", f"{root}/state"
