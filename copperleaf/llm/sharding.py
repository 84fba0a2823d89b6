"""Extendible hashing of documents to shards of bounded size.

A shard is the set of hashes with a common prefix. Splitting starts with one shard of prefix length 0; only
a shard over ``limit`` bytes is split, on its next bit, until all fit. The sizes come from sums by
prefix on the map side, 14 bits at a time: a round sums only rows in shards that are still too large, so there
are about log2(bytes / limit) / 14 rounds, and what a round looks at is sums, never documents. The directory of a
round has an entry for each prefix of its 14 bits, pointing to the shard; documents find their
shard in it by an equi-join on that prefix.

Equal hashes cannot be split by bits: they belong to rows with one id and size. Such a bucket is cut into pages
of as many rows as fit. A single document over the limit is a page of its own, larger than the limit.

Defined results: a null or empty text has 0 bytes; null ids hash like the empty id; of a text of any length only its
bytes are counted; repeated rows are all placed; an empty table gives an empty table; columns other than id and text are
never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.llm.mixing import _hash60

BITS, STEP, DEEPEST = 60, 14, 56
#: Rows that are alike and are made again in one task.
PIECE = 1_000_000


def _prefix(bits: int):
    return F.shiftrightunsigned("h", BITS - bits)


def directory(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """(entry, depth, shard_bytes) for each prefix of base + STEP bits; depth is null where none fits."""
    leaves = rows.groupBy(_prefix(base + STEP).alias("entry")).agg(F.sum("bytes").alias("bytes"))
    leaves = materialise(leaves, "directory")
    depths = leaves.select("entry", "bytes", F.explode(F.sequence(F.lit(base), F.lit(base + STEP))).alias("depth"))
    depths = depths.withColumn("prefix", F.expr(f"shiftrightunsigned(entry, {base + STEP} - depth)"))
    sizes = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    fitting = depths.select("entry", "depth", "prefix").join(sizes, ["depth", "prefix"])
    least = fitting.groupBy("entry").agg(F.min(F.struct("depth", "shard_bytes")).alias("s"))
    return leaves.join(least, "entry", "left").select(F.col("entry").alias(f"_entry{base}"), F.col("s.depth").alias(f"_depth{base}"), F.col("s.shard_bytes").alias(f"_bytes{base}"))


def extendible_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """(id, bytes, shard, depth, page, shard_bytes): a row for each row of ``docs``; shard is the prefix in bits."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    slim = docs.select(F.col(id_col).alias("id"), size.alias("bytes"))
    rows = materialise(slim.withColumn("h", _hash60(F.col("id"), F.col("bytes"))), "hashes")
    placed, active, base = rows, rows, 0
    found: list[tuple[str, str]] = []
    while base < DEEPEST:
        entries = materialise(directory(active, base, limit), "directory")
        key = F.col(f"_entry{base}")
        placed = placed.join(entries, _prefix(base + STEP) == key, "left")
        found.append((f"_depth{base}", f"_bytes{base}"))
        large = entries.filter(F.col(f"_depth{base}").isNull()).select(key.alias("_large"))
        if large.isEmpty():
            break
        active, base = active.join(large, _prefix(base + STEP) == F.col("_large"), "left_semi"), base + STEP
    depth, held = F.coalesce(*[F.col(d) for d, _ in found]), F.coalesce(*[F.col(b) for _, b in found])
    out = materialise(placed.select("id", "bytes", "h", depth.alias("depth"), held.alias("shard_bytes")), "placed")
    fits = out.filter("depth IS NOT NULL").withColumn("page", F.lit(0).cast("long"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes"))).cast("long")
    # rows of one hash that have one id and size are alike: they are counted, not gathered, and made again in their places
    alike = out.filter("depth IS NULL").groupBy("h", "id", "bytes").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("h").orderBy("id", "bytes").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = alike.withColumn("first", first).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))))
    rest = pieces.repartition("h", "id", "piece").select("h", "id", "bytes", F.explode(F.expr(f"sequence(first + piece * {PIECE}, first + least(n, (piece + 1) * {PIECE}) - 1)")).alias("row"))
    rest = rest.withColumn("page", F.floor(F.col("row") / per_page).cast("long")).drop("row").withColumn("depth", F.lit(DEEPEST))
    held = rest.groupBy(F.col("h").alias("_h"), F.col("page").alias("_page")).agg(F.sum("bytes").alias("shard_bytes"))
    rest = rest.join(held, (F.col("h") == F.col("_h")) & (F.col("page") == F.col("_page"))).drop("_h", "_page")
    bits = F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))
    return fits.unionByName(rest).select("id", "bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "page", "shard_bytes")


def op6_extendible_hashing(spark, sf_dir: str) -> DataFrame:
    return extendible_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(bytes AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM d
), k AS (
  SELECT *, unnest(range(0, 57)) AS depth FROM h
), s AS (
  SELECT r, doc_id, bytes, h, depth, CAST(sum(bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS BIGINT) AS shard_bytes FROM k
), m AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY depth) AS place FROM s WHERE shard_bytes <= 1048576
), f AS (
  SELECT r, doc_id, bytes, h, depth, CAST(0 AS BIGINT) AS page, shard_bytes FROM m WHERE place = 1
), o AS (
  SELECT r, doc_id, bytes, h, 56 AS depth, (row_number() OVER (PARTITION BY h ORDER BY doc_id) - 1) // greatest(1, 1048576 // bytes) AS page
  FROM h WHERE r NOT IN (SELECT r FROM f)
), p AS (
  SELECT * FROM f UNION ALL SELECT *, CAST(sum(bytes) OVER (PARTITION BY h, page) AS BIGINT) FROM o
)
SELECT doc_id, bytes, substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INT)) AS shard, CAST(depth AS INT) AS depth, page, shard_bytes FROM p
"""
