"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order (null last) weigh ``weights``, repeating. They share ``share`` times all
words; a target stops at ``most`` times its source's words, and what is above is shared again by
weight. The house of blocks of about ``block_words`` words is apportioned to the sources by the
highest quotients target / (2k - 1). A source is dealt to shards of about ``shard_words`` words by
a hash of its documents, so a source of any size is spread over tasks; its blocks are apportioned
to its shards in the same way, by their words. In a shard the documents stand in seeded order, cut
into equal blocks; a quota takes whole passes over the shard and then a run of blocks from a seeded
start. What a document gives is its overlap with them. A source has at most ``MOST_SHARDS`` shards, which then
grow with it, so that the window over a source's shards is bounded.

Defined results: a null or empty text has size 0 and gives nothing; null sources are one source;
rows that repeat an id are documents of their own; equal quotients go to the earlier source or
shard; a text of any length counts whole; an empty table gives an empty table; other columns are never read,
whatever their names. The sums of sources and shards pass through windows of
one row for each source or shard, never of one for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import fresh, materialise
from copperleaf.llm.simhash import one_of
from copperleaf.llm.textcols import count_words, row_key

MOST_SHARDS = 1 << 16


def _hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts as text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size). Adds src, the source's rank from 0, and its target in words."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("src", (F.row_number().over(order) - 1).cast("int")).withColumn("_w", turn)
    everything = W.partitionBy()
    fill = W.orderBy(F.col("source_size") / F.col("_w"), "src").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("source_size").over(fill), F.lit(0))
    left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - most * before) / left
    filled = ranked.withColumn("_level", level).withColumn("_full", most * F.col("source_size") <= F.col("_w") * F.col("_level"))
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return filled.withColumn("_common", common).select(
        "source", "source_size", "src", F.when(F.col("_full"), most * F.col("source_size")).otherwise(F.col("_w") * F.col("_common")).alias("target")
    )


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, house: str) -> DataFrame:
    """``parties`` with their ``seats``: of each group's house, by the highest quotients.

    Seats that no party can miss are given at once; only the quotients around each party's
    proportional share, about five for each party, are ranked. ``key`` breaks ties.
    """
    all_of = W.partitionBy(*group)
    part = F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(0.0)
    margin = F.ceil(part * 2 * F.col("_n")) + 2
    known = parties.withColumn("_total", F.sum(F.col(votes).cast("double")).over(all_of)).withColumn("_n", F.count("*").over(all_of))
    known = known.withColumn("_margin", margin.cast("long"))
    known = known.withColumn("_sure", F.greatest(F.lit(0), F.floor(part * F.col(house) + 0.5) - F.col("_margin")).cast("long"))
    known = known.withColumn("_open", F.col(house) - F.sum("_sure").over(all_of))
    seats = known.select(*group, key, F.col(votes).cast("double").alias("_v"), "_open", F.explode(F.expr("sequence(_sure + 1, _sure + 2 * _margin + 1)")).alias("_k"))
    ranked = seats.withColumn("_rank", F.row_number().over(all_of.orderBy((F.col("_v") / (2 * F.col("_k") - 1)).desc(), key, "_k")))
    won = ranked.filter((F.col("_rank") <= F.col("_open")) & (F.col("_v") > 0)).groupBy(*group, key).agg(F.count("*").alias("_won"))
    return known.join(won, [*group, key], "left").withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_n", "_margin", "_sure", "_open", "_won")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5, most: int = 2, block_words: int = 32, shard_words: int = 1 << 20, seed: int = 7,
) -> DataFrame:
    """(id, key, size, source_size, target, taken): a row for each row of ``docs``."""
    slim = docs.select(
        F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size")
    )
    slim = materialise(slim.withColumn("_h", _hash60(F.lit(seed), F.col("id"), F.col("size"))), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    house = F.floor(F.sum("target").over(W.partitionBy()) / block_words + 0.5).cast("long")
    sources = sainte_lague(source_targets(sizes, weights, share, most).withColumn("_house", house), [], "src", "target", "_house")
    shards = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long")
    sources = materialise(sources.select("source", "source_size", "src", "target", "seats", shards.alias("_shards")), "sources")
    named = sources.withColumnRenamed("source", "_source")
    dealt = slim.join(named, slim["source"].eqNullSafe(named["_source"])).withColumn("shard", F.col("_h") % F.col("_shards"))
    plan = dealt.groupBy("src", "shard").agg(F.sum("size").alias("_words"), F.first("seats").alias("_house"))
    plan = sainte_lague(plan, ["src"], "shard", "_words", "_house").select("src", "shard", "_words", "seats")
    blocks = F.greatest(F.lit(1), F.floor(F.col("_words") / block_words + 0.5)).cast("long")
    plan = plan.withColumn("_blocks", blocks).withColumn("_quota", F.least("seats", most * F.col("_blocks")))
    plan = plan.withColumn("_from", _hash60(F.lit(seed), F.lit("run"), F.col("src"), F.col("shard")) % F.col("_blocks"))
    plan = plan.selectExpr("src AS _src", "shard AS _shard", "_words", "_blocks", "_quota div _blocks AS _passes", "_quota % _blocks AS _run", "_from")
    plan = plan.selectExpr(
        "_src", "_shard", "_passes",
        "(_from * _words) div _blocks AS _x0",
        "(least(_from + _run, _blocks) * _words) div _blocks AS _x1",
        "(greatest(_from + _run - _blocks, 0) * _words) div _blocks AS _x2",
    )
    placed = dealt.withColumn("_end", F.sum("size").over(W.partitionBy("src", "shard").orderBy("_h", "id", "size").rowsBetween(W.unboundedPreceding, 0)))
    joined = placed.join(plan, (F.col("src") == F.col("_src")) & (F.col("shard") == F.col("_shard")))
    taken = F.expr("_passes * size + greatest(least(_end, _x1) - greatest(_end - size, _x0), 0) + greatest(least(_end, _x2) - (_end - size), 0)")
    return joined.select("id", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def repeat_by_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, to the nearest whole copy.

    Rows that repeat a document are taken together; a document without words is not taken.
    """
    key, copies, ident, there, rows = fresh(docs, "_mix_key", "_mix_copies", "_mix_id", "_mix_k", "_mix_rows")
    mixed = mix(docs).filter("size > 0").withColumn("_n", F.floor(F.col("taken") / F.col("size") + 0.5))
    plan = mixed.groupBy("id", "key").agg(F.sum("_n").cast("int").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0)
    plan = materialise(plan.select(F.col("id").alias(ident), F.col("key").alias(there), copies, rows), "mix")
    keyed = docs.withColumn(key, row_key(*[F.col(c) for c in ("doc_id", "source", "text")]))
    same = (F.col(key) == F.col(there)) & F.col("doc_id").eqNullSafe(F.col(ident))
    once = keyed.join(plan.filter(F.col(rows) == 1), same).select(*docs.columns, copies)
    several = one_of(keyed.join(plan.filter(F.col(rows) > 1), same), [ident, there], [*docs.columns, copies])
    return once.unionByName(several).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(copies)


_SEATS = """
  SELECT {keys}, count(*) AS seats FROM (
    SELECT {keys}, house, row_number() OVER ({part} ORDER BY v / (2 * k - 1) DESC, {tie}, k) AS place
    FROM (SELECT *, unnest(range(1, house + 1)) AS k FROM {table})
  ) WHERE place <= house GROUP BY {keys}"""


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents
), h AS (
  SELECT *, {_hash_sql("'7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)")} AS h FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), w AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s
), lv AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, src,
    CASE WHEN 2.0::DOUBLE * source_size <= w * level THEN 2.0::DOUBLE * source_size
         ELSE w * max(CASE WHEN 2.0::DOUBLE * source_size <= w * level THEN NULL ELSE level END) OVER () END AS target
  FROM lv
), a AS (
  SELECT src, target AS v, CAST(floor(sum(target) OVER () / 32 + 0.5) AS BIGINT) AS house FROM t
), seat AS ({_SEATS.format(keys="src", part="", tie="src", table="a")}
), p AS (
  SELECT h.*, t.src, t.source_size, t.target, coalesce(seat.seats, 0) AS seats, h.h % CAST(least({MOST_SHARDS}, greatest(1, ceil(t.source_size / 1048576))) AS BIGINT) AS shard
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source LEFT JOIN seat ON seat.src = t.src
), b AS (
  SELECT src, shard, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size) AS DOUBLE) AS v, max(seats) AS house FROM p GROUP BY src, shard
), bs AS ({_SEATS.format(keys="src, shard", part="PARTITION BY src", tie="shard", table="(SELECT * FROM b WHERE v > 0)")}
), q AS (
  SELECT b.src, b.shard, words, blocks, least(coalesce(bs.seats, 0), 2 * blocks) AS quota,
         {_hash_sql("'7:run:' || CAST(b.src AS VARCHAR) || ':' || CAST(b.shard AS VARCHAR)")} % blocks AS sb
  FROM (SELECT *, CAST(greatest(1, floor(words / 32 + 0.5)) AS BIGINT) AS blocks FROM b) b LEFT JOIN bs ON bs.src = b.src AND bs.shard = b.shard
), e AS (
  SELECT p.*, sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM p
)
SELECT doc_id, size, source_size, target, CAST((quota // blocks) * size
  + greatest(least(stop, (least(sb + quota % blocks, blocks) * words) // blocks) - greatest(stop - size, (sb * words) // blocks), 0)
  + greatest(least(stop, (greatest(sb + quota % blocks - blocks, 0) * words) // blocks) - (stop - size), 0) AS BIGINT) AS taken
FROM e JOIN q ON e.src = q.src AND e.shard = q.shard
"""
