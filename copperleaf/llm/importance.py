"""Importance resampling towards a target text set, by postings of hashed n-grams dealt out by bucket.

A feature is a run of 1 to ``longest`` words; its CRC-32 names one of ``buckets``. A bucket's gain compares how often the target
and the documents hold its features; a document's weight is the sum of the gains of its features, and what is drawn are the highest
weights after Gumbel noise from a hash of the id.

The documents are read twice. First the features of both corpora are counted by bucket, summed in each task, so that at
most ``buckets`` rows leave it, and the counts of both meet by bucket in a join that gives the gains. Then the documents are
inverted: each task takes blocks of documents and makes, for each bucket, one row of postings, document numbers and counts in one or two
bytes each. The postings are shuffled by (bucket, salt) to where the bucket's gain is, multiplied there, and summed by block before they leave
the task; the sums of CHUNK documents at a time are shuffled once more and added up. A bucket's postings are split by salts, one for each
GROUP documents, so neither a bucket that all documents name nor a hot source makes a task that grows with the input. Tasks keep one
block, or the words of PIECE bytes of a text.

Both readings must give the same rows, as a table or files do; a lost executor's tasks are then made again alike.

Defined results: a null text has no features and weight 0; rows that repeat count as often as they are there, each with a row of its
own; texts of any length are taken whole; without target texts its counts are 0; an empty table gives an empty table; a null id draws its
noise by the empty string and comes after all ids in ties; other columns are never read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.operators.ranking import running

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 20
#: Documents and postings of a block; documents whose sums travel as one row; documents of a bucket's share.
BLOCK, CELLS, CHUNK, GROUP = 4096, 1 << 22, 128, 1 << 22
#: Marks the rows that name a block's documents.
NAMES = -1


# -- features


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of some PIECE bytes at a time."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        if found := WORD.findall(text, at, end):
            yield found
        at = end


def bucket_counts(text: bytes | None, buckets: int, longest: int) -> tuple[np.ndarray, int]:
    """How many of the text's features each bucket has, and the number of its words."""
    counts, n = np.zeros(buckets, np.int64), 0
    last: list[int | None] = [None] * longest  # of the runs that end at the word before
    for words in _words((text or b"").lower()):
        n += len(words)
        spaced = [b" " + w for w in words]
        runs = [list(map(zlib.crc32, words))]
        for k in range(longest - 1):
            before = ([] if last[k] is None else [last[k]]) + runs[k][:-1]
            runs.append(list(map(zlib.crc32, spaced[len(words) - len(before) :], before)))
        last = [r[-1] if r else None for r in runs]
        for r in runs:
            counts += np.bincount(np.array(r, np.uint32) % buckets, minlength=buckets)
    return counts, n


def bucket_totals(rows: DataFrame, text_col: str, buckets: int, longest: int, out: str) -> DataFrame:
    """(bucket, out): how many features of all texts each bucket has; a row for each bucket that has any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += bucket_counts(text.as_py(), buckets, longest)[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = rows.select(F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL").mapInArrow(task, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias(out))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(bucket, s, t, gain): a written table of at most ``buckets`` rows, those that the documents name."""
    ours = bucket_totals(docs, text_col, buckets, longest, "s")
    theirs = bucket_totals(target, target_col, buckets, longest, "t")
    both = materialise(ours.join(theirs, "bucket", "full").na.fill(0, ["s", "t"]), "bucket-totals")
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t + buckets)))
    return both.filter("s > 0").withColumn("gain", F.floor(1000 * F.log(ratio)))


# -- postings


def _packed(docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising document numbers, as gaps, and counts, each in as few bytes as the largest needs."""
    gaps = np.diff(docs, prepend=0)
    wide = [1 if x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 for x in (gaps, counts)]
    return bytes(wide) + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip((gaps, counts), wide, strict=True))


def _unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(row) - 2) // (row[0] + row[1])
    gaps = np.frombuffer(row, f"<u{row[0]}", n, 2)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(row, f"<u{row[1]}", n, 2 + n * row[0])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(bucket, block, postings, chunk, ids, n_words, n_features): for each block of documents a row for each bucket that they name,
    and under the bucket NAMES a row for each chunk of its documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    cells = ["bucket", "block", "postings", "chunk", "ids", "n_words", "n_features"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, lengths, named, counted = TaskContext.get().partitionId() << 33, [], [], [], []

        def made() -> Iterator[pa.RecordBatch]:
            names = pa.concat_arrays(ids)
            sums = np.array(lengths, np.int64).reshape(-1, 2)
            starts = range(0, len(names), CHUNK)
            lists = [pa.array([x[i : i + CHUNK] for i in starts], pa.list_(t)) for x, t in ((names.to_pylist(), names.type), (sums[:, 0], pa.int64()), (sums[:, 1], pa.int64()))]
            n = len(lists[0])
            yield pa.RecordBatch.from_arrays([pa.array([NAMES] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), *lists], names=cells)
            at = np.concatenate(named) if named else np.zeros(0, np.int64)
            order = np.argsort(at, kind="stable")
            docs_of = np.repeat(np.arange(len(named)), [len(x) for x in named])[order]
            at, counts = at[order], (np.concatenate(counted) if counted else at)[order]
            firsts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = [*firsts[1:], len(at)]
            for i in range(0, len(firsts), 2000):
                rows = [_packed(docs_of[a:b], counts[a:b]) for a, b in zip(firsts[i : i + 2000], ends[i : i + 2000], strict=True)]
                n = len(rows)
                empty = [pa.nulls(n, pa.int32()), *[pa.nulls(n, x.type) for x in lists]]
                yield pa.RecordBatch.from_arrays([pa.array(at[firsts[i : i + 2000]], pa.int32()), pa.array([block] * n, pa.int64()), pa.array(rows, pa.binary()), *empty], names=cells)

        size = 0
        for batch in batches:
            for i in range(len(batch)):
                counts, n = bucket_counts(batch.column(1)[i].as_py(), buckets, longest)
                at = np.flatnonzero(counts)
                ids.append(batch.column(0).slice(i, 1))
                lengths.append((n, counts.sum()))
                named.append(at.astype(np.uint16 if buckets <= 1 << 16 else np.int64))
                counted.append(counts[at].astype(np.uint32))
                size += len(at)
                if len(ids) >= BLOCK or size >= CELLS:
                    yield from made()
                    block, ids, lengths, named, counted, size = block + 1, [], [], [], [], 0
        if ids:
            yield from made()

    return slim.mapInArrow(task, f"bucket int, block long, postings binary, chunk int, ids array<{kind}>, n_words array<bigint>, n_features array<bigint>")


def _contributions(rows: DataFrame) -> DataFrame:
    """Sums of gain times count over the postings of a task, which come by block; rows with names pass through."""
    names = ["block", "chunk", "sums", "ids", "n_words", "n_features"]
    kinds = dict(rows.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now, top = np.zeros(BLOCK, np.int64), None, -1

        def made() -> pa.RecordBatch:
            chunks = sums[: -(-(top + 1) // CHUNK) * CHUNK].astype("<i8").reshape(-1, CHUNK)
            narrow = chunks.astype("<i4") if np.abs(chunks).max() < 1 << 31 else chunks
            n = len(chunks)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in narrow], pa.binary()), *[pa.nulls(n, t) for t in lists]], names=names)

        for batch in batches:
            lists = [batch.column(i).type for i in (4, 5, 6)]
            named = batch.filter(batch.column(2).is_null())
            if len(named):
                yield pa.RecordBatch.from_arrays([named.column(0), named.column(3), pa.nulls(len(named), pa.binary()), *[named.column(i) for i in (4, 5, 6)]], names=names)
            for block, gain, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not row.is_valid:
                    continue
                if block != now:
                    if top >= 0:
                        yield made()
                    sums[:], now, top = 0, block, -1
                docs, counts = _unpacked(row.as_py())
                sums[docs] += gain * counts.astype(np.int64)
                top = max(top, int(docs[-1]))
        if top >= 0:
            yield made()

    return rows.mapInArrow(task, f"block long, chunk int, sums binary, ids {kinds['ids']}, n_words array<bigint>, n_features array<bigint>")


def _reduced(rows: DataFrame) -> DataFrame:
    """(id, n_words, n_features, weight) from the rows of each chunk, which come one after the other."""
    kind = dict(rows.dtypes)["ids"].removeprefix("array<")[:-1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, held = None, np.zeros(CHUNK, np.int64), None

        def made() -> pa.RecordBatch:
            ids, words, features = (x.values for x in held)
            return pa.RecordBatch.from_arrays([ids, words, features, pa.array(total[: len(ids)], pa.int64())], names=["id", "n_words", "n_features", "weight"])

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        yield made()
                    now, held, total[:] = key, None, 0
                row = batch.column(2)[i]
                if row.is_valid:
                    data = row.as_py()
                    total += np.frombuffer(data, f"<i{len(data) // CHUNK}")
                else:
                    held = [batch.column(c)[i] for c in (3, 4, 5)]
        if now is not None:
            yield made()

    return rows.mapInArrow(task, f"id {kind}, n_words long, n_features long, weight long")


def importance_weights(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3
) -> DataFrame:
    """(id, n_words, n_features, weight): a row for each document."""
    gains = bucket_gains(docs, target, text_col, target_col, buckets, longest).select("bucket", "gain")
    salts = 1 + docs.select(F.lit(1)).count() // GROUP
    # the bucket of names has no gain of its own
    gains = gains.unionByName(docs.sparkSession.range(1).select(F.lit(NAMES).alias("bucket"), F.lit(0).cast("long").alias("gain")))
    gains = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = postings(docs, id_col, text_col, buckets, longest).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    met = dealt.join(gains.hint("shuffle_hash"), ["bucket", "salt"]).select("block", "gain", "postings", "chunk", "ids", "n_words", "n_features")
    parts = _contributions(met.sortWithinPartitions("block"))
    return _reduced(parts.repartition("block", "chunk").sortWithinPartitions("block", "chunk"))


# -- the draw


def gumbel(id_col: Column, seed: int) -> Column:
    """Noise of a document in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, seed: int = 42, percent: int = 5, min_words: int = 20) -> DataFrame:
    """``weighed`` with score, and rank where the row is among the highest ``percent`` of those with ``min_words`` words.

    Ranks come from rows dealt out by range, with the sizes of the ranges before; no window runs over all rows.
    """
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    may = scored.filter(F.col("n_words") >= min_words)
    most = percent * may.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = running(may.withColumn("one", F.lit(1).cast("long")), [], order, {"before": "one"})
    rank = F.when(F.col("before") < most, F.col("before") + 1)
    rest = scored.filter(~F.coalesce(F.col("n_words") >= min_words, F.lit(False)))
    return placed.select(*scored.columns, rank.alias("rank")).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(importance_weights(docs, target)).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: a table of 256 values by its rule, then one step for each byte.
OP13_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
), w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), f AS (
  SELECT side, r, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM w))
), x AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)
), b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INT), 2) AS BIGINT))),
    lambda c, y: xor(t[xor(c, y) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM x, crc
), n AS (
  SELECT side, r, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s
), q AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN g USING (bucket) WHERE side = 'd' GROUP BY r
), z AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN q USING (r) WHERE side = 'd'
), k AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) END AS place FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM z WHERE n_words >= 20) // 100 THEN place END AS rank FROM k
"""
