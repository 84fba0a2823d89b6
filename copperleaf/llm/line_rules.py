"""Quality rules from base counts and cross-document line frequency, in DataFrame functions only.

A line is normalised (ASCII lower case, words joined by one space) and known by two hashes, of 64 and of 32
bits. Per host the distinct documents that hold a line are counted. A document is an id; rows without an
id are documents by their text. A line is frequent in a host when more than ``min_docs`` of its documents hold
it: an absolute limit, so that the verdict on a passage does not depend on how large its host is. Frequent
lines are removed from every document but the first (smallest id) that holds them in that host, which
keeps each of its copies of the line; a document that loses more than ``max_removed`` of its words is depleted
and rejected. A line that stays is as it was.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; a null id never counts as the first holder of a line; rows that repeat an id, host and text
get the same verdict and text; texts of any length are taken whole, in one row each; an empty table gives an
empty table; other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, fresh, materialise
from copperleaf.llm.textcols import SPACE, ascii_lower, row_key, words

SYMBOLS = "#*$%&|<>"
#: Lines to remove, of all documents together, that are broadcast at most: two hashes each.
REMOVED_LINES = 1_000_000


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    The three-word windows of a text are sorted by hash inside its row, so equal windows stand
    side by side; that takes n log n time and memory in proportion to the text.
    """
    rest = [F.col(c) for c in df.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.select(
        *rest,
        words(F.col(text)).alias("_w"),
        F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
    )
    counts = ["word_chars", "n_symbols"]
    second = first.select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        *counts,
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 4, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    third = second.select(*rest, "n_words", *counts, "n_dup_lines", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_at", i - 1)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return third.select(*rest, "n_words", *counts, "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _line_ids(line_words: Column) -> list[Column]:
    line = F.array_join(line_words, " ")
    return [F.xxhash64(line).alias("line"), F.hash(line).alias("check")]


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _key, _host, _doc, _line): a row for each line with a word."""
    parts = F.filter(F.transform(F.split(ascii_lower(F.coalesce(F.col("_text"), F.lit(""))), "\n"), words), lambda w: F.size(w) > 0)
    return docs.select("_id", "_key", "_host", "_doc", F.explode(F.transform(parts, lambda w: F.struct(*_line_ids(w)))).alias("_line"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(_host, _line) above the limit, with the smallest id that holds the line there.

    A document's copies of a line are merged before documents are counted, and both counts are summed on
    the map side, so that neither a hot host nor a hot line gathers its rows in one task.
    """
    per_doc = lines.groupBy("_host", "_line", "_doc").agg(F.min("_id").alias("_first"))
    counted = per_doc.groupBy("_host", "_line").agg(F.count("*").alias("_docs"), F.min("_first").alias("_first"))
    return counted.filter(F.col("_docs") > min_docs)


def lines_to_remove(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int) -> DataFrame:
    """(_id, _key, _gone): for each document that holds any, the ids of the lines to remove; a written table.

    The frequent lines are written to a table first; the planner broadcasts them only if that table is small,
    and else joins by (host, line) with Spark's split of skewed partitions. A set is never more than its own document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), document_key(id_col, text_col, host_col).alias("_key"), F.col(host_col).alias("_host"),
        F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(1), id_col)).otherwise(F.xxhash64(F.lit(0), text)).alias("_doc"), text.alias("_text"),
    )
    lines = _lines(slim)
    often = materialise(frequent_lines(lines, min_docs), "frequent-lines").withColumnsRenamed({"_host": "_h", "_line": "_l"})
    hit = lines.join(often, (F.col("_line") == F.col("_l")) & F.col("_host").eqNullSafe(F.col("_h"))).filter(~F.coalesce(F.col("_id") == F.col("_first"), F.lit(False)))
    return materialise(hit.groupBy("_id", "_key").agg(F.collect_set("_line").alias("_gone")), "removed-lines")


def clean_texts(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", counted: str | None = None) -> DataFrame:
    """``docs`` with the lines in ``gone`` taken out of the text; its columns and rows are the same.

    counted: a column to add, of the words in what was taken out. Only hashes of lines are joined, by document;
    documents without any keep their text untouched.
    """
    ident, key, lost = fresh(docs, "_id", "_key", "_gone")
    gone = gone.withColumnsRenamed({"_id": ident, "_key": key, "_gone": lost})
    if (gone.agg(F.sum(F.size(lost))).first()[0] or 0) <= REMOVED_LINES:
        gone = F.broadcast(gone)
    same = (document_key(id_col, text_col, host_col) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(ident))
    is_gone = lambda w: F.array_contains(lost, F.struct(*_line_ids(w)))
    lines = F.split(F.col(text_col), "\n")
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x: ~is_gone(words(ascii_lower(x)))), "\n"))
    taken = F.transform(lines, lambda x: F.when(is_gone(words(ascii_lower(x))), F.size(words(x))).otherwise(0))
    total = F.when(F.col(lost).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(taken, F.lit(0).cast("long"), lambda a, b: a + b))
    return docs.join(gone, same, "left").select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *([total.alias(counted)] if counted else []))


def document_key(id_col: str, text_col: str, host_col: str) -> Column:
    return row_key(F.col(id_col), F.col(host_col), F.col(text_col))


def line_frequency_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_removed: float = 0.5
) -> DataFrame:
    """(id, key, counts, removed_words, clean_sha256, base_failed, kept): one row per row of ``docs``.

    clean_sha256 is that of the text without its frequent lines.
    """
    return _judged(docs, id_col, text_col, host_col, min_docs, max_removed)[0]


def _judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_removed: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``line_frequency_rules``, and the lines to remove.

    The counts are written to a table before anything is decided by them: a filter on them would
    else be moved below and make Spark compute the arrays anew for each element.
    """
    key, whole = document_key(id_col, text_col, host_col), F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.sha2(whole, 256).alias("_sha"), F.col(text_col).alias("_text"))
    counts = materialise(base_counts(slim, "_text"), "base-counts")
    gone = lines_to_remove(docs, id_col, text_col, host_col, min_docs)
    held = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), key.alias("_k"))
    hit = gone.select("_id", "_key")
    held = held.join(broadcast_if_small(hit), (F.col("_k") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    cleaned = clean_texts(held, gone, "id", "text", "host", counted="_removed").groupBy(F.col("id").alias("_id"), F.col("_k").alias("_key"))
    cleaned = materialise(cleaned.agg(F.max("_removed").alias("_removed"), F.max(F.sha2("text", 256)).alias("_clean")), "cleaned")
    joined = counts.join(broadcast_if_small(cleaned), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    judged = joined.withColumns({"removed_words": F.coalesce("_removed", F.lit(0).cast("long")), "clean_sha256": F.coalesce("_clean", "_sha"), "base_failed": base_failed()})
    kept = ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words"))
    rows = judged.select(
        "id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "clean_sha256", "base_failed", kept.alias("kept")
    )
    return rows, gone


def op4_line_frequency(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_frequency_rules(docs).withColumnRenamed("id", "doc_id").drop("key")


def keep_good_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with the columns they came with and without their frequent lines.

    What is rejected is known by two numbers a row, so the texts are shuffled only where those are many.
    """
    judged, gone = _judged(docs)
    ident, key = fresh(docs, "_rejected_id", "_rejected_key")
    judged = judged.filter(~F.col("kept")).select(F.col("id").alias(ident), F.col("key").alias(key)).distinct()
    judged = broadcast_if_small(materialise(judged, "rejected"))
    same = (document_key("doc_id", "text", "source") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(ident))
    return clean_texts(docs.join(judged, same, "left_anti"), gone)


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT r, doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols
  FROM d
), l AS (
  SELECT r, doc_id, host, text, i, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), dup AS (
  SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM l WHERE len(w) > 0 GROUP BY r
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), n AS (
  SELECT r, doc_id, host, text, i, array_to_string(w, ' ') AS line, len(w) AS k FROM l WHERE len(w) > 0
), f AS (
  SELECT host, line, count(DISTINCT CASE WHEN doc_id IS NULL THEN 't' || text ELSE 'i' || CAST(doc_id AS VARCHAR) END) AS docs, min(doc_id) AS first_id FROM n GROUP BY host, line
), often AS (
  SELECT host, line, first_id FROM f WHERE docs > 20
), hit AS (
  SELECT n.r, n.i, n.k FROM n JOIN often o ON n.line = o.line AND n.host IS NOT DISTINCT FROM o.host WHERE NOT coalesce(n.doc_id = o.first_id, false)
), gone AS (
  SELECT r, CAST(sum(k) AS BIGINT) AS removed_words FROM hit GROUP BY r
), clean AS (
  SELECT l.r, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (hit.i IS NULL), '') AS text FROM l JOIN gone ON l.r = gone.r LEFT JOIN hit ON l.r = hit.r AND l.i = hit.i GROUP BY l.r
), j AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words,
         sha256(coalesce(clean.text, b.text)) AS clean_sha256
  FROM b LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r) LEFT JOIN clean ON clean.r = b.r
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5::DOUBLE * n_words AS kept
FROM j
"""
