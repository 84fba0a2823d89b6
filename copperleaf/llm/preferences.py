"""Preference formatting: a shared prompt, and two completions with masks.

A pair is two conversations, chosen and rejected. Turns are compared by their numbers: the first number at which
role or text differ, or that one side lacks, ends the common prefix. The prefix is rendered once as the prompt; the turns from
there on are each side's completion, with the spans (code points, from the start of the completion) that a
loss may look at: the assistant's text and its end mark. The comparison is an aggregation over single turns; only rendering
brings the turns of one pair together, as one row of text, which is what it returns.

Defined results: a null text is empty, a null role is ``user``; rows without pair or turn cannot be placed and
are left out; of rows that repeat a pair, side and turn the smallest by role and text stands; a side without turns has an
empty completion; equal sides have the whole conversation as prompt and ``same`` is true; turns and conversations of any length
are rendered whole; an empty table gives an empty table; other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The marks of the public ChatML convention.
START, END = "<|im_start|>", "<|im_end|>\n"


def _head() -> Column:
    return F.concat(F.lit(START), F.col("role"), F.lit("\n"))


def preference_turns(turns: DataFrame) -> DataFrame:
    """turns: (pair, side, turn, role, text), side chosen or rejected. (pair, part, turn, role, text): each turn of the
    common prefix once, part prompt, and the others with their side as part."""
    known = turns.select("pair", "side", "turn", "role", "text").filter("pair IS NOT NULL AND turn IS NOT NULL AND side IS NOT NULL")
    said = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = known.groupBy("pair", "turn").agg(*[F.min(F.when(F.col("side") == s, said)).alias(s) for s in ("chosen", "rejected")])
    differ = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = one.filter(differ).groupBy("pair").agg(F.min("turn").alias("_end")).withColumnRenamed("pair", "_pair")
    all_turns = one.join(ends, F.col("pair") == F.col("_pair"), "left").withColumn("_common", F.col("_end").isNull() | (F.col("turn") < F.col("_end")))
    rows = F.array(
        F.when(F.col("_common"), F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said"))),
        F.when(~F.col("_common") & F.col("chosen").isNotNull(), F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said"))),
        F.when(~F.col("_common") & F.col("rejected").isNotNull(), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))),
    )
    return all_turns.select("pair", "turn", F.explode(F.array_compact(rows)).alias("r")).select("pair", "r.part", "turn", "r.said.role", "r.said.text")


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair, prompt, chosen, rejected, chosen_spans, rejected_spans, n_prompt_turns, same): a row for each pair."""
    parts = preference_turns(turns).withColumn("_said", F.concat(_head(), "text", F.lit(END)))
    before = F.coalesce(F.sum(F.length("_said")).over(W.partitionBy("pair", "part").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == "assistant", F.struct((before + F.length(_head())).alias("start"), (before + F.length("_said")).alias("end")))
    rows = parts.withColumn("_span", span)

    def ordered(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "_said", "_span"))))

    found = rows.groupBy("pair").agg(*[ordered(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["_said"]), "")
    spans = lambda p: F.array_compact(F.transform(p, lambda x: x["_span"]))
    return found.select(
        "pair", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"),
        F.size("prompt").cast("long").alias("n_prompt_turns"), ((F.size("chosen") == 0) & (F.size("rejected") == 0)).alias("same"),
    )


def cut_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is a conversation up to its last reply, rejected the same with
    that reply cut after its first line. Conversations without a reply give no pair."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    last = conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("_last")).withColumnRenamed("conv_id", "_conv")
    known = conversations.join(last, F.col("conv_id") == F.col("_conv")).filter("turn <= _last")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(F.col("turn") == F.col("_last"), F.substring_index(text, "\n", 1)).otherwise(text)
    sides = F.array(F.struct(F.lit("chosen").alias("side"), text.alias("text")), F.struct(F.lit("rejected").alias("side"), cut.alias("text")))
    return known.select(F.col("conv_id").alias("pair"), "turn", "role", F.explode(sides).alias("s")).select("pair", "s.side", "turn", "role", "s.text")


def op10_preferences(spark, sf_dir: str) -> DataFrame:
    made = format_preferences(cut_reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ";")
    return made.select(F.col("pair").alias("conv_id"), "prompt", "chosen", "rejected", shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans"), "n_prompt_turns", "same")


OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS said
  FROM conversations JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)
  WHERE turn <= last GROUP BY conv_id, turn
), l AS (
  SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last, said.role AS role, said.text AS text, split_part(said.text, chr(10), 1) AS cut FROM t
), r AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM l
)
SELECT conv_id,
  coalesce(string_agg(CASE WHEN NOT is_last OR cut = text THEN head || text || tail END, '' ORDER BY turn), '') AS prompt,
  coalesce(max(CASE WHEN is_last AND cut <> text THEN head || text || tail END), '') AS chosen,
  coalesce(max(CASE WHEN is_last AND cut <> text THEN head || cut || tail END), '') AS rejected,
  coalesce(max(CASE WHEN is_last AND cut <> text THEN CAST(length(head) AS VARCHAR) || '-' || CAST(length(head || text || tail) AS VARCHAR) END), '') AS chosen_spans,
  coalesce(max(CASE WHEN is_last AND cut <> text THEN CAST(length(head) AS VARCHAR) || '-' || CAST(length(head || cut || tail) AS VARCHAR) END), '') AS rejected_spans,
  CAST(count_if(NOT is_last OR cut = text) AS BIGINT) AS n_prompt_turns,
  bool_and(NOT is_last OR cut = text) AS same
FROM r GROUP BY conv_id
"""
