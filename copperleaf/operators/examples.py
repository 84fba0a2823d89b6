"""Training examples: repair and the ordered filter cascade, with the reasons and their counts.

An example is a row: example_id, style, messages (role, text, in order), source_ids. Stages up to the guards are columns of one
pass; the stages that compare examples see only what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.functions import text as T
from copperleaf.operators.near_duplicates import near_duplicates
from copperleaf.operators.selection import source_set_dedup

# The styles that have limits of their own, and the shortest response of each.
BACKTRANSLATION, DISTILLED = "backtranslation", "context_distilled"
FLOORS, FLOOR, LANGUAGE_FLOOR = {BACKTRANSLATION: 80}, 200, 50
STAGES = ["artifact_leak", "structural", "min_length", "language", "rubric", "format_specific", "style_b_specificity", "duplicate", "prompt_duplicate", "source_ad_duplicate"]
#: Cosines above which a later response, and a later prompt, is a duplicate.
RESPONSE_LIKE, PROMPT_LIKE = 0.80, 0.85


def first_said(role: str, messages: Column | str = "messages") -> Column:
    """The first message of a role; empty without."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["text"], F.lit(""))


def repaired(examples: DataFrame) -> DataFrame:
    """``examples`` with cleaned messages, whether that changed any, and the first tag that is left, as role:tag."""
    clean = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["text"] == "", "").otherwise(T.repaired(m["text"])).alias("text")))
    left = lambda m: F.concat(m["role"], F.lit(":"), T.tag_residue(m["text"]))
    made = examples.withColumn("_clean", clean)
    changed = F.exists(F.zip_with("messages", "_clean", lambda a, b: ~a["text"].eqNullSafe(b["text"])), lambda x: x)
    return made.withColumns({"repaired": changed, "residue": F.get(F.array_compact(F.transform("_clean", left)), F.lit(0)), "messages": F.col("_clean")}).drop("_clean")


def is_chat(messages: Column | str = "messages") -> Column:
    roles = F.transform(messages, lambda m: m["role"])
    user, reply = F.array_position(roles, "user"), F.array_position(roles, "assistant")
    return (user > 0) & (reply > user)


def format_reasons(style: Column, response: Column) -> Column:
    """Every reason of the format's own checks, not only the first."""
    leak, hedge = T.schema_leak(response), T.hedge(response)
    some = F.array_compact(F.array(F.when(leak != "", F.concat(F.lit("schema_leak:"), leak)), F.when(hedge != "", F.concat(F.lit("ad_centrality:"), hedge))))
    return F.when(style == BACKTRANSLATION, some).otherwise(F.array().cast("array<string>"))


def _twice(left: DataFrame, response_like: float, prompt_like: float) -> DataFrame:
    """(_id, _twice): the examples whose response, and of the others those whose prompt, is like that of an earlier kept one."""
    said = materialise(left.select("example_id", first_said("assistant").alias("response"), first_said("user").alias("prompt")), "cascade-texts")
    responses = materialise(near_duplicates(said, "example_id", "response", response_like).select(F.col("example_id").alias("_id"), F.lit("duplicate").alias("_twice")), "like-responses")
    others = said.join(responses, F.col("example_id") == F.col("_id"), "left_anti")
    prompts = near_duplicates(others, "example_id", "prompt", prompt_like).select(F.col("example_id").alias("_id"), F.lit("prompt_duplicate").alias("_twice"))
    return materialise(responses.unionByName(prompts), "like-examples")


def judged(examples: DataFrame, language: Column | None = None, rubric: Column | None = None, response_like: float = RESPONSE_LIKE, prompt_like: float = PROMPT_LIKE) -> DataFrame:
    """``examples``, repaired, with the stage that rejects it (null: kept) and its reasons. Ids are unique; their order is that of the examples.

    language: of the response, told by frequent words unless given; rubric: an array of missing sections, none unless given.
    """
    rows = repaired(examples)
    response = first_said("assistant")
    from copperleaf.functions.copy import language as told

    lang = told(response) if language is None else language
    missing = F.array().cast("array<string>") if rubric is None else rubric
    floor = F.lit(FLOOR)
    for style, least in FLOORS.items():
        floor = F.when(F.col("style") == style, least).otherwise(floor)
    own = format_reasons(F.col("style"), response)
    guard = F.when(F.col("style") == DISTILLED, T.specifics(response)).otherwise(F.array().cast("array<string>"))
    one = lambda x: F.array(x)
    checks = [
        (F.col("residue").isNotNull(), one(F.concat(F.lit("artifact_leak:"), F.col("residue")))), (~is_chat(), one(F.lit("structural"))), (F.length(response) < floor, one(F.lit("min_length"))),
        ((F.length(response) >= LANGUAGE_FLOOR) & (lang != "en"), one(F.lit("language"))), (F.size(missing) > 0, one(F.concat(F.lit("rubric:missing="), F.array_join(missing, ",")))),
        (F.size(own) > 0, own), (F.size(guard) > 0, one(F.concat(F.lit("style_b_specificity:"), F.array_join(guard, ",")))),
    ]
    stage, reasons = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (fails, why) in reversed(list(zip(STAGES, checks, strict=False))):
        stage, reasons = F.when(fails, name).otherwise(stage), F.when(fails, why).otherwise(reasons)
    rows = materialise(rows.withColumns({"stage": stage, "reasons": reasons}), "judged-examples")  # read four times below, repaired once
    left = rows.filter("stage IS NULL")
    left = left.join(_twice(left, response_like, prompt_like), F.col("example_id") == F.col("_id"), "left").drop("_id")
    alike = left.filter("_twice IS NOT NULL").withColumns({"stage": F.col("_twice"), "reasons": F.array("_twice")}).drop("_twice")
    left = source_set_dedup(left.filter("_twice IS NULL").drop("_twice"), "source_ids", "example_id")
    twice = F.col("first").isNotNull()
    left = left.withColumns({"stage": F.when(twice, STAGES[-1]), "reasons": F.when(twice, F.array(F.concat(F.lit("source_ad_duplicate:first="), F.col("first").cast("string")))).otherwise(F.array().cast("array<string>"))})
    return rows.filter("stage IS NOT NULL").unionByName(alike).unionByName(left.drop("first"))


def stage_counts(rows: DataFrame) -> DataFrame:
    """(stage, n): rejections of each stage, where an example with several reasons of its format counts for each; and how many passed."""
    n = F.when(F.col("stage") == "format_specific", F.size("reasons")).otherwise(1)
    return rows.groupBy(F.coalesce("stage", F.lit("passed")).alias("stage")).agg(F.sum(n).cast("long").alias("n"))


def ingested(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of answers to bundles (example_id, output, headline, body, description, in which a null headline is an unknown ad): examples, and the ledger of rejects
    with a reason. The first check that fails gives the reason."""
    from copperleaf.functions.copy import tagged

    prompt, answer = tagged(F.col("output"), "user_prompt"), tagged(F.col("output"), "assistant_response")
    share = T.coverage(T.content_words(F.concat_ws(" ", "headline", "body", "description")), T.content_words(F.col("answer")))
    reason = (
        F.when((F.col("prompt") == "") | (F.col("answer") == ""), "parse").when(F.col("headline").isNull(), "unknown_ad").when(share < 0.6, "word_coverage")
        .when(~T.quotes_one_of(F.col("answer"), F.col("headline"), F.col("body"), F.col("description")), "verbatim_signature")
    )
    made = rows.withColumns({"prompt": prompt, "answer": answer}).withColumn("reason", reason)
    return made.filter("reason IS NULL").select("example_id", "prompt", "answer"), made.filter("reason IS NOT NULL").select("example_id", "reason")
