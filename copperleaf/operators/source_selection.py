"""Which ads a training example is made of: pairs that use each ad once, combinations that were not used before, and what is asked of a teacher.

A choice that runs over an order, each step closing what it takes, is made in rounds: whatever nothing earlier can still take is certain
at once, so a round decides many places of the order together. Nothing is gathered; a round is a few joins over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, materialise
from copperleaf.operators.corpus import bucket_of
from copperleaf.operators.ranking import running
from copperleaf.operators.selection import example_seed, id_set, without_used_sets

#: Open pairs that one task walks at the end: three ids each.
FOLDED = 200_000

# -- pairs


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    closed, keep = set(), []
    rows = rows.sort_values("place")
    for a, b in zip(rows["a"], rows["b"], strict=True):
        keep.append(a not in closed and b not in closed)
        if keep[-1]:
            closed |= {a, b}
    return rows[pd.Series(keep, index=rows.index, dtype=bool)]


def first_fit_pairs(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs: (place, a, b), places unique. The pairs that a walk in the order of places takes, if a pair is taken when none of its ends is yet.

    A pair that is the first of both its ends is certain; it closes its ends, and the next round goes on with the pairs that are left. Once those are
    FOLDED at most, one task walks them, since a chain of pairs in their order would need a round for every other one. With
    ``most`` the rounds end once that many places before every open pair are certain; more may come back.
    """
    left, taken = materialise(pairs.select("place", "a", "b"), "pairs"), None
    while (n := left.count()) > 0:
        if n <= FOLDED:
            walked = left.groupBy().applyInPandas(_walk, left.schema)
            return walked if taken is None else taken.unionByName(walked)
        ends = F.array_distinct(F.array("a", "b"))
        firsts = left.select("place", F.explode(ends).alias("end")).groupBy("end").agg(F.min("place").alias("_place"))
        sure = firsts.groupBy("_place").agg(F.count("*").alias("_n"))
        now = materialise(left.join(sure, (F.col("place") == F.col("_place")) & (F.col("_n") == F.size(ends))).select("place", "a", "b"), "taken-pairs")
        taken = now if taken is None else taken.unionByName(now)
        closed = broadcast_if_small(materialise(now.select(F.explode(ends).alias("_closed")), "closed"))
        left = left.join(closed, F.col("a") == F.col("_closed"), "left_anti").join(closed, F.col("b") == F.col("_closed"), "left_anti")
        left = materialise(left, "pairs")
        if most is not None:
            open_from = left.agg(F.min("place")).first()[0]
            if open_from is not None and taken.filter(F.col("place") < open_from).count() >= most:
                break
    return pairs.select("place", "a", "b").filter(F.lit(False)) if taken is None else taken


def pair_batches(pairs: DataFrame, ads: DataFrame, count: int, used_ads: DataFrame, used_sets: DataFrame, low_first: bool = False) -> DataFrame:
    """pairs: (place, high_ad_id, low_ad_id); used_ads: (ad_id); used_sets: (ids). (batch, strict, ad_ids): ``count`` pairs of known ads at most, in the
    order of places, each ad once and no set of ads that was used before. Pairs of ads that were never used come first; only if they are too
    few, a second walk over all pairs takes those whose ads the first left free.
    """
    known = broadcast_if_small(materialise(ads.select(F.col("ad_id").alias("_known")).distinct(), "known-ads"))
    edges = pairs.select("place", F.col("high_ad_id").alias("a"), F.col("low_ad_id").alias("b"))
    edges = edges.join(known, F.col("a") == F.col("_known"), "left_semi").join(known, F.col("b") == F.col("_known"), "left_semi")
    edges = without_used_sets(edges.withColumn("_ids", F.array("a", "b")), "_ids", used_sets, "ids").drop("_ids")
    edges = materialise(edges, "usable-pairs")
    used = broadcast_if_small(materialise(used_ads.select(F.col("ad_id").alias("_used")).distinct(), "used-ads"))
    fresh = edges.join(used, F.col("a") == F.col("_used"), "left_anti").join(used, F.col("b") == F.col("_used"), "left_anti")
    first = materialise(first_fit_pairs(fresh, count).orderBy("place").limit(count), "strict-pairs")
    rows, n = first.withColumn("strict", F.lit(True)), first.count()
    if n < count:
        closed = broadcast_if_small(materialise(first.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("_closed")), "closed"))
        rest = edges.join(closed, F.col("a") == F.col("_closed"), "left_anti").join(closed, F.col("b") == F.col("_closed"), "left_anti")
        rows = rows.unionByName(first_fit_pairs(rest, count - n).orderBy("place").limit(count - n).withColumn("strict", F.lit(False)))
    placed = running(rows.withColumn("late", ~F.col("strict")), [], [F.col("late"), F.col("place")], {"batch": F.lit(1).cast("long")})
    return placed.select("batch", "strict", (F.array("b", "a") if low_first else F.array("a", "b")).alias("ad_ids"))


# -- combinations


def _fresh(min_k: int, max_k: int):
    @F.pandas_udf("array<string>")
    def pick(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The first combination, of the larger sizes first and in the order of the ids, whose set is not taken. It skips no more
        than it is told, so it looks at one combination more than there are taken sets."""
        for pools, taken in parts:
            out = []
            for ids, sets in zip(pools, taken, strict=True):
                closed = {frozenset(s) for s in sets}
                every = (c for k in range(max_k, min_k - 1, -1) for c in combinations(list(ids), k))
                out.append(next((list(c) for c in every if frozenset(c) not in closed), None))
            yield pd.Series(out)

    return pick


def _taken_within(pools: DataFrame, used_sets: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """(place, taken): the used sets of a fitting size that lie within each pool, where there are any. A set is looked for only in the pools
    that have its rarest id."""
    members = pools.select("place", F.explode(F.array_distinct("ids")).alias("id"))
    often = members.groupBy("id").agg(F.count("*").alias("n")).withColumnRenamed("id", "_id")
    sets = used_sets.select(id_set(F.col("ids").cast("array<string>")).alias("set")).filter(F.size("set").between(min_k, max_k)).distinct()
    rarest = sets.select("set", F.explode("set").alias("id")).join(often, F.col("id") == F.col("_id"), "left").groupBy("set").agg(F.min_by("id", F.coalesce("n", F.lit(0))).alias("_rarest"))
    near = members.join(rarest, F.col("id") == F.col("_rarest")).select(F.col("place").alias("_place"), "set")
    inside = pools.join(near, F.col("place") == F.col("_place")).filter(F.size(F.array_except("set", "ids")) == 0)
    return inside.groupBy(F.col("place").alias("_place")).agg(F.collect_list("set").alias("taken"))


def fresh_combinations(pools: DataFrame, used_sets: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """pools: (place, ids), places unique and ids in their order; used_sets: (ids). (place, ad_ids): for each pool the first combination of ``max_k`` ids, then
    of fewer down to ``min_k``, whose set no one used and no earlier pool gets; null where all are gone.

    Each pool asks for its first; of those that ask for one set the earliest keeps it, and the others ask for their next. What is
    kept goes only to earlier pools, so this ends where a walk over the pools in their order ends.
    """
    asked = pools.select("place", F.col("ids").cast("array<string>").alias("ids"))
    taken = _taken_within(asked, used_sets, min_k, max_k)
    none = F.array().cast("array<array<string>>")
    rows = materialise(asked.join(taken, F.col("place") == F.col("_place"), "left").select("place", "ids", F.coalesce("taken", none).alias("taken")), "pools")
    pick, kept = _fresh(min_k, max_k), None
    while True:
        now = rows.withColumn("ad_ids", pick("ids", "taken"))
        kept = materialise(now if kept is None else kept.unionByName(now), "asked-sets")
        key = F.to_json(id_set(F.col("ad_ids")))
        first = kept.filter("ad_ids IS NOT NULL").groupBy(key.alias("_set")).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        told = kept.join(first, key == F.col("_set"), "left").withColumn("lost", F.coalesce(F.col("place") != F.col("_first"), F.lit(False)))
        rows = materialise(told.filter("lost").select("place", "ids", F.concat("taken", F.array(id_set(F.col("ad_ids")))).alias("taken")), "pools")
        if rows.isEmpty():
            return kept.select("place", "ad_ids")
        kept = told.filter("NOT lost").select("place", "ids", "taken", "ad_ids")


# -- bundles


def assigned_styles(rows: DataFrame, styles: list[str], unit: Column) -> DataFrame:
    """``rows`` with a style: the only one, or one of all by ``unit``, a number from 0 up to 1."""
    if not styles:
        raise ValueError("no style is valid")
    some = F.array(*map(F.lit, styles))
    return rows.withColumn("style", F.lit(styles[0]) if len(styles) == 1 else F.get(some, F.least(F.floor(unit * len(styles)), F.lit(len(styles) - 1)).cast("int")))


def bundle_text(task: Column, rules: Column, directive: Column, ad: Column, intro: str) -> Column:
    """What a teacher is given: the task, the rules of the style, what the format asks for, the ad, and the tags that the answer must have."""
    parts = [
        F.concat(F.lit("# Training-example generation — task: "), task), F.lit(""), F.lit(intro), F.lit(""), F.lit("## Style rules"), rules, F.lit(""), directive, F.when(directive.isNotNull(), F.lit("")),
        F.lit("## Source ad (the gold target — preserve its copy in the response)"), F.coalesce(F.nullif(ad, F.lit("")), F.lit("(none provided)")), F.lit(""), F.lit("## Output format"),
        F.lit("Return these tags in order. No text before, between, or after."), F.lit(""), F.lit("<user_prompt>[the brief]</user_prompt>"), F.lit(""), F.lit("<assistant_response>[the response]</assistant_response>"), F.lit(""),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def prepared_bundles(batches: DataFrame, seed: int, generated: int, reserved: int, registers: list[str], directives: dict[str, str], rules: dict[str, str], task: str, intro: str) -> DataFrame:
    """batches: (place, ad_ids, ad_id, ad_text, shape, style), ad_id the first ad. Adds the index of each prompt, the seed of its own draws, which goes on with the examples that
    were made and the requests that are pending, the register by the ad's id, and the prompt."""
    placed = running(batches, [], [F.col("place")], {"prompt_index": F.lit(1).cast("long")}).drop("prompt_index_total")
    register = F.get(F.array(*map(F.lit, registers)), bucket_of(F.col("ad_id"), len(registers)).cast("int"))
    named = placed.withColumns({"register": register, "seed": example_seed(seed, F.lit(generated + reserved).cast("long"), F.col("prompt_index"))})
    of = lambda table, c: reduce(lambda made, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(made), table.items(), F.lit(None).cast("string"))
    return named.withColumn("prompt", bundle_text(F.lit(task), of(rules, "style"), of(directives, "register"), F.col("ad_text"), intro))
