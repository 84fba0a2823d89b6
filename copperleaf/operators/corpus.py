"""Corpus operators: exact deduplication, contamination, splits, chat checks, budgets, ledgers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, fresh, join_counted, materialise
from copperleaf.functions.text import stripped
from copperleaf.operators.ranking import running


def _row_marks(df: DataFrame) -> list[Column]:
    """96 bits of a row's columns; maps, which have no hash, as JSON."""
    cells = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in df.dtypes]
    cells = [x for c in cells for x in (c.isNull(), c)]
    return [F.xxhash64(*cells), F.hash(*cells)]


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row of each key, the smallest by ``order`` and then by a hash of its columns; rows without a key are of one.

    All is decided on a written table of key digest, order and hash. The rows themselves stay where they are: those to leave out are known by order
    and hash, and only rows that are there twice in all columns are shuffled.
    """
    digest = F.when(key.isNotNull(), F.sha2(key.cast("string"), 256)).otherwise("")
    place = F.struct(F.col(order).alias("order"), *[c.alias(f"mark{i}") for i, c in enumerate(_row_marks(df))])
    slim = materialise(df.select(digest.alias("key"), place.alias("place")), "keys")
    groups = slim.groupBy(F.col("key").alias("_key")).agg(F.min("place").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    met = join_counted(slim, "key", materialise(groups, "repeated-keys"), "_key", "_rows")
    later = met.filter(F.col("place") != F.col("_first")).select("place").distinct().withColumn("twice", F.lit(False))
    same = met.filter(F.col("place") == F.col("_first")).groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place", F.lit(True).alias("twice"))
    (at,) = fresh(df, "_place")
    known = broadcast_if_small(materialise(later.unionByName(same), "repeated-rows").withColumnRenamed("place", at))
    here = place.eqNullSafe(F.col(at))
    copies = df.join(known.filter("twice"), here, "left_semi")
    (one,) = fresh(df, "_one")
    once = copies.withColumn(one, place).dropDuplicates([one]).drop(one)
    return df.join(known, here, "left_anti").unionByName(once)


def held_out(df: DataFrame, key: Column, held: DataFrame, held_key: Column) -> DataFrame:
    """Rows whose key is not among the held-out ones."""
    return df.withColumn("_key", key).join(held.select(held_key.alias("_held")).distinct(), F.col("_key") == F.col("_held"), "left_anti").drop("_key")


def chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: its messages in order. A conversation is one record by nature."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def chat_checks(chat: DataFrame, floor: int = 200, reply_floor: int = 50) -> DataFrame:
    """has_reply: the first reply comes after the first question; valid: both are there, and no reply is short; long_enough:
    by the first reply's length."""
    roles = F.transform("messages", lambda m: m["role"])
    user, reply = F.array_position(roles, "user"), F.array_position(roles, "assistant")
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    first = F.get(said, F.lit(0))["text"]
    valid = F.forall(said, lambda m: F.length(stripped(m["text"])) >= reply_floor)
    there = F.size("messages") > 0
    ok = there & (user > 0) & (reply > user)
    valid = there & (user > 0) & (reply > 0) & valid
    return chat.select("conv_id", F.size("messages").cast("long").alias("n_messages"), ok.alias("has_reply"), valid.alias("valid"), (F.coalesce(F.length(first), F.lit(0)) >= floor).alias("long_enough"))


def stratified_split(df: DataFrame, stratum: str, order: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """train, val or test by place in the stratum; a stratum too small for a train part is all train."""
    placed = running(df, [stratum], [F.col(order)], {"_before": F.lit(1)})
    n, place = F.col("_before_total"), F.col("_before") + 1
    n_val, n_test = (F.greatest(F.lit(1), F.bround(n * r).cast("long")) for r in (val, test))
    train = n - n_val - n_test
    part = F.when((train < 1) | (place <= train), "train").when(place <= train + n_val, "val").otherwise("test")
    return placed.withColumn("split", part).drop("_before", "_before_total")


def bucket_of(key: Column, n: int = 3) -> Column:
    """First byte of the key's SHA-256, modulo n."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % n


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with the patch's values where it has some."""
    other = patch.withColumnRenamed(key, "_patch")
    values = [c for c in patch.columns if c != key]
    joined = base.alias("b").join(other.alias("p"), F.col(f"b.{key}") == F.col("p._patch"), "left")
    return joined.select(*[F.coalesce(F.col(f"p.{c}"), F.col(f"b.{c}")).alias(c) if c in values else F.col(f"b.{c}") for c in base.columns], F.col("p._patch").isNotNull().alias("patched"))


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key; found on the map side, without a sort."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("_l")).select(key, *[F.col("_l")[v].alias(v) for v in values])


def allocate(plan: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Items of each group in order while what was spent before is below the budget."""
    spent = running(plan, [group], [F.col(c) for c in order], {"spent_before": cost})
    return spent.drop("spent_before_total").filter(F.col("spent_before") < budget)


def capacities(used: DataFrame, targets: dict[str, float], goal: int) -> DataFrame:
    """provider, used, capacity, remaining, and the next provider: the largest deficit, then share."""
    spark = used.sparkSession
    shares = spark.createDataFrame([(k, v) for k, v in sorted(targets.items())], "provider string, share double")
    raw = F.bround(F.lit(goal * 1.25)).cast("long")
    known = F.broadcast(shares).join(used.withColumnRenamed("provider", "_p"), F.col("provider") == F.col("_p"), "left")  # a row for each provider
    tally = known.select("provider", "share", F.coalesce("used", F.lit(0)).alias("used"), F.floor(raw * F.col("share")).alias("capacity"))
    tally = tally.withColumn("remaining", F.greatest(F.lit(0), F.col("capacity") - F.col("used")))
    best = tally.agg(F.max_by("provider", F.struct(F.col("capacity") - F.col("used"), F.col("share"))).alias("_best"))
    return tally.crossJoin(F.broadcast(best)).select("provider", "used", "capacity", "remaining", (F.col("provider") == F.col("_best")).alias("is_next"))
