"""What evaluation and construction work on: briefs, generations, learned rows, ground truth, datasets, reviews, crawl plans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.functions.copy import language, resolved
from copperleaf.functions.text import known_or, once, stripped
from copperleaf.sources.ads import WEAK_PLATFORMS

# The heads of a learned score, those that weak platforms do not have, and the shortest text whose language is told.
HEADS, MASKED_HEADS, LANGUAGE_LEAST = ["composite", "survivability", "engagement_volume", "engagement_velocity"], ["engagement_volume", "engagement_velocity"], 20


def said_by(role: str, messages: str = "messages") -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def briefs(examples: DataFrame) -> DataFrame:
    """examples: messages, and (example_id, task_format, platform, vertical, source_tiers) as columns, in a struct ``metadata``, or not at all. A brief
    for each: what the system and the user say, the first answer held back, and defaults for what is in neither place."""
    inside = set(examples.schema["metadata"].dataType.fieldNames()) if "metadata" in examples.columns else set()

    def told(name: str, otherwise: Column) -> Column:
        places = [F.col(name)] if name in examples.columns else []
        places += [F.col(f"metadata.{name}")] if name in inside else []
        return F.coalesce(*[F.nullif(p.cast("string"), F.lit("")) for p in places], otherwise).alias(name)

    tiers = F.coalesce("source_tiers", F.array().cast("array<string>")) if "source_tiers" in examples.columns else F.array().cast("array<string>")
    return examples.select(
        told("example_id", F.lit("")), told("task_format", F.lit("copywriting")), told("platform", F.lit("unknown")), told("vertical", F.lit("unknown")), tiers.alias("source_tiers"),
        said_by("system").alias("system"), said_by("user").alias("user"), said_by("assistant").alias("reference"),
    )


def gold_inferences(known: DataFrame, config: str = "GOLD") -> DataFrame:
    """The held-back answers as inferences of a configuration of their own, which took no time and no tokens."""
    zero = F.lit(0).cast("long")
    return known.select("example_id", F.lit(config).alias("config"), F.lit("arm1").alias("arm"), F.col("user").alias("brief"), "system", F.col("reference").alias("assistant_text"), zero.alias("latency_ms"), zero.alias("input_tokens"), zero.alias("output_tokens"), F.lit(config).alias("model_id"))


def generations(inferences: DataFrame, clean: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """inferences: (config, example_id, assistant_text); clean: (config, example_id, assistant_text_clean). Of every configuration the resolved texts
    with platform and vertical of their brief; and per configuration how many were kept, blank, and without a brief."""
    c = clean.select(F.col("config").alias("_c"), F.col("example_id").alias("_e"), "assistant_text_clean")
    both = inferences.join(c, (F.col("config") == F.col("_c")) & (F.col("example_id") == F.col("_e")), "full_outer")
    text, used = resolved(F.col("assistant_text_clean"), F.col("assistant_text"))
    rows = both.select(F.coalesce("config", "_c").alias("config"), F.coalesce("example_id", "_e").alias("example_id"), text.alias("text"), used.alias("used_clean"))
    b = known.select(F.col("example_id").alias("_b"), "platform", "vertical")
    marked = rows.join(b, F.col("example_id") == F.col("_b"), "left")
    there, said = F.col("_b").isNotNull(), stripped(F.col("text")) != ""
    counts = marked.groupBy("config").agg(F.count_if(there & said).alias("kept"), F.count_if(there & ~said).alias("blank"), F.count_if(~there).alias("no_brief"))
    return marked.filter(there & said).drop("_b"), counts


def learned_rows(rows: DataFrame) -> DataFrame:
    """rows: generations with a column for each head. The heads that a weak platform does not have are null there."""
    weak = F.lower(stripped(F.col("platform"))).isin(*WEAK_PLATFORMS)
    return rows.withColumns({h: F.when(~weak, F.col(h)) for h in MASKED_HEADS} | {"text_len": F.length("text")})


def targets(rows: DataFrame) -> DataFrame:
    """``rows`` with arrays of the heads' targets and of the mask by platform."""
    weak = known_or(F.col("platform"), "").isin(*WEAK_PLATFORMS)
    return rows.withColumns({"targets": F.array(*[F.col(h).cast("double") for h in HEADS]), "mask": F.array(*[~weak if h in MASKED_HEADS else F.lit(True) for h in HEADS])})


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"))


def ground_truth(ads: DataFrame) -> DataFrame:
    """Ads with dates and a bound of spend or impressions, with the middles of both ranges."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("spend_lower", "spend_upper", "impression_lower", "impression_upper")])
    middle = lambda k: midpoint(F.col(f"{k}_lower"), F.col(f"{k}_upper")).alias(f"{k}_mid")
    return ads.filter(some & F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).select("ad_id", "platform", middle("spend"), middle("impression"))


def ad_facts(advertiser: Column, *fields: Column) -> Column:
    """The source ad as prose without labels; fields that are long enough to be told another language than English are left out."""
    english = lambda f: (F.length(f) < LANGUAGE_LEAST) | language(f).isin("", "en")
    part = lambda f: once(F.coalesce(f, F.lit("")), lambda x: F.when((x != "") & english(x), stripped(x)))
    said = once(F.array_compact(F.array(*map(part, fields))), lambda p: F.when(F.size(p) == 0, "(no usable ad copy fields)").otherwise(F.array_join(p, "\n\n")))
    name = F.coalesce(F.nullif(advertiser, F.lit("")), F.lit("(unknown advertiser)"))
    return F.concat(F.lit("This ad ran for "), name, F.lit(".\n\nThe ad copy reads:\n\n"), said)


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """(split, kind, value, n): examples of each split in all, by format and by platform."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (("total", F.lit("")), ("format", F.col("task_format")), ("platform", F.col("platform")))])
    return rows.select("split", F.explode(cells).alias("c")).groupBy("split", "c.kind", "c.value").agg(F.count("*").alias("n"))


def reviewed(examples: DataFrame, ads: DataFrame, prompts: DataFrame) -> DataFrame:
    """Examples with their ad and their prompt, where these are known."""
    a = ads.withColumnsRenamed({c: f"ad_{c}" for c in ads.columns if c != "ad_id"}).withColumnRenamed("ad_id", "_a")
    p = prompts.withColumnRenamed("example_id", "_p")
    return examples.join(a, F.col("ad_id") == F.col("_a"), "left").join(p, F.col("example_id") == F.col("_p"), "left").drop("_a", "_p")


def unlabelled(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """records: (json), bare or with the ad inside ``ad``. (ad_id, headline) of those that can be read and have no label yet."""
    v = records.select(F.try_parse_json("json").alias("v"))
    told = lambda c: F.coalesce(F.try_variant_get("v", f"$.ad.{c}", "string"), F.try_variant_get("v", f"$.{c}", "string"))
    rows = v.select(told("ad_id").alias("ad_id"), F.coalesce(told("ad_copy.headline"), F.lit("")).alias("headline")).filter("ad_id <> ''")
    return rows.join(labelled.select(F.col("ad_id").alias("_l")).distinct(), F.col("ad_id") == F.col("_l"), "left_anti")


# -- crawl plans: configuration, and so a list; what it is multiplied out to is a table


def resolve_geos(value: str | Iterable[int] | None, groups: dict[str, list[int]]) -> list[int | None]:
    """A group's members, a list as it is, and no geography at all for nothing or an unknown group."""
    if isinstance(value, str):
        return list(groups.get(value, [])) or [None]
    return list(value or []) or [None]


def filter_codes(components: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """components: (platform, key, component, items array<struct<key,label>>, low, high, infinite). (platform, kind, key, code, label, low, high): an
    ordering or a choice for each item, and a range for each slider."""
    kept = components.filter(~F.col("key").isin(*skipped)) if skipped else components
    ordering, choice = F.col("key") == "orderby", F.col("component").startswith("Select") | (F.col("component") == "StringSingle")
    items = kept.filter(ordering | choice).select("platform", F.when(ordering, "ordering").otherwise("select").alias("kind"), "key", F.posexplode("items").alias("place", "i"))
    none = F.lit(None).cast("long")
    made = items.select("platform", "kind", "key", "place", F.col("i.key").alias("code"), F.coalesce("i.label", F.lit("")).alias("label"), none.alias("low"), none.alias("high"))
    ranges = kept.filter(~ordering & F.col("component").startswith("Range"))
    blank = F.lit(None).cast("string")
    return made.unionByName(ranges.select("platform", F.lit("range").alias("kind"), "key", F.lit(0).alias("place"), blank.alias("code"), F.lit("").alias("label"), F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high")))


def sweep_queries(spark: SparkSession, sweeps: list[dict], groups: dict[str, list[int]], codes: DataFrame | None = None) -> DataFrame:
    """(platform, sweep, filter, value, ordering, geo): a query for each term, domain, code of a filter, or tier of a range, with each ordering and
    geography; a sweep with none of these has one for each ordering and geography. Dynamic sweeps are made elsewhere. top_n takes
    the first codes, sample_n as many by hash."""
    rows = []
    for s in sweeps:
        if s.get("dynamic"):
            continue
        values = [("text", v) for v in s.get("keywords", [])] or [("url_chain", v) for v in s.get("domains", [])]
        values = values or [(s["range_filter"], f"{a}-{b}") for a, b in s.get("tiers", [])] if s.get("range_filter") else values
        types = [s["filter_type"]] if s.get("filter_type") else s.get("filter_types", [])
        if not values and not types and not s.get("range_filter"):
            values = [(None, None)]
        rows.append((s["platform"], s["name"], [{"filter": a, "value": b} for a, b in values], types, s.get("top_n"), s.get("sample_n"), s.get("orderings", ["popularity"]), resolve_geos(s.get("geos"), groups)))
    schema = "platform string, sweep string, fixed array<struct<filter:string,value:string>>, types array<string>, top_n int, sample_n int, orderings array<string>, geos array<int>"
    plan = spark.createDataFrame(rows, schema)
    cross = ["platform", "sweep", F.explode("orderings").alias("ordering"), "geos"]
    made = plan.select(*cross, F.col("fixed")).select("platform", "sweep", "ordering", "geos", F.explode("fixed").alias("f")).select("platform", "sweep", "f.filter", "f.value", "ordering", "geos")
    if codes is not None:
        asked = plan.select(F.col("platform").alias("_p"), "sweep", F.explode("types").alias("_t"), "top_n", "sample_n", "orderings", "geos")
        listed = codes.filter("kind = 'select'").join(F.broadcast(asked), (F.col("platform") == F.col("_p")) & (F.col("key") == F.col("_t")))  # a row for each filter of the plan
        from pyspark.sql import Window as W

        of = W.partitionBy("platform", "sweep", "key")  # the codes of one filter
        by_hash = F.row_number().over(of.orderBy(F.sha2("code", 256)))
        taken = listed.withColumns({"_h": by_hash, "_n": F.row_number().over(of.orderBy("place"))}).filter(F.when(F.col("sample_n").isNotNull(), F.col("_h") <= F.col("sample_n")).when(F.col("top_n").isNotNull(), F.col("_n") <= F.col("top_n")).otherwise(F.lit(True)))
        made = made.unionByName(taken.select("platform", "sweep", F.col("key").alias("filter"), F.col("code").alias("value"), F.explode("orderings").alias("ordering"), "geos"))
    return made.select("platform", "sweep", "filter", "value", "ordering", F.explode("geos").alias("geo"))


def call_budget(credits: Column, per_call: Column) -> Column:
    return F.floor(credits / per_call).cast("long")
