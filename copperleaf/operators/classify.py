"""Verticals by rules, in levels: the host of the landing page, the advertiser's name, the copy; the first rule in the order of priority wins.

Rules are data: a table of domains for the first level, which is joined by equality with a host and the domains above it, and lists of patterns
by vertical for the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions.copy import host


def domains_above(name: Column) -> Column:
    """The host itself, and each domain that it lies in."""
    parts = F.split(name, r"\.")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def by_domain(ads: DataFrame, key: str, url: str, rules: list[tuple[str, str]], priority: list[str]) -> DataFrame:
    """(key, place): the place in ``priority`` of the first vertical that has a rule for the address. rules: (vertical, domain or path)."""
    spark = ads.sparkSession
    place = {v: i for i, v in enumerate(priority)}
    plain = [(d.lower(), place[v]) for v, d in rules if "/" not in d]
    paths = [(d.lower(), place[v]) for v, d in rules if "/" in d]
    table = spark.createDataFrame(plain, "_domain string, _place int")
    hosts = ads.select(key, F.explode(domains_above(host(F.col(url)))).alias("_at"))
    found = hosts.join(F.broadcast(table), F.col("_at") == F.col("_domain")).select(key, "_place")  # the rules
    if paths:
        inside = F.array_compact(F.array(*[F.when(F.lower(F.coalesce(F.col(url), F.lit(""))).contains(d), p) for d, p in paths]))
        found = found.unionByName(ads.select(key, F.explode(inside).alias("_place")))
    return found.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_domain_place"))


def by_patterns(text: Column, patterns: dict[str, list[str]], priority: list[str]) -> Column:
    """The first vertical in ``priority`` one of whose patterns is found in the lower-cased text; null without."""
    made = F.lit(None).cast("string")
    for v in reversed(priority):
        for p in patterns.get(v, []):
            made = F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(f"(?U){p}"), v).otherwise(made)
    return made


def verticals(
    ads: DataFrame, key: str, url: str, name: str, copy: list[str], domains: list[tuple[str, str]], names: dict[str, list[str]], texts: dict[str, list[str]], priority: list[str]
) -> DataFrame:
    """``ads`` with its vertical and the level (1 to 3) that told it; ``unknown`` and 0 where none does."""
    found = by_domain(ads, key, url, domains, priority)
    first = F.get(F.array(*map(F.lit, priority)), F.col("_domain_place"))
    said = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in copy])
    levels = [first, by_patterns(F.col(name), names, priority), by_patterns(said, texts, priority)]
    joined = ads.join(found, F.col(key) == F.col("_key"), "left").withColumn("_l", F.array(*levels))
    at = reduce(lambda later, i: F.when(F.get("_l", F.lit(i)).isNotNull(), i + 1).otherwise(later), reversed(range(3)), F.lit(0))
    return joined.withColumns({"vertical": F.coalesce(*[F.get("_l", F.lit(i)) for i in range(3)], F.lit("unknown")), "level": at}).drop("_key", "_domain_place", "_l")
