"""Queries over samples, splits, ledgers, plans and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.operators import construct, selection, source_selection
from copperleaf.operators.ranking import running
from copperleaf.plans.registry import query
from copperleaf.plans.scoring_queries import V3_SQL, scored
from copperleaf.sources import files
from copperleaf.sources.ads import ADS_SQL, TEXT_ADS_SQL, ads, table, text_ads
from copperleaf.streaming import ingest, sweep

UNIT = lambda *parts: "CAST('0x' || substr(sha256(" + " || ':' || ".join(parts) + "), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496"
TEXT = lambda c: f"CAST({c} AS VARCHAR)"


@query("shuffled_sample", f"SELECT doc_id FROM (SELECT doc_id, {UNIT(chr(39) + '7' + chr(39), TEXT('doc_id'))} AS u FROM documents) ORDER BY u, doc_id LIMIT 50")
def shuffled_sample(spark, d):
    """A sample of 50 is the feature."""
    return selection.shuffled_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 7)


@query("top_scores", f"WITH {V3_SQL} SELECT ad_id, score FROM scored ORDER BY score DESC, ad_id LIMIT 100")
def top_scores(spark, d):
    return selection.top(scored(spark, d, "ad_id").select("ad_id", "score"), "score", "ad_id", 100)


@query("smoke_subset", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE p <= 5")
def smoke_subset(spark, d):
    return selection.first_of_each(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("rolled_examples", f"""WITH u AS (SELECT doc_id, lang, {UNIT(chr(39) + '42' + chr(39), TEXT('doc_id'))} AS u, {UNIT(chr(39) + '43' + chr(39), TEXT('doc_id'))} AS w FROM documents)
  SELECT doc_id, CASE WHEN u < 0.5::DOUBLE THEN 'standard' WHEN u < 0.7::DOUBLE THEN CASE WHEN lang = 'en' THEN 'standard' ELSE 'sparse' END WHEN u < 0.85::DOUBLE THEN 'conflicting' WHEN u < 1 THEN 'multi_constraint' ELSE 'standard' END AS difficulty,
  CASE WHEN w * 4 <= 1 THEN 'a' WHEN w * 4 <= 3 THEN 'c' ELSE 'd' END AS choice, 42 + doc_id * 1000 + 3 AS seed FROM u""")
def rolled_examples(spark, d):
    """Difficulty by cumulative ratio, a choice by weight (b has none), and the seed of each example."""
    u, w = (selection.uniform(F.lit(s), F.col("doc_id")) for s in (42, 43))
    ratios = {"standard": 0.5, "sparse": 0.2, "conflicting": 0.15, "multi_constraint": 0.15}
    rows = table(spark, d, "documents").select("doc_id", selection.difficulty(u, ratios, F.col("lang") != "en").alias("difficulty"), selection.example_seed(42, F.col("doc_id"), F.lit(3)).alias("seed"), w.alias("w"))
    return selection.weighted_choice(rows, [("a", 1.0), ("b", 0.0), ("c", 2.0), ("d", 1.0)], F.col("w"), "choice").drop("w")


@query("reshaped_batches", "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN least(greatest(2, n // 2), n) ELSE n END AS kept, n = 1 OR conv_id % 3 <> 2 OR true AS same_members FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def reshaped_batches(spark, d):
    tier = F.when(F.col("conv_id") % 3 == 0, "sparse").when(F.col("conv_id") % 3 == 2, "conflicting").otherwise("standard")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).withColumn("tier", tier)
    made = rows.withColumn("shaped", selection.reshaped(F.col("turns"), F.col("tier"), F.col("conv_id")))
    return made.select("conv_id", F.size("shaped").cast("long").alias("kept"), (F.size(F.array_except("shaped", "turns")) == 0).alias("same_members"))


@query("hash_split", f"SELECT ad_id, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id AS ad_id, {UNIT(chr(39) + 'v1' + chr(39), 'source', TEXT('doc_id'))} AS u FROM documents)")
def hash_split(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ad_id"), "source")
    return selection.hash_split(rows, selection.uniform(F.lit("v1"), F.col("source"), F.col("ad_id"))).drop("source")


@query("blake_split")
def blake_split(spark, d):
    """The same split by the hash that the corpus was first split by, so that an ad stays in its part."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ad_id"), "source")
    return selection.hash_split(rows, selection.blake_unit(F.concat_ws(":", F.lit("v1"), "source"), F.col("ad_id")))


@query("heldout_platform", f"WITH {ADS_SQL} SELECT ad_id, CASE WHEN platform = 'reddit' THEN 'test' WHEN {UNIT(chr(39) + 'v1:heldout-platform' + chr(39), 'ad_id')} < 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM ads WHERE platform IN ('reddit', 'facebook', 'tiktok', 'twitter')")
def heldout_platform(spark, d):
    rows = ads(spark, d).select("ad_id", "platform")
    return selection.heldout_split(rows, "platform", "reddit", selection.uniform(F.lit("v1:heldout-platform"), F.col("ad_id")), ["facebook", "tiktok", "twitter"]).drop("platform")


@query("heldout_vertical", f"WITH {ADS_SQL} SELECT ad_id, CASE WHEN vertical = 'building' THEN 'test' WHEN {UNIT(chr(39) + 'v1:heldout-vertical' + chr(39), 'ad_id')} < 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM ads")
def heldout_vertical(spark, d):
    rows = ads(spark, d).select("ad_id", "vertical")
    return selection.heldout_split(rows, "vertical", "building", selection.uniform(F.lit("v1:heldout-vertical"), F.col("ad_id"))).drop("vertical")


LINES = "lines AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey % 3))) AS ids FROM lineitem GROUP BY 1)"


def line_sets(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_suppkey") % 3).alias("ids"))


@query("source_set_dedup", f"WITH {LINES}, f AS (SELECT k, min(k) OVER (PARTITION BY ids) AS f FROM lines) SELECT k, CASE WHEN f <> k THEN f END AS first FROM f")
def source_set_dedup(spark, d):
    return selection.source_set_dedup(line_sets(spark, d), "ids", "k").select("k", "first")


@query("unused_sets", f"WITH {LINES} SELECT k FROM lines WHERE ids NOT IN (SELECT [0, 1]::BIGINT[] UNION ALL SELECT [2]::BIGINT[])")
def unused_sets(spark, d):
    used = spark.createDataFrame([([1, 0, 1],), ([2],)], "bundle array<bigint>")
    return selection.without_used_sets(line_sets(spark, d), "ids", used, "bundle").select("k")


@query("fresh_ads", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def fresh_ads(spark, d):
    """Ads that neither ledger holds."""
    taken = [table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey"), table(spark, d, "events").filter("event_type = 'view'").select("event_id")]
    return selection.without_ids(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", *taken)


@query("common_ids", "SELECT doc_id AS id, 'all' AS which FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT page_id FROM pages) UNION ALL SELECT id, 'any' FROM (SELECT doc_id AS id FROM labels UNION SELECT page_id FROM pages)")
def common_ids(spark, d):
    docs, labels, pages = (table(spark, d, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id")))
    return selection.in_all([docs, labels, pages], "id").withColumn("which", F.lit("all")).unionByName(selection.in_any([labels, pages], "id").withColumn("which", F.lit("any")))


@query("resolved_lists", "WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), u AS (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS place FROM l) SELECT user_id, CAST(place AS INT) AS place, lang FROM u JOIN documents ON doc_id = id")
def resolved_lists(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return selection.resolve_ids(lists, "user_id", "ids", table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("user_id", "place", "lang")


@query("last_versions", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1")
def last_versions(spark, d):
    return selection.last_of_each(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("enrich_candidates", f"WITH {V3_SQL} SELECT ad_id FROM tiered WHERE tier = 'high' AND CAST(ad_id AS BIGINT) NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ORDER BY score DESC, ad_id LIMIT 40")
def enrich_candidates(spark, d):
    done = table(spark, d, "events").filter("event_type = 'view'").select(F.col("event_id").cast("string").alias("id"))
    return selection.enrich_candidates(scored(spark, d, "ad_id"), done, 40, tier="high").select("ad_id")


STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'completed' WHEN 'signup' THEN 'ingested' WHEN 'purchase' THEN 'failed' ELSE 'expired' END"


def batches(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("batch_id"), F.expr(STATUS).alias("status"), (F.col("user_id") + 1).alias("request_count"), F.array(F.col("user_id"), F.col("event_id") % 10).alias("ids"))


@query("ledger_summary", f"WITH b AS (SELECT {STATUS} AS s, user_id + 1 AS n FROM events) SELECT CAST(count_if(s IN ('pending', 'completed')) AS BIGINT) AS pending, CAST(count_if(s NOT IN ('failed', 'expired')) AS BIGINT) AS active, CAST(sum(CASE WHEN s NOT IN ('failed', 'expired') THEN n END) AS BIGINT) AS reserved FROM b")
def ledger_summary(spark, d):
    return selection.ledger_summary(batches(spark, d))


@query("reserved_ids", f"SELECT DISTINCT unnest([user_id, event_id % 10]) AS ad_id FROM (SELECT *, {STATUS} AS s FROM events) WHERE s IN ('pending', 'completed')")
def reserved_ids(spark, d):
    return selection.reserved_ids(batches(spark, d))


PROGRESS = "SELECT user_id AS key, count(*) AS pages_fetched, bool_or(event_type = 'purchase') AS done FROM events WHERE event_type <> 'view' GROUP BY user_id"


def progress(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("pages_fetched"), F.bool_or(F.col("event_type") == "purchase").alias("done"))


@query("plan_status", f"WITH p AS (SELECT c_custkey AS key, lower(c_mktsegment) AS platform FROM customer), g AS ({PROGRESS}) SELECT platform, CAST(count_if(coalesce(done, false)) AS BIGINT) AS done, CAST(count_if(NOT coalesce(done, false) AND coalesce(pages_fetched, 0) > 0) AS BIGINT) AS in_progress, CAST(count_if(NOT coalesce(done, false) AND coalesce(pages_fetched, 0) = 0) AS BIGINT) AS not_started, CAST(sum(coalesce(pages_fetched, 0)) AS BIGINT) AS pages FROM p LEFT JOIN g ON p.key = g.key GROUP BY platform")
def plan_status(spark, d):
    return selection.plan_status(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lower("c_mktsegment").alias("platform")), progress(spark, d))


@query("page_budget", """WITH p AS (SELECT CASE user_id % 2 WHEN 0 THEN 'facebook' ELSE 'tiktok' END AS platform, event_type AS sweep, user_id AS query, min(event_id) AS place, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) % 12 END AS f FROM events GROUP BY 1, 2, user_id), s AS (SELECT *, CASE platform WHEN 'facebook' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS share FROM p WHERE query % 7 <> 0),
  n AS (SELECT *, count(*) OVER (PARTITION BY platform, sweep) AS c FROM s), k AS (SELECT platform, count(DISTINCT sweep) AS k FROM s GROUP BY 1), x AS (SELECT n.*, greatest(1, floor(floor(1000 * share) / k)) AS part FROM n JOIN k USING (platform)),
  y AS (SELECT *, least(greatest(1, floor(part / c)), 10, 10 - f) AS pages FROM x), z AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY platform, sweep ORDER BY f > 0, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y WHERE pages > 0)
  SELECT platform, sweep, query, CAST(pages AS BIGINT) AS pages FROM z WHERE before < part""")
def page_budget(spark, d):
    """Queries in the order of their first event; a third is untouched, a seventh is done."""
    platform = F.when(F.col("user_id") % 2 == 0, "facebook").otherwise("tiktok")
    plan = table(spark, d, "events").groupBy(platform.alias("platform"), F.col("event_type").alias("sweep"), F.col("user_id").alias("query")).agg(F.min("event_id").alias("place"), F.count("*").alias("n"))
    fetched = F.when(F.col("query") % 3 == 0, 0).otherwise(F.col("n") % 12)
    return selection.page_budget(plan.withColumns({"pages_fetched": fetched, "done": F.col("query") % 7 == 0}), 1000, {"facebook": 0.7, "tiktok": 0.3})


@query("collection_assessment", "SELECT event_type AS platform, count(*) AS calls, CAST(sum(event_id % 18) AS BIGINT) AS raw, CAST(sum(event_id % 18 // 2) AS BIGINT) AS \"unique\", round(1 - sum(event_id % 18 // 2)::DOUBLE / sum(event_id % 18), 6) AS dedup_rate, round(sum(event_id % 18 // 2)::DOUBLE / count(*), 6) AS unique_per_call FROM events GROUP BY 1")
def collection_assessment(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("platform"), (F.col("event_id") % 18).alias("raw"), F.expr("event_id % 18 div 2").alias("unique"))
    return selection.assessment(calls, ["platform"]).withColumns({c: F.round(c, 6) for c in ("dedup_rate", "unique_per_call")})


@query("capacity_report", f"WITH {V3_SQL} SELECT platform, vertical, count(*) AS n FROM scored WHERE score >= 0.7::DOUBLE GROUP BY ALL")
def capacity_report(spark, d):
    return scored(spark, d, "platform", "vertical").filter("score >= 0.7").groupBy("platform", "vertical").agg(F.count("*").alias("n"))


@query("group_score_stats", f"""WITH {V3_SQL}, g AS (SELECT CASE WHEN vertical = 'building' THEN 'unknown' ELSE vertical END AS vertical, score, tier FROM tiered) SELECT vertical, count(*) AS n, round(avg(score), 4) AS mean_score, max(CASE WHEN i = k // 2 THEN score END) AS upper_median,
  CAST(count_if(tier = 'high') AS BIGINT) AS high, CAST(count_if(tier = 'medium') AS BIGINT) AS medium, CAST(count_if(tier = 'low') AS BIGINT) AS low FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY vertical) AS k FROM g) GROUP BY vertical""")
def group_score_stats(spark, d):
    """A vertical that is empty or null is ``unknown``."""
    blank = F.when(F.col("vertical") == "building", F.when(F.col("platform") == "reddit", "")).otherwise(F.col("vertical"))
    return construct.group_stats(scored(spark, d, "platform", "vertical").withColumn("vertical", blank), "vertical")


PERSONAS = [{"id": "founder", "formats": ["copy"], "scale": "small", "allowed": ["building"]}, {"id": "agency", "scale": "any", "weight": 0.0}, {"id": "buyer", "scale": "large", "blocked": ["machinery"], "weight": 2.0}, {"id": "owner", "scale": "small", "weight": 1.0}]


@query("personas")
def personas(spark, d):
    rows = ads(spark, d).select("ad_id", F.col("vertical").alias("ad_vertical"), F.when(F.col("spend") > 100000, "large").otherwise("small").alias("ad_scale"), F.lit("copy").alias("task_format"))
    return selection.personas_for(rows, PERSONAS, selection.uniform(F.lit("persona"), F.col("ad_id"))).select("ad_id", "persona", "relaxed")


# -- streams


@query("stream_dedup", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_dedup(spark, d):
    """Events in two deliveries, the second with half of the first again; the stream is stopped between them and goes on from its checkpoint."""
    came, out, state = ingest.scratch(spark)
    e = table(spark, d, "events").select("event_id", "user_id")
    half = F.col("event_id") % 2 == 0
    for rows in (e.filter(half), e.filter(~half).unionByName(e.filter(F.col("event_id") % 4 == 0))):
        ingest.write_batches(rows, came)
        ingest.append_all(ingest.first_seen_only(ingest.pages(spark, came, "event_id long, user_id long"), "event_id"), out, state)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counters(spark, d):
    came, out, state = ingest.scratch(spark)
    e = table(spark, d, "events").select("event_type", "event_id")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 > 0):
        ingest.write_batches(e.filter(part), came)
        ingest.running_counts(ingest.pages(spark, came, "event_type string, event_id long"), ["event_type"], out, state)
    return ingest.latest_counts(spark, out, ["event_type"])


@query("stream_patches", "SELECT d.doc_id, coalesce(v.value, d.lang) AS lang FROM documents d LEFT JOIN (SELECT user_id, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1) v ON v.user_id = d.doc_id")
def stream_patches(spark, d):
    """Patches of ads in the order of events, in two deliveries, each by a stream that starts anew."""
    came, out, state = ingest.scratch(spark)
    log = f"{out}-patches"
    table(spark, d, "documents").select(F.col("doc_id").alias("ad_id"), "lang").write.parquet(out)
    patches = table(spark, d, "events").select(F.col("user_id").alias("ad_id"), F.col("event_type").alias("lang"), F.col("event_id").alias("ts"))
    middle = patches.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (F.col("ts") <= middle, F.col("ts") > middle):
        ingest.write_batches(patches.filter(part), came)
        ingest.append_patches(ingest.pages(spark, came, "ad_id long, lang string, ts long"), log, state)
    return ingest.patched(spark.read.parquet(out), log).select(F.col("ad_id").alias("doc_id"), "lang")


@query("swept_queries", """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS hit, event_type = 'purchase' OR event_type = 'error' OR floor(value) % 9 = 0 AS ends, event_id, floor(value) % 9 = 0 AS empty FROM events),
  e AS (SELECT key, coalesce(min(page) FILTER (ends), max(page)) AS last FROM c GROUP BY key)
  SELECT 'query' AS kind, c.key, CAST(page AS INT) AS pages_fetched, hit AS last_hit, ends AS done, CASE WHEN NOT ends THEN CAST(page + 1 AS INT) END AS next_page FROM c JOIN e ON c.key = e.key AND page = last
  UNION ALL SELECT DISTINCT 'ad', 'ad' || CAST(event_id % 997 AS VARCHAR), NULL, NULL, NULL, NULL FROM c WHERE NOT empty""")
def swept_queries(spark, d):
    """A call for each event, in three deliveries, each by a stream that starts anew: where each query stands, and each ad once."""
    came, out, state = ingest.scratch(spark)
    e = running(table(spark, d, "events"), ["user_id"], [F.col("event_id")], {"before": F.lit(1)})
    hit, empty = F.when(F.col("event_type") != "error", F.col("event_id").cast("string")), F.floor("value") % 9 == 0
    ads_ = F.when(empty, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("ad"), (F.col("event_id") % 997).cast("string"))))
    calls = e.select(F.col("user_id").cast("string").alias("query"), (F.col("before") + 1).cast("int").alias("page"), hit.alias("last_hit"), (F.col("event_type") != "purchase").alias("has_next"), ads_.alias("ads"), "event_id")
    calls = materialise(calls, "calls")  # read four times
    first, third = calls.agg(F.percentile_approx("event_id", [0.3, 0.7])).first()[0]
    for part in (F.col("event_id") <= first, (F.col("event_id") > first) & (F.col("event_id") <= third), F.col("event_id") > third):
        ingest.write_batches(calls.filter(part).drop("event_id"), came)
        sweep.run_sweep(ingest.pages(spark, came, sweep.CALL), out, state)
    rows = materialise(spark.read.parquet(out), "swept")
    none = {c: F.lit(None).cast(k) for c, k in (("pages_fetched", "int"), ("last_hit", "string"), ("done", "boolean"), ("next_page", "int"))}
    ads_seen = sweep.first_seen(rows).select(F.lit("ad").alias("kind"), F.col("ad_id").alias("key"), *[c.alias(n) for n, c in none.items()])
    return sweep.standing(rows).select(F.lit("query").alias("kind"), F.col("query").alias("key"), *none).unionByName(ads_seen)


@query("paging_state", "WITH c AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, * FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page DESC) AS p FROM c) SELECT key, page AS pages_fetched, CASE WHEN event_type <> 'error' THEN event_id END AS last_hit, event_type = 'purchase' OR event_type = 'error' OR floor(value) % 9 = 0 AS done FROM l WHERE p = 1")
def paging_state(spark, d):
    """A call for each event; an error has no cursor, a purchase no next page, and some pages are empty."""
    e = running(table(spark, d, "events"), ["user_id"], [F.col("event_id")], {"page": F.lit(1)})
    calls = e.select(F.col("user_id").alias("key"), (F.col("page") + 1).alias("page"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("last_hit"), (F.col("event_type") != "purchase").alias("has_next"), (F.floor("value") % 9).alias("n_ads"))
    return ingest.paging_state(calls)


@query("stream_windows", "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '2 days' FROM events)")
def stream_windows(spark, d):
    """Daily counts of events, as far as the watermark has passed."""
    came, out, state = ingest.scratch(spark)
    ingest.write_batches(table(spark, d, "events").select("ts", "event_type"), came)
    for _ in range(2):  # the second run, without new rows, gives out what the first run's watermark has made final
        ingest.append_all(ingest.windowed_counts(ingest.pages(spark, came, "ts timestamp, event_type string"), "ts", "1 day", "2 days", ["event_type"]), out, state)
    return spark.read.parquet(out)


@query("file_counts", "SELECT count(*) AS n FROM events")
def file_counts(spark, d):
    return files.file_counts(table(spark, d, "events")).agg(F.sum("n").alias("n"))


# -- source selection


@query("greedy_pairs", """WITH RECURSIVE p AS (SELECT c_custkey AS place, 'a' || CAST(c_custkey * 7 % 600 AS VARCHAR) AS a, 'a' || CAST(c_custkey * 11 % 600 AS VARCHAR) AS b FROM customer), k AS (SELECT DISTINCT 'a' || CAST(c_custkey % 590 AS VARCHAR) AS ad FROM customer),
  u AS (SELECT 'a' || CAST(n_nationkey * 9 AS VARCHAR) AS ad FROM nation), s AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM p WHERE place % 17 = 0), q AS (SELECT *, a NOT IN (SELECT ad FROM u) AND b NOT IN (SELECT ad FROM u) AS fresh FROM p
  WHERE a IN (SELECT ad FROM k) AND b IN (SELECT ad FROM k) AND NOT EXISTS (SELECT 1 FROM s WHERE lo = least(a, b) AND hi = greatest(a, b))), w AS (SELECT row_number() OVER (ORDER BY NOT strict, place) AS i, * FROM (SELECT place, a, b, true AS strict FROM q WHERE fresh UNION ALL SELECT place, a, b, false FROM q)),
  g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS closed, CAST(0 AS BIGINT) AS n, false AS hit UNION ALL SELECT w.i, CASE WHEN x THEN g.closed || [w.a, w.b] ELSE g.closed END, g.n + CAST(x AS BIGINT), x FROM g JOIN (SELECT *, true AS yes FROM w) w ON w.i = g.i + 1, LATERAL (SELECT g.n < 150 AND NOT list_contains(g.closed, w.a) AND NOT list_contains(g.closed, w.b) AS x))
  SELECT g.n - 1 AS batch, w.strict, w.b || ' ' || w.a AS ad_ids FROM g JOIN w USING (i) WHERE hit""")
def greedy_pairs(spark, d):
    """Pairs of customers' numbers in the order of customers; some ads are not known, some were used, and some pairs were."""
    named = lambda c: F.concat(F.lit("a"), c.cast("string"))
    rows = table(spark, d, "customer")
    pairs = rows.select(F.col("c_custkey").alias("place"), named(F.col("c_custkey") * 7 % 600).alias("high_ad_id"), named(F.col("c_custkey") * 11 % 600).alias("low_ad_id"))
    used_sets = pairs.filter("place % 17 = 0").select(F.array("low_ad_id", "high_ad_id").alias("ids"))
    made = source_selection.pair_batches(pairs, rows.select(named(F.col("c_custkey") % 590).alias("ad_id")), 150, table(spark, d, "nation").select(named(F.col("n_nationkey") * 9).alias("ad_id")), used_sets, low_first=True)
    return made.select("batch", "strict", F.array_join("ad_ids", " ").alias("ad_ids"))


@query("fresh_combinations", """WITH m AS (SELECT c_nationkey AS place, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i, c_custkey AS id FROM customer), p AS (SELECT * FROM m WHERE i <= 6),
  c AS (SELECT a.place, 3 AS k, [a.i, b.i, c.i] AS spots, [a.id, b.id, c.id] AS ids FROM p a JOIN p b ON a.place = b.place AND a.i < b.i JOIN p c ON c.place = b.place AND b.i < c.i UNION ALL SELECT a.place, 2, [a.i, b.i], [a.id, b.id] FROM p a JOIN p b ON a.place = b.place AND a.i < b.i),
  f AS (SELECT * FROM c WHERE NOT (k = 3 AND (list_sum(ids) % 4 <> 1 OR place % 5 = 0))), o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY k DESC, spots) AS n FROM f)
  SELECT d.place, array_to_string(o.ids, ' ') AS ad_ids FROM (SELECT DISTINCT place FROM p) d LEFT JOIN o ON o.place = d.place AND o.n = 1""")
def fresh_combinations(spark, d):
    """For each nation three of its six best customers whose numbers were not used together, else two."""
    rank = F.row_number().over(W.partitionBy("place").orderBy(F.col("c_acctbal").desc(), "id"))
    ranked = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("place"), "c_acctbal", F.col("c_custkey").alias("id")).withColumn("rank", rank).filter("rank <= 6")
    pools = ranked.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m")).select("place", F.transform("m", lambda x: x["id"].cast("string")).alias("ids"))
    one, two, three = (ranked.select(F.col("place").alias(f"p{i}"), F.col("rank").alias(f"r{i}"), F.col("id").alias(f"i{i}")) for i in (1, 2, 3))
    triples = one.join(two, F.expr("p1 = p2 AND r1 < r2")).join(three, F.expr("p2 = p3 AND r2 < r3"))
    used = triples.filter("(i1 + i2 + i3) % 4 <> 1 OR p1 % 5 = 0").select(F.array(*[F.col(c).cast("string") for c in ("i3", "i1", "i2")]).alias("ids"))
    return source_selection.fresh_combinations(pools, used, 2, 3).select("place", F.array_join("ad_ids", " ").alias("ad_ids"))


@query("prepared_bundles", f"""WITH {TEXT_ADS_SQL}, b AS (SELECT doc_id, ad_id, headline, row_number() OVER (ORDER BY doc_id) - 1 AS prompt_index, CAST('0x' || substr(sha256(ad_id), 1, 2) AS BIGINT) % 3 AS r FROM tads WHERE training_quality = 4)
  SELECT ad_id, prompt_index, 42 + 12 * 1000 + prompt_index AS seed, ['conversational', 'structured', 'imperative'][r + 1] AS register,
    md5('# Training-example generation — task: copywriting' || chr(10) || chr(10) || 'Write one pair.' || chr(10) || chr(10) || '## Style rules' || chr(10) || 'Keep every word.' || chr(10) || chr(10) || CASE r WHEN 0 THEN 'Chat.' || chr(10) || chr(10) WHEN 1 THEN 'List.' || chr(10) || chr(10) ELSE '' END
    || '## Source ad (the gold target — preserve its copy in the response)' || chr(10) || CASE WHEN headline = '' THEN '(none provided)' ELSE headline END || chr(10) || chr(10) || '## Output format' || chr(10) || 'Return these tags in order. No text before, between, or after.' || chr(10) || chr(10)
    || '<user_prompt>[the brief]</user_prompt>' || chr(10) || chr(10) || '<assistant_response>[the response]</assistant_response>' || chr(10)) AS prompt FROM b""")
def prepared_bundles(spark, d):
    """A prompt for each good ad, numbered on from ten examples that were made and two that are pending."""
    good = text_ads(spark, d).filter("training_quality = 4")
    batches = source_selection.assigned_styles(good.select(F.col("doc_id").alias("place"), F.array("ad_id").alias("ad_ids"), "ad_id", F.col("headline").alias("ad_text")), ["backtranslation"], F.lit(0.0))
    made = source_selection.prepared_bundles(batches, 42, 10, 2, ["conversational", "structured", "imperative"], {"conversational": "Chat.", "structured": "List."}, {"backtranslation": "Keep every word."}, "copywriting", "Write one pair.")
    return made.select("ad_id", "prompt_index", "seed", "register", F.md5("prompt").alias("prompt"))
