"""Queries over files and raw ads. Their inputs are written from the warehouse tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from copperleaf.cluster import scratch_path
from copperleaf.operators import corpus
from copperleaf.plans.registry import query
from copperleaf.plans.scoring_queries import V3_SQL, scored
from copperleaf.sources import files, parsers
from copperleaf.sources.ads import ADS_SQL, ads, table

SEEN = "json_extract_string(props, '$.k')::BIGINT AS k"
WHEN = lambda kind, value: F.when(F.col("event_type") == kind, value)
OBJECT = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])


def number():
    return F.get_json_object("props", "$.k").cast("bigint")


def moment():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def raw(spark, d, **fields):
    """One JSON text per event; fields that are null are missing in it."""
    return table(spark, d, "events").select("event_id", "event_type", F.to_json(OBJECT(**fields)).alias("json"))


def shown(df, *lists):
    return df.withColumns({c: F.array_join(c, "/") for c in lists})


@query("adflex_ads", f"""WITH e AS (SELECT *, {SEEN} FROM events) SELECT CAST(event_id AS VARCHAR) AS ad_id, CASE event_type WHEN 'view' THEN 'twitter' WHEN 'click' THEN 'reddit' ELSE 'other' END AS platform, event_type AS headline, 'below' AS body,
  CASE WHEN event_type = 'signup' THEN 'carousel' WHEN event_type = 'error' THEN 'other' ELSE 'video' END AS creative_format, 'US/FR' AS country, CAST(ts AS DATE) AS last_seen, k AS active_days, CASE WHEN event_type = 'view' AND k > 0 THEN k ELSE CAST(floor(value) AS BIGINT) END AS likes,
  CASE WHEN event_type = 'click' AND k > 0 THEN k ELSE k + 1 END AS comments, k AS shares, CASE WHEN event_type = 'error' THEN 7 ELSE 0 END AS views, CASE WHEN event_type = 'purchase' THEN k ELSE 0 END AS reactions, CAST(user_id AS VARCHAR) AS advertiser_id, 'https://b' AS landing_page_url FROM e""")
def adflex_ads(spark, d):
    part = OBJECT(type=F.when(F.col("event_type") != "error", "Video").otherwise("hologram"), subtitle=F.lit("below"), files=OBJECT(main=F.lit("u")))
    engaged = OBJECT(reactions=WHEN("view", number()), likes=F.floor("value"), comments=WHEN("click", number()), replies=number() + 1, shares=F.lit(0), reposts=number(), plays=WHEN("error", F.lit(7)), upvotes=WHEN("purchase", number()))
    places = F.array(*[OBJECT(code=F.lit(c)) for c in ("US", "", "FR")])
    made = raw(spark, d, id=F.col("event_id"), title=F.col("event_type"), engagements=engaged, attachments=F.when(F.col("event_type") == "signup", F.array(part, part)).otherwise(F.array(part)), locations=places, updated_at=moment(), active_days=number(), owner=OBJECT(id=F.col("user_id")), display_site_url=F.lit(""), display_url=F.lit("https://b"))
    platform = F.when(F.col("event_type") == "view", "X").when(F.col("event_type") == "click", "reddit").otherwise("myspace")
    return shown(parsers.adflex(made, platform=platform), "country").select("ad_id", "platform", "headline", "body", "creative_format", "country", "last_seen", "active_days", *parsers.COUNTS, "advertiser_id", "landing_page_url")


@query("adflex_details", """WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT CAST(event_id AS VARCHAR) AS ad_id, CASE WHEN event_type = 'view' THEN 'Buy' ELSE '' END AS cta, CASE WHEN k > 0 THEN k END AS impressions,
  CASE WHEN event_type = 'click' THEN DATE '2023-05-06' END AS first_seen, CASE WHEN event_type = 'click' THEN DATE '2024-12-31' ELSE CAST(ts AS DATE) END AS last_seen, CASE WHEN event_type = 'view' THEN 'cats/dogs' ELSE '' END AS interests FROM e""")
def adflex_details(spark, d):
    base = parsers.adflex(raw(spark, d, id=F.col("event_id"), updated_at=moment()))
    inner = OBJECT(cta=WHEN("view", F.lit("Buy")), impressions=number(), first_seen_at=WHEN("click", F.lit("2023-05-06T00:00:00Z")), last_seen_at=WHEN("click", F.lit("2024-12-31")), interests=WHEN("view", F.array(OBJECT(name=F.lit("cats")), OBJECT(name=F.lit("dogs")))))
    details = raw(spark, d, data=OBJECT(ad=inner)).select(F.col("event_id").cast("string").alias("ad_id"), "json")
    return shown(parsers.with_detail(base, details), "interests").select("ad_id", "cta", "impressions", "first_seen", "last_seen", "interests")


@query("meta_library_ads", f"""WITH e AS (SELECT *, {SEEN} FROM events) SELECT CAST(event_id AS VARCHAR) AS ad_id, CASE WHEN event_type = 'view' THEN 'instagram' ELSE 'facebook' END AS platform, CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'image' WHEN 'signup' THEN 'carousel' ELSE 'other' END AS creative_format,
  CASE event_type WHEN 'view' THEN 'in an object' WHEN 'click' THEN 'plain' ELSE '' END AS body, CASE WHEN event_type = 'purchase' THEN 'link' ELSE 'title' END AS headline, k * 1000 AS spend_lower, CASE WHEN event_type = 'error' THEN NULL ELSE k END AS spend_upper, CASE WHEN event_type = 'view' THEN 'DE/FR' ELSE 'US' END AS country, CAST(ts AS DATE) AS first_seen FROM e""")
def meta_library_ads(spark, d):
    item, kind = F.array(OBJECT(url=F.lit("u"))), F.col("event_type")
    # a body is a text or an object, so it is put into the JSON text itself
    made = raw(
        spark, d, adArchiveID=F.col("event_id"), publisherPlatform=F.when(kind == "view", F.array(F.lit("INSTAGRAM"), F.lit("FACEBOOK"))).otherwise(F.array(F.lit("facebook"))), videos=WHEN("view", item), images=F.when(kind.isin("view", "click"), item), cards=F.when(kind.isin("click", "signup"), item),
        snapshot=OBJECT(title=F.when(kind != "purchase", "title").otherwise(""), link_title=F.lit("link"), body=F.lit("@BODY")), spend=OBJECT(lower_bound=F.concat(number().cast("string"), F.lit(",000")), upper_bound=F.when(kind == "error", F.lit("many")).otherwise(number().cast("string"))),
        country=F.when(kind == "view", F.array(F.lit("DE"), F.lit("FR"))).otherwise(F.array(F.lit("US"))), startDate=moment(),
    )
    body = F.when(kind == "view", '{"text": "in an object"}').when(kind == "click", '"plain"').otherwise("null")
    return shown(parsers.meta_library(made.withColumn("json", F.replace("json", F.lit('"@BODY"'), body))), "country").select("ad_id", "platform", "creative_format", "body", "headline", "spend_lower", "spend_upper", "country", "first_seen")


@query("library_ads", f"""WITH e AS (SELECT *, {SEEN} FROM events), p AS (
  SELECT CAST(event_id AS VARCHAR) AS ad_id, 'tiktok_library' AS source, 'tiktok' AS platform, CASE WHEN event_type = 'view' THEN 'image' ELSE 'video' END AS creative_format, CASE WHEN event_type = 'click' THEN 'caption' ELSE 'text' END AS body, k AS likes, 'GB' AS country, CAST(ts AS DATE) AS first_seen FROM e
  UNION ALL SELECT 'g' || CAST(event_id AS VARCHAR), 'google_transparency', 'google', CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'text' ELSE 'other' END, 'text', 0, 'IE/PT', CAST(ts AS DATE) FROM e
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'bigspy', CASE event_type WHEN 'view' THEN 'youtube' ELSE 'other' END, CASE event_type WHEN 'click' THEN 'collection' ELSE 'other' END, 'text', k, CASE WHEN event_type = 'view' THEN 'SE' ELSE '' END, CAST(ts AS DATE) FROM e) SELECT * FROM p""")
def library_ads(spark, d):
    kind, ident, day = F.col("event_type"), F.col("event_id"), F.date_format("ts", "yyyy/MM/dd")
    tiktok = raw(spark, d, id=ident, adFormat=F.when(kind == "view", "IMAGE"), caption=F.when(kind == "click", "caption"), text=F.lit("text"), likes=number(), regions=F.array(F.lit("GB")), firstShown=day)
    google = raw(spark, d, creative_id=F.concat(F.lit("g"), ident.cast("string")), format=F.when(kind == "view", "Video ad").when(kind == "click", "TEXT").otherwise("shape"), text=F.lit("text"), regions=F.array(OBJECT(code=F.lit("IE")), OBJECT(code=F.lit("PT"))), first_shown=F.unix_timestamp("ts").cast("string"))
    bigspy = raw(spark, d, id=ident, platform=F.when(kind == "view", "YouTube").otherwise("x"), creative_type=F.when(kind == "click", "Collection"), content=F.lit("text"), likes=number(), country=F.when(kind == "view", "SE").otherwise(""), created_at=moment())
    made = [f(r) for f, r in ((parsers.tiktok_library, tiktok), (parsers.google_transparency, google), (parsers.bigspy, bigspy))]
    return shown(made[0].unionByName(made[1]).unionByName(made[2]), "country").select("ad_id", "source", "platform", "creative_format", "body", "likes", "country", "first_seen")


@query("political_ads", f"""WITH {ADS_SQL} SELECT ad_id, advertiser_name AS headline, first_seen, active_days, views // 1000 * 1000 AS impression_lower, CASE WHEN views > 300000 THEN NULL ELSE views // 1000 * 1000 + 999 END AS impression_upper, CAST(floor(spend) AS BIGINT) AS spend_lower FROM ads""")
def political_ads(spark, d):
    low = F.expr("views div 1000") * 1000
    rows = ads(spark, d).select(
        "ad_id", F.col("advertiser_id").cast("string").alias("advertiser_id"), "advertiser_name", F.lit("TEXT").alias("ad_type"), F.lit(None).cast("string").alias("ad_url"), F.when(F.col("views") > 300000, F.concat(low.cast("string"), F.lit("+"))).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 999).cast("string"))).alias("impressions"),
        F.floor("spend").alias("spend_range_min_usd"), F.lit(None).cast("double").alias("spend_range_max_usd"), F.col("first_seen").alias("date_range_start"), F.col("last_seen").alias("date_range_end"), F.col("active_days").alias("num_of_days"),
    )
    return parsers.political(rows).select("ad_id", "headline", "first_seen", "active_days", "impression_lower", "impression_upper", "spend_lower")


@query("archive_ads", f"""WITH {ADS_SQL} SELECT ad_id, headline, body, first_seen, views, clicks, round(cost, 6) AS cost_usd, round(ln(1 + views), 6) AS log_impressions, round(ln(1 + clicks), 6) AS log_clicks, round(CASE WHEN cost > 0 THEN ln(1 + cost) END, 6) AS log_cost
  FROM (SELECT ad_id, platform AS headline, CASE WHEN platform = 'tiktok' THEN '' ELSE vertical || ', "quoted"' END AS body, first_seen, views, likes AS clicks, CASE WHEN platform = 'facebook' THEN NULL ELSE round(spend, 2) / 65 END AS cost FROM ads WHERE views > 0)""")
def archive_ads(spark, d):
    """Through a CSV file in which NA and nothing stand for what is not known."""
    path = scratch_path(spark, "archive-csv")
    body = F.when(F.col("platform") == "tiktok", "NA").otherwise(F.concat("vertical", F.lit(', "quoted"')))
    ads(spark, d).select(
        F.col("ad_id").alias("id"), F.col("platform").alias("title"), body.alias("description"), F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"), F.lit("").alias("ended"), F.col("views").alias("impressions"), F.col("likes").alias("clicks"),
        F.when(F.col("platform") == "facebook", "NA").otherwise(F.format_string("%.2f", F.round("spend", 2))).alias("cost"),
    ).write.option("header", True).option("escape", '"').csv(path)
    rows = files.read_csv(spark, path, "id string, title string, description string, created string, ended string, impressions string, clicks string, cost string")
    made = parsers.archive(rows)
    return made.select("ad_id", "headline", "body", "first_seen", "views", "clicks", *[F.round(c, 6).alias(c) for c in ("cost_usd", "log_impressions", "log_clicks", "log_cost")])


@query("campaign_csv", "SELECT event_type || '__' || CAST(user_id AS VARCHAR) AS ad_name, CAST(count(*) AS BIGINT) AS impressions, CAST(count_if(value > 100) AS BIGINT) AS clicks, round(sum(value), 2) AS spend_usd FROM events GROUP BY 1")
def campaign_csv(spark, d):
    path = scratch_path(spark, "campaign-csv")
    e = table(spark, d, "events").groupBy(F.concat_ws("__", "event_type", F.col("user_id").cast("string")).alias(" Ad Name"))
    e.agg(F.count("*").alias("IMPRESSIONS"), F.count_if(F.col("value") > 100).alias("Link clicks"), F.lit(9).alias("Clicks (all)"), F.round(F.sum("value"), 2).alias("Amount Spent (USD)")).write.option("header", True).csv(path)
    return files.read_campaign(spark, path)


EVENT = "event_id long, event_type string, value double"


@query("jsonl_tolerant", "SELECT event_type = 'error' AS corrupt, count(*) AS n, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id END), 0) AS BIGINT) AS ids FROM events GROUP BY 1")
def jsonl_tolerant(spark, d):
    """Lines of errors are cut off, so that they are no objects."""
    path = scratch_path(spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("{oops "), line)).otherwise(line).alias("value")).write.text(path)
    rows = files.read_jsonl_tolerant(spark, path, EVENT)
    corrupt = F.col(files.CORRUPT).isNotNull()
    return rows.select(corrupt.alias("corrupt"), "event_id", "event_type", "value").groupBy("corrupt").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.col("corrupt"), F.col("event_id"))), F.lit(0)).alias("ids"))


@query("jsonl_append", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def jsonl_append(spark, d):
    """Written, overwritten with one half, appended to with the other, and read strictly."""
    path, e = scratch_path(spark, "jsonl"), table(spark, d, "events").select("event_id", "event_type", "value")
    files.write_jsonl(e, path)
    files.write_jsonl(e.filter("value < 250"), path)
    files.write_jsonl(e.filter("value >= 250"), path, append=True)
    return files.read_jsonl(spark, path, EVENT).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("updated_records", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' END, lang) AS lang, CASE WHEN l.doc_id IS NULL OR l.toxic <> 1 THEN d.source ELSE 'patched' END AS source_tag, 1 AS kept_tag, CASE WHEN l.toxic = 1 THEN 1 END AS new_tag, l.doc_id IS NOT NULL AS touched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def updated_records(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.create_map(F.lit("source"), F.col("source"), F.lit("kept"), F.lit("1")).alias("tags"))
    patch = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.when(F.col("toxic") == 1, F.create_map(F.lit("source"), F.lit("patched"), F.lit("new"), F.lit("1"))).alias("tags"))
    made = files.update_records(docs, patch, "doc_id")
    return made.select("doc_id", "lang", F.col("tags")["source"].alias("source_tag"), F.col("tags")["kept"].cast("int").alias("kept_tag"), F.col("tags")["new"].cast("int").alias("new_tag"), "touched")


@query("flattened_scored", f"""WITH {V3_SQL} SELECT ad_id, platform AS ad_copy_headline, vertical AS ad_copy_body, '["' || platform || '"]' AS country, '' AS placements, survivability_pct AS signal_survivability, volume_pct AS signal_volume, score AS composite_score, tier FROM tiered""")
def flattened_scored(spark, d):
    """Scored ads as the nested records that they are kept as, flattened to Parquet columns."""
    rows = scored(spark, d, "ad_id", "platform", "vertical", "survivability_pct", "volume_pct").select(
        "ad_id", F.struct(F.col("platform").alias("headline"), F.col("vertical").alias("body")).alias("ad_copy"), F.array("platform").alias("country"), F.array().cast("array<string>").alias("placements"),
        F.create_map(F.lit("survivability"), F.col("survivability_pct"), F.lit("volume"), F.col("volume_pct")).alias("signal_scores"), F.col("score").alias("composite_score"), "tier", F.struct(F.lit(1).alias("x")).alias("raw_data"), F.create_map(F.lit("a"), F.lit(1)).alias("demographics"),
    )
    return files.flattened(rows, maps={"signal_scores": ("signal", ["survivability", "volume"])})


@query("config_tables", "SELECT CASE WHEN value < 200 THEN 'a' ELSE 'b' END AS config, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total, CAST(count_if(value >= 200) AS BIGINT) AS extra FROM events GROUP BY 1")
def config_tables(spark, d):
    """Two of three configurations have a table, with columns of different types."""
    root, e = scratch_path(spark, "configs"), table(spark, d, "events")
    files.write_config(e.filter("value < 200").select(F.col("event_id").cast("long").alias("x")), root, "a")
    files.write_config(e.filter("value >= 200").select(F.col("event_id").cast("double").alias("x"), F.lit(1).alias("only_b")), root, "b")
    return files.read_configs(spark, root, ["a", "b", "c"]).groupBy("config").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.count("only_b").alias("extra"))


@query("split_parts", """WITH n AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), s AS (SELECT *, greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)) AS v FROM n)
  SELECT source, count(*) AS n FROM s WHERE n - 2 * v >= 1 AND p > n - v GROUP BY source""")
def split_parts(spark, d):
    """The split is written by part, and only the test part is read."""
    root = scratch_path(spark, "splits")
    files.write_split(corpus.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id"), root, "ordered")
    return files.read_split(spark, root, "ordered", "test").groupBy("source").agg(F.count("*").alias("n"))
