"""Queries over the text ads, conversations and events: filters, deduplication, splits, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from copperleaf.functions import derived, text
from copperleaf.operators import corpus
from copperleaf.plans.registry import query
from copperleaf.sources.ads import ADS_SQL, TEXT_ADS_SQL, ads, table, text_ads

T = f"WITH {TEXT_ADS_SQL}"
STRIP = lambda x: f"regexp_replace(coalesce({x}, ''), '^{text.WHITE}+|{text.WHITE}+\\z', '', 'g')"
NORM = lambda x: f"regexp_replace(lower({STRIP(x)}), '{text.WHITE}+', ' ', 'g')"
WORDS = lambda x: f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{text.WHITE}+'), lambda w: w <> '')"
PLAIN = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
JOINED = lambda *xs: "concat_ws(chr(10), " + ", ".join(f"nullif({STRIP(x)}, '')" for x in xs) + ")"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scripture_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, {sql_text(p)}) THEN '{n}'" for n, p in text.SCRIPTURE)
    return f"CASE WHEN len(regexp_extract_all({x}, '{text.DIACRITICS}')) >= 4 THEN 'diacritized_arabic' {cases} END"


WHOLE = JOINED("headline", "body")


@query("content_filters", f"""{T} SELECT ad_id, CASE WHEN coalesce(language, '') NOT IN ('en', '') THEN 'language' WHEN safety_label IN ('adult_sexual', 'profanity', 'shock_misleading', 'substance_drugs') AND safety_confidence >= 0.9 THEN 'safety'
  WHEN training_quality <> 0 AND training_quality < 3 THEN 'quality' WHEN vertical IN ('gambling_betting', 'pharmaceuticals', 'cannabis_cbd', 'political_advocacy', 'religious_faith') THEN 'vertical'
  WHEN {scripture_sql(WHOLE)} IS NOT NULL THEN 'scripture' END AS reason FROM tads""")
def content_filters(spark, d):
    reason = text.unsafe_reason(F.col("language"), F.col("safety_label"), F.col("safety_confidence"), F.col("training_quality"), F.col("vertical"), text.joined_copy(F.col("headline"), F.col("body")))
    return text_ads(spark, d).select("ad_id", reason.alias("reason"))


@query("filter_cascade_counts", f"""{T}, r AS (SELECT CASE WHEN coalesce(language, '') NOT IN ('en', '') THEN 'language' WHEN safety_label IN ('adult_sexual', 'profanity', 'shock_misleading', 'substance_drugs') AND safety_confidence >= 0.9 THEN 'safety'
  WHEN training_quality <> 0 AND training_quality < 3 THEN 'quality' WHEN {scripture_sql(WHOLE)} IS NOT NULL THEN 'scripture' ELSE 'kept' END AS reason FROM tads) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def filter_cascade_counts(spark, d):
    return content_filters(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("copy_length_filter", f"{T} SELECT ad_id, CAST(length({STRIP('headline')}) + length({STRIP('body')}) AS INT) AS copy_length FROM tads WHERE length({STRIP('headline')}) + length({STRIP('body')}) >= 60")
def copy_length_filter(spark, d):
    return text_ads(spark, d).select("ad_id", text.copy_length(F.col("headline"), F.col("body")).alias("copy_length")).filter("copy_length >= 60")


@query("clean_headlines", f"""{T}, h AS (SELECT ad_id, {STRIP('headline')} AS h, {STRIP('body')} AS b FROM tads)
  SELECT ad_id, h = '' OR NOT (regexp_matches(h, '{text.URL}') OR len(regexp_extract_all(h, '{text.HASHTAG}')) >= 2 OR (len({WORDS('h')}) > 40 AND b = '') OR (b <> '' AND lower(b) = lower(h))) AS clean FROM h""")
def clean_headlines(spark, d):
    return text_ads(spark, d).select("ad_id", text.is_clean_headline(F.col("headline"), F.col("body"), F.lit(None).cast("string")).alias("clean"))


BAIT = ", ".join(f"'{w}'" for w in text.BAIT_WORDS)


@query("headline_score", f"""{T}, h AS (SELECT ad_id, headline AS h, len({WORDS('headline')}) AS n, list_intersect([{BAIT}], {WORDS("lower(headline || ' ' || body)")}) AS bait FROM tads)
  SELECT ad_id, CASE WHEN h = '' THEN 0 ELSE round(CASE WHEN n > 0 THEN greatest(-1, -((n - 15) * (n - 15)) / 200.0::DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(h, '\\p{{Nd}}') THEN 0.3 ELSE 0 END
  + CASE WHEN contains(h, '?') THEN 0.2 ELSE 0 END + 0.05::DOUBLE * len(bait), 6) END AS score FROM h""")
def headline_score(spark, d):
    return text_ads(spark, d).select("ad_id", F.round(text.headline_score(F.col("headline"), F.col("body")), 6).alias("score"))


@query("scripture_reasons", f"{T} SELECT ad_id, {scripture_sql(WHOLE)} AS reason FROM tads")
def scripture_reasons(spark, d):
    return text_ads(spark, d).select("ad_id", text.scripture_reason(text.joined_copy(F.col("headline"), F.col("body"))).alias("reason"))


@query("register_bucket", "SELECT CAST(doc_id AS VARCHAR) AS ad_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) % 3 AS INT) AS bucket FROM documents")
def register_bucket(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ad_id"), corpus.bucket_of(F.col("doc_id").cast("string")).alias("bucket"))


@query("exact_text_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM('text')}")
def exact_text_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return corpus.first_of_each(docs, text.text_key(F.col("text")), "doc_id").select("doc_id")


@query("heldout_contamination", f"SELECT doc_id FROM documents WHERE {NORM('text')} NOT IN (SELECT {NORM('text')} FROM benchmark)")
def heldout_contamination(spark, d):
    held = table(spark, d, "benchmark").select("text")
    return corpus.held_out(table(spark, d, "documents").select("doc_id", "text"), text.text_key(F.col("text")), held, text.text_key(F.col("text"))).select("doc_id")


@query("chat_structure", f"""WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id), p AS (
  SELECT *, coalesce(list_position(list_transform(m, lambda x: x.role), 'user'), 0) AS u, coalesce(list_position(list_transform(m, lambda x: x.role), 'assistant'), 0) AS a, list_filter(m, lambda x: x.role = 'assistant') AS r FROM c
) SELECT conv_id, CAST(len(m) AS BIGINT) AS n_messages, u > 0 AND a > u AS has_reply, u > 0 AND a > 0 AND len(list_filter(r, lambda x: length({STRIP('x.text')}) < 50)) = 0 AS valid, coalesce(length(r[1].text), 0) >= 200 AS long_enough FROM p""")
def chat_structure(spark, d):
    return corpus.chat_checks(corpus.chats(table(spark, d, "conversations")))


@query("stratified_split", """WITH n AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), s AS (
  SELECT *, greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)) AS v FROM n
) SELECT doc_id, source, CASE WHEN n - 2 * v < 1 OR p <= n - 2 * v THEN 'train' WHEN p <= n - v THEN 'val' ELSE 'test' END AS split FROM s""")
def stratified_split(spark, d):
    return corpus.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "split")


@query("model_text", f"""{T} SELECT ad_id, CASE WHEN {WHOLE} = '' THEN '' ELSE '[platform=' || CASE language WHEN 'en' THEN 'facebook' ELSE 'unknown' END || '] [vertical=' || lower(vertical) || ']' || chr(10) || {WHOLE} END AS text FROM tads""")
def model_text(spark, d):
    platform = F.when(F.col("language") == "en", " Facebook\n").when(F.col("language") == "de", " ")
    return text_ads(spark, d).select("ad_id", text.build_text(platform, F.upper("vertical"), F.col("headline"), F.col("body")).alias("text"))


@query("sample_weights", f"{T} SELECT ad_id, CASE WHEN training_quality <= 1 THEN 0.0 WHEN training_quality = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM tads WHERE training_quality > 1")
def sample_weights(spark, d):
    q = F.col("training_quality")
    return text_ads(spark, d).select("ad_id", F.when(q.isNull(), 1.0).when(q <= 1, 0.0).when(q == 2, 0.5).otherwise(1.0).alias("weight")).filter("weight > 0")


@query("language_distribution", "SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang")
def language_distribution(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("_all")))).select("lang", "n", F.round(100.0 * F.col("n") / F.col("_all"), 4).alias("percent"))  # one row


SIGN = lambda x: f"CASE WHEN len(string_split({PLAIN(x)}, ' ')) >= 6 THEN array_to_string(string_split({PLAIN(x)}, ' ')[1:6], ' ') END"
LETTERS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '([a-z][a-z''-]+)'), lambda x: length(x) >= 4))"


@query("ingestion_coverage", f"""{T}, w AS (SELECT ad_id, headline, split_part(body, chr(10), 1) AS opening, substr(body, length(split_part(body, chr(10), 1)) + 2) AS response FROM tads
), c AS (SELECT *, {LETTERS("headline || ' ' || opening")} AS a, {LETTERS('response')} AS b FROM w
), v AS (SELECT *, CASE WHEN len(a) < 5 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS share FROM c)
  SELECT ad_id, round(share, 6) AS coverage, share >= 0.6::DOUBLE AS covered, (length(headline) < 15 AND length(opening) < 15) OR (length(headline) >= 15 AND coalesce(contains({PLAIN('response')}, {SIGN('headline')}), false))
    OR (length(opening) >= 15 AND coalesce(contains({PLAIN('response')}, {SIGN('opening')}), false)) AS verbatim FROM v""")
def ingestion_coverage(spark, d):
    """The first line as headline, the second as body, the rest as the response that should reproduce them."""
    opening = F.substring_index("body", "\n", 1)
    ads_ = text_ads(spark, d).select("ad_id", "headline", opening.alias("opening"), F.substring("body", F.length(opening) + 2, F.length("body")).alias("response"))
    share = text.coverage(text.content_words(F.concat_ws(" ", "headline", "opening")), text.content_words(F.col("response")))
    return ads_.select("ad_id", F.round(share, 6).alias("coverage"), (share >= 0.6).alias("covered"), text.quotes_one_of(F.col("response"), F.col("headline"), F.col("opening")).alias("verbatim"))


@query("style_specifics", """SELECT conv_id, turn, regexp_matches(text, '\\b\\d+(?:\\.\\d+)?\\s*%') AS percent, regexp_matches(text, '\\$\\s*\\d') AS dollar,
  regexp_matches(text, '(?i)\\b\\d{1,3}(?:,\\d{3})+\\s+(?:likes|shares|comments|views|impressions|clicks)\\b') AS engagement_count FROM conversations WHERE role = 'assistant'""")
def style_specifics(spark, d):
    found = text.specifics(F.col("text"))
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", *[F.array_contains(found, n).alias(n) for n in text.SPECIFICS])


@query("advertisers_without_large_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def id_antijoin(spark, d):
    large = table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey").distinct()
    return table(spark, d, "customer").select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("upsert_patch", "SELECT d.doc_id, d.source, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, d.lang) AS lang, l.doc_id IS NOT NULL AS patched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def upsert_patch(spark, d):
    patch = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("lang"))
    return corpus.upsert(table(spark, d, "documents").select("doc_id", "source", "lang"), patch, "doc_id")


@query("latest_status", "SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1")
def latest_status(spark, d):
    return corpus.latest(table(spark, d, "events").withColumn("status", F.col("event_type")), "user_id", ["ts"], ["event_id", "status"]).select("user_id", "status", "event_id")


@query("budget_allocation", """WITH p AS (SELECT user_id % 5 AS platform, user_id, CAST(count(*) AS BIGINT) AS pages FROM events GROUP BY ALL), s AS (
  SELECT *, CAST(coalesce(sum(pages) OVER (PARTITION BY platform ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM p) SELECT * FROM s WHERE spent_before < 500""")
def budget_allocation(spark, d):
    plan = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("platform"), "user_id").agg(F.count("*").alias("pages"))
    return corpus.allocate(plan, "platform", ["user_id"], "pages", 500)


@query("provider_capacity", """WITH u AS (SELECT CASE event_type WHEN 'view' THEN 'gpt' WHEN 'click' THEN 'claude' WHEN 'signup' THEN 'gemini' END AS provider, count(*) AS used FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1), t AS (
  SELECT p.provider, share, coalesce(used, 0) AS used, CAST(floor(CAST(round_even(10000 * 1.25::DOUBLE, 0) AS BIGINT) * share) AS BIGINT) AS capacity FROM (VALUES ('claude', 0.3::DOUBLE), ('gemini', 0.2::DOUBLE), ('gpt', 0.5::DOUBLE)) p(provider, share) LEFT JOIN u ON u.provider = p.provider
) SELECT provider, used, capacity, greatest(0, capacity - used) AS remaining, row_number() OVER (ORDER BY capacity - used DESC, share DESC) = 1 AS is_next FROM t""")
def provider_capacity(spark, d):
    e = F.col("event_type")
    used = table(spark, d, "events").select(F.when(e == "view", "gpt").when(e == "click", "claude").when(e == "signup", "gemini").alias("provider")).filter("provider IS NOT NULL").groupBy("provider").agg(F.count("*").alias("used"))
    return corpus.capacities(used, {"gpt": 0.5, "claude": 0.3, "gemini": 0.2}, 10000)


@query("impression_buckets", f"""WITH {ADS_SQL}, b AS (SELECT ad_id, views, views // 1000 * 1000 AS floor FROM ads)
  SELECT ad_id, CASE WHEN views < 1000 THEN 0 WHEN views > 1000000 THEN 1000000 ELSE floor END AS low, CASE WHEN views < 1000 THEN 1000 WHEN views > 200000 THEN NULL ELSE floor + 999 END AS high FROM b""")
def impression_buckets(spark, d):
    v = F.col("views")
    lower = F.expr("views div 1000") * 1000
    shown = F.when(v < 1000, "<1,000").when(v > 1000000, "1,000,000+").when(v > 200000, F.concat(F.lit("≥ "), lower.cast("string"))).otherwise(F.concat(lower.cast("string"), F.lit(" - "), (lower + 999).cast("string")))
    low, high = derived.bucket_bounds(F.col("bucket"))
    return ads(spark, d).select("ad_id", shown.alias("bucket")).select("ad_id", low.alias("low"), high.alias("high"))


@query("event_dedup", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def event_dedup(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("sweep_stats_full_outer", """WITH a AS (SELECT user_id, count(*) AS raw FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(raw, 0) AS raw, coalesce(kinds, 0) AS kinds FROM a FULL JOIN b ON a.user_id = b.user_id""")
def sweep_stats_full_outer(spark, d):
    events = table(spark, d, "events")
    a = events.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("raw"))
    b = events.filter("event_type <> 'view'").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


@query("sweep_plan", "SELECT r_name AS term, n_name AS geo, o AS ordering FROM region, nation, (SELECT unnest(['popular', 'latest']) AS o) WHERE n_regionkey = r_regionkey")
def sweep_plan(spark, d):
    """Terms by geographies by orderings: lookups of fixed size, an explode instead of a product."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    return region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("term"), F.col("n_name").alias("geo"), F.explode(F.array(F.lit("popular"), F.lit("latest"))).alias("ordering"))


@query("flattened_ads", f"{T} SELECT ad_id, headline AS ad_copy_headline, body AS ad_copy_body, '[\"' || language || '\"]' AS languages FROM tads")
def flattened_ads(spark, d):
    nested = text_ads(spark, d).select("ad_id", F.struct("headline", "body").alias("ad_copy"), F.array("language").alias("languages"))
    return nested.select("ad_id", F.col("ad_copy.headline").alias("ad_copy_headline"), F.col("ad_copy.body").alias("ad_copy_body"), F.to_json("languages").alias("languages"))
