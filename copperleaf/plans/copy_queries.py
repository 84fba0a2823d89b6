"""Queries over copy and answers: cleaning, resolving, keys, hosts, language, rules, likeness, the filter cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from copperleaf.cluster import materialise
from copperleaf.functions import copy, text
from copperleaf.functions.article import article_text
from copperleaf.functions.derived import any_date, bound, log_midpoint
from copperleaf.operators import classify, construct, examples, grounding, language, records, similarity
from copperleaf.operators.experiments import ab_tests
from copperleaf.operators.near_duplicates import STOP_WORDS, near_duplicates
from copperleaf.plans.corpus_queries import JOINED, PLAIN, STRIP, T
from copperleaf.plans.registry import query
from copperleaf.plans.scoring_queries import V3_SQL, scored
from copperleaf.sources.ads import ADS_SQL, ads, table, text_ads

# What an answer looks like around its copy: fixtures, made alike in both engines.
WRAPPED = """CASE turn % 5 WHEN 0 THEN '<think>a' || chr(10) || 'b</think>' || text WHEN 1 THEN '**Ad Copy:**' || chr(10) || text WHEN 2 THEN 'Here is the ad you asked for:' || chr(10) || chr(10) || text
  WHEN 3 THEN text || chr(10) || chr(10) || '**Why this works:** it does' ELSE text END"""


@query("cleaned_copy", f"SELECT conv_id, turn, {STRIP('text')} AS clean FROM conversations")
def cleaned_copy(spark, d):
    """Turns wrapped as models wrap copy, then cleaned: what comes back is the turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", copy.clean_copy(F.expr(WRAPPED.replace("||", "||").replace("chr(10)", "'\\n'"))).alias("clean"))


QUOTED = lambda x: f"CASE WHEN length({x}) >= 2 AND starts_with({x}, '\"') AND ends_with({x}, '\"') THEN {STRIP(f'substr({x}, 2, length({x}) - 2)')} ELSE {x} END"


@query("unwrapped_answers", f"SELECT conv_id, turn, CASE WHEN turn = 1 THEN s ELSE {QUOTED('s')} END AS plain FROM (SELECT conv_id, turn, {STRIP('text')} AS s FROM conversations)")
def unwrapped_answers(spark, d):
    fenced = F.when(F.col("turn") == 0, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(F.col("turn") == 1, F.concat(F.lit(' "'), "text", F.lit('" '))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", copy.unwrapped(fenced).alias("plain"))


@query("bundle_parts", f"SELECT conv_id, turn, {STRIP('text')} AS prompt, 'x' AS response FROM conversations")
def bundle_parts(spark, d):
    made = F.concat(F.lit("so: <user_prompt>\n"), "text", F.lit("</user_prompt> and <assistant_response> x </assistant_response><user_prompt>no</user_prompt>"))
    return table(spark, d, "conversations").select("conv_id", "turn", copy.tagged(made, "user_prompt").alias("prompt"), copy.tagged(made, "assistant_response").alias("response"))


@query("resolved_texts", """WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '<EXTRACTION_FAILED>' ELSE 'clean ' || CAST(quality AS VARCHAR) END AS clean FROM labels)
  SELECT d.doc_id, md5(CASE WHEN clean = '<EXTRACTION_FAILED>' THEN '' ELSE coalesce(clean, text, '') END) AS resolved, c.doc_id IS NOT NULL AS used_clean, CASE WHEN clean = '<EXTRACTION_FAILED>' THEN '[Model produced no usable ad copy.]' WHEN clean IS NOT NULL THEN clean ELSE 'raw' END AS judged,
  coalesce(clean <> '<EXTRACTION_FAILED>', false) AS valid, sha256(coalesce(text, '')) AS cache_key FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""")
def resolved_texts(spark, d):
    """The cleaned text where there is one, and none in place of one that could not be made."""
    clean = table(spark, d, "labels").select(F.col("doc_id").alias("_l"), F.when(F.col("toxic") == 1, copy.EXTRACTION_FAILED).otherwise(F.concat(F.lit("clean "), F.col("quality").cast("string"))).alias("clean"))
    rows = table(spark, d, "documents").join(clean, F.col("doc_id") == F.col("_l"), "left")
    told, used = copy.resolved(F.col("clean"), F.col("text"))
    judged = copy.judge_input(F.col("clean"), F.lit("raw"))
    return rows.select("doc_id", F.md5(told).alias("resolved"), used.alias("used_clean"), judged.alias("judged"), copy.is_clean_record(F.col("clean")).alias("valid"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))


@query("copy_context", f"""{T} SELECT ad_id, md5({JOINED('headline', 'body')}) AS joined, CASE WHEN length({STRIP('body')}) >= 10 THEN 'has_body' ELSE 'headline_only' END AS shape, CASE WHEN training_quality = 4 THEN 'books' ELSE vertical END AS category,
  CASE language WHEN 'en' THEN 'facebook' WHEN 'de' THEN 'twitter' ELSE language END AS platform, CASE WHEN language = 'en' THEN 'meta' ELSE 'pinterest' END AS cluster_platform, {STRIP('headline')} <> '' OR {STRIP('body')} <> '' AS usable FROM tads""")
def copy_context(spark, d):
    """Shape, category and platform of each ad, as training examples are made from."""
    business, vertical = F.when(F.col("training_quality") == 4, "books").otherwise(""), F.concat(F.when(F.col("language") == "en", "meta:").otherwise(""), "vertical")
    platform = F.when(F.col("language") == "en", "meta").when(F.col("language") == "de", "x").otherwise(F.col("language"))
    return text_ads(spark, d).select(
        "ad_id", F.md5(text.joined_copy(F.col("headline"), F.col("body"))).alias("joined"), copy.ad_shape(F.col("body"), F.lit(None).cast("string")).alias("shape"), copy.business_category(business, F.concat(F.lit("p:"), "vertical")).alias("category"),
        copy.platform_alias(platform).alias("platform"), copy.cluster_platform(vertical, F.lit("pinterest")).alias("cluster_platform"), (text.joined_copy(F.col("headline"), F.col("body")) != "").alias("usable"),
    )


@query("model_providers", "SELECT provider, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'gpt' WHEN 'signup' THEN 'gemini' WHEN 'purchase' THEN 'gpt' ELSE 'unknown' END AS provider FROM events) GROUP BY 1")
def model_providers(spark, d):
    names = {"view": "Anthropic/x", "click": "openai-mini", "signup": "models/GEMINI", "purchase": "o3"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select(copy.provider(name).alias("provider")).groupBy("provider").agg(F.count("*").alias("n"))


@query("config_names", "SELECT event_id, event_type = 'view' AS is_gold, CASE event_type WHEN 'view' THEN 'GOLD_2' WHEN 'click' THEN 'GOLDEN' ELSE event_type END AS base, CASE WHEN event_type NOT IN ('view', 'click') THEN 'v-' || CAST(user_id AS VARCHAR) END AS variant FROM events")
def config_names(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "view", "GOLD_2").when(kind == "click", "GOLDEN").otherwise(F.concat(kind, F.lit("@v-"), F.col("user_id").cast("string")))
    base, variant = copy.variant_parts(F.col("name"))
    return table(spark, d, "events").select("event_id", name.alias("name")).select("event_id", copy.is_gold(F.col("name")).alias("is_gold"), base.alias("base"), variant.alias("variant"))


@query("page_hosts", "SELECT page_id, lower(regexp_extract(url, '^(?i)https?://([^/?:#]+)', 1)) AS host, lower(regexp_extract(url, '^(?i)https?://([^/?:#]+)', 1)) AS bare_host, contains(lower(url), 'example.org/es') AS spanish, regexp_matches(url, '(?i)^https?://([^/]*[.])?example[.]org([/?:#]|$)') AS below, regexp_matches(url, '(?i)^https?://([^/]*[.])?xample[.]org([/?:#]|$)') AS other FROM pages")
def page_hosts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", copy.host(url).alias("host"), copy.host(F.replace(url, F.lit("http://"), F.lit(" "))).alias("bare_host"), copy.on_domain(url, F.lit("Example.org/es")).alias("spanish"), copy.on_domain(url, F.lit("example.org")).alias("below"), copy.on_domain(url, F.lit("xample.org")).alias("other")
    )


DOMAINS = [("travel", "example.org/es"), ("retail", "example.org/de"), ("health", "example.net"), ("food", "example.com")]
NAMES = {"finance": [r"^the", "bank"], "retail": [r"^s"]}
TEXTS = {"food": [r"\bnicht\b"], "finance": ["zzz"], "travel": ["charset"]}
PRIORITY = ["finance", "retail", "health", "food", "travel"]


def _first(cases: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {cases[v]} THEN '{v}'" for v in PRIORITY if v in cases) + " END"


@query("rule_verticals", f"""WITH p AS (SELECT page_id, lower(url) AS url, lower(html) AS html, regexp_extract(lower(url), '^https?://([^/?:#]+)', 1) AS host FROM pages), v AS (
  SELECT page_id, {_first({v: (f"contains(url, '{f}')" if "/" in f else f"host = '{f}' OR ends_with(host, '.{f}')") for v, f in DOMAINS})} AS a, {_first({v: " OR ".join(f"regexp_matches(split_part(host, '.', 1), '{p}')" for p in ps) for v, ps in NAMES.items()})} AS b,
  {_first({v: " OR ".join(f"regexp_matches(html, '{p}')" for p in ps) for v, ps in TEXTS.items()})} AS c FROM p) SELECT page_id, coalesce(a, b, c, 'unknown') AS vertical, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 ELSE 0 END AS level FROM v""")
def rule_verticals(spark, d):
    pages = table(spark, d, "pages").withColumn("name", F.split_part(copy.host(F.col("url")), F.lit("."), F.lit(1)))
    return classify.verticals(pages, "page_id", "url", "name", ["html"], DOMAINS, NAMES, TEXTS, PRIORITY).select("page_id", "vertical", "level")


BAD = ["nicht", "inin", "zzz"]


@query("content_safety", f"""SELECT doc_id, CASE WHEN {STRIP('text')} = '' THEN 'L0_empty' WHEN coalesce(lang, '') NOT IN ('', 'en') THEN 'L0_skip_lang' WHEN len(w) > 0 THEN 'L1_wordlist' ELSE 'L0_clean' END AS level,
  CASE WHEN {STRIP('text')} <> '' AND coalesce(lang, '') IN ('', 'en') THEN array_to_string(list_sort(w), ' ') ELSE '' END AS words
  FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}'']+'), lambda x: x IN ('nicht', 'inin', 'zzz'))) AS w FROM documents)""")
def content_safety(spark, d):
    level, words = copy.safety(F.col("text"), F.col("lang"), BAD)
    return table(spark, d, "documents").select("doc_id", level.alias("level"), F.array_join(words, " ").alias("words"))


@query("page_texts")
def page_texts(spark, d):
    """Readable text of each page, up to 12,000 characters as the reader of articles takes it."""
    said = copy.main_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(said).alias("n"), F.substring(said, 1, 12000).alias("text"))


@query("article_texts")
def article_texts(spark, d):
    """The article in each page, by a reader of its tags and a choice of its blocks; up to 12,000 characters of it."""
    said = table(spark, d, "pages").select("page_id", article_text(F.col("html")).alias("said"))
    return said.select("page_id", F.length("said").alias("n"), F.substring("said", 1, 12000).alias("text"))


@query("language_detection")
def language_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", copy.language(F.col("text")).alias("language"))


@query("learned_language", """WITH s AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS flat FROM documents), c AS (SELECT doc_id, lang, regexp_extract_all(flat, '(?s).') AS g FROM s WHERE length(flat) >= 3),
  r AS (SELECT doc_id, lang, x, count(*) AS n FROM (SELECT doc_id, lang, unnest(g || [g[i] || g[i + 1] FOR i IN range(1, len(g))] || [g[i] || g[i + 1] || g[i + 2] FOR i IN range(1, len(g) - 1)]) AS x FROM c) WHERE x <> ' ' GROUP BY ALL),
  l AS (SELECT lang, x, sum(n) AS n FROM r WHERE lang IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT x FROM (SELECT x, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS p FROM l) WHERE p <= 2000), t AS (SELECT lang, sum(n) AS total FROM l JOIN k USING (x) GROUP BY lang),
  m AS (SELECT k.x, t.lang, ln((coalesce(l.n, 0) + 1) / (t.total + (SELECT count(*) FROM k))::DOUBLE) AS share FROM k CROSS JOIN t LEFT JOIN l ON l.x = k.x AND l.lang = t.lang),
  z AS (SELECT doc_id, m.lang, sum(n * share) AS s FROM r JOIN m USING (x) GROUP BY ALL), b AS (SELECT doc_id, lang AS language, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 6) DESC, lang DESC) AS p FROM z)
  SELECT d.doc_id, coalesce(b.language, '') AS language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND p = 1""")
def learned_language(spark, d):
    """The language of each document, by what all labelled documents teach."""
    docs = table(spark, d, "documents")
    return language.with_language(docs, "doc_id", "text", language.language_model(docs, "text", "lang"))


@query("label_batch", "SELECT CAST(doc_id AS VARCHAR) AS ad_id, 'v' || CAST(quality AS VARCHAR) AS vertical, toxic / 2.0::DOUBLE AS confidence, quality * 4 AS training_quality FROM labels WHERE NOT (toxic = 1 AND quality = 1)")
def label_batch(spark, d):
    """Lines of a batch's output: an answer that is JSON text inside JSON; bad toxic ones are cut off and cannot be read."""
    inner = F.to_json(F.struct(F.concat(F.lit("v"), F.col("quality").cast("string")).alias("vertical"), (F.col("toxic") / 2).alias("confidence"), (F.col("quality") * 4).alias("training_quality")))
    message = F.array(F.struct(F.struct(F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.substring(inner, 1, 5)).otherwise(inner).alias("content")).alias("message")))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(F.struct(message.alias("choices")).alias("body")).alias("response")))
    return table(spark, d, "labels").select(copy.label_of_answer(line).alias("l")).filter("l IS NOT NULL").select("l.*")


@query("campaign_texts", "SELECT CAST(doc_id AS VARCHAR) AS ad_id, coalesce(lang, '') || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || 'two' || CASE WHEN source IS NULL THEN '' ELSE chr(10) || chr(10) || source END AS text FROM documents")
def campaign_texts(spark, d):
    campaign = F.map_filter(F.create_map(F.lit("zz"), F.col("source"), F.lit("meta"), F.lit("hidden"), F.lit("body"), F.lit('["one", " ", "two"]'), F.lit("headline"), F.concat(F.lit(" "), F.coalesce("lang", F.lit("")))), lambda k, v: v.isNotNull())
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ad_id"), copy.campaign_copy(campaign).alias("text"))


@query("parsed_values", f"""WITH {ADS_SQL} SELECT ad_id, first_seen AS iso, first_seen AS slashes, first_seen AS day_first, first_seen AS month_first, first_seen AS seconds, first_seen AS compact, first_seen AS one_digit, first_seen AS with_time, CAST(NULL AS DATE) AS junk, CAST(NULL AS DATE) AS trailing, CAST(NULL AS DATE) AS many_digits, views AS grouped, CAST(NULL AS BIGINT) AS words,
  round(CASE WHEN views + likes > 0 THEN ln(1 + (views + likes) / 2.0::DOUBLE) END, 6) AS middle, round(CASE WHEN likes > 0 THEN ln(1 + likes::DOUBLE) END, 6) AS one_bound FROM ads""")
def parsed_values(spark, d):
    """Dates in every form, numbers with separators, logarithms of the middle of a range."""
    form = lambda f: any_date(F.date_format("first_seen", f))
    none = F.lit(None).cast("long")
    return ads(spark, d).select(
        "ad_id", form("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), form("yyyy/MM/dd").alias("slashes"), form("dd-MM-yyyy").alias("day_first"), form("MM/dd/yyyy").alias("month_first"), any_date(F.unix_timestamp(F.col("first_seen").cast("timestamp")).cast("string")).alias("seconds"), any_date(F.lit("soon")).alias("junk"),
        form("yyyyMMdd").alias("compact"), form("M/d/yyyy").alias("one_digit"), form("yyyy-MM-dd' 'HH:mm'+05:30'").alias("with_time"), any_date(F.concat(F.col("first_seen").cast("string"), F.lit(" anything"))).alias("trailing"), any_date(F.repeat(F.lit("9"), F.lit(25))).alias("many_digits"),
        bound(F.format_number("views", 0)).alias("grouped"), bound(F.lit("many")).alias("words"), F.round(log_midpoint(F.col("views"), F.col("likes")), 6).alias("middle"), F.round(log_midpoint(none, F.col("likes")), 6).alias("one_bound"),
    )


# -- the cascade


STYLED = """ex AS (SELECT conv_id AS example_id, CASE conv_id % 3 WHEN 0 THEN 'backtranslation' WHEN 1 THEN 'context_distilled' ELSE 'natural' END AS style, conv_id % 2 = 0 AS leaks FROM (SELECT DISTINCT conv_id FROM conversations))"""
SAID = """CASE WHEN role = 'assistant' AND conv_id % 7 = 1 THEN '<assistant_response>' || text || '</assistant_response> <thinking>hm</thinking>' WHEN role = 'assistant' AND conv_id % 7 = 2 THEN text || ' <foo a>' WHEN role = 'assistant' AND conv_id % 7 = 3 THEN text || ' up 32% for $5'
  WHEN role = 'assistant' AND conv_id % 7 = 4 THEN 'Headline : x ' || text || ' you could also try' WHEN role = 'assistant' AND conv_id % 7 = 5 THEN '<b>' || text || '</b>' ELSE text END"""


def chat_examples(spark, d):
    turns = table(spark, d, "conversations").withColumn("said", F.expr(SAID))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("said").alias("text")))).alias("m"))
    style = F.element_at(F.array(F.lit("backtranslation"), F.lit("context_distilled"), F.lit("natural")), (F.col("conv_id") % 3 + 1).cast("int"))
    ids = F.when(F.col("conv_id") % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("conv_id") % 40, F.col("conv_id") % 5, F.col("conv_id") % 40))
    return chats.select(F.col("conv_id").alias("example_id"), style.alias("style"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"), ids.alias("source_ids"))


def near_sql(name: str, source: str, threshold: float) -> str:
    """Parts of a recursive WITH: <name>_fallen (key), of a table of key and text, by all pairs and one text after the other."""
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""{name}_s AS (SELECT * FROM {source} WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''
), {name}_c AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {name}_s) WHERE term NOT IN ({words}) GROUP BY ALL
), {name}_v AS (SELECT term, ln((1 + (SELECT count(*) FROM {name}_s))::DOUBLE / (1 + count(*))::DOUBLE) + 1 AS idf FROM {name}_c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000
), {name}_w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM (SELECT key, term, tf * idf AS w FROM {name}_c JOIN {name}_v USING (term))
), {name}_l AS (SELECT key, list(earlier) AS earlier FROM (SELECT a.key, b.key AS earlier FROM {name}_w a JOIN {name}_w b ON a.term = b.term AND b.key < a.key GROUP BY ALL HAVING round(sum(a.w * b.w), 9) > {threshold}::DOUBLE) GROUP BY key
), {name}_o AS (SELECT key, coalesce(earlier, []) AS earlier, row_number() OVER (ORDER BY key) AS i FROM {name}_s LEFT JOIN {name}_l USING (key)
), {name}_g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS key, false AS fell
  UNION ALL SELECT o.i, CASE WHEN list_has_any(g.kept, o.earlier) THEN g.kept ELSE list_append(g.kept, o.key) END, o.key, list_has_any(g.kept, o.earlier) FROM {name}_g g JOIN {name}_o o ON o.i = g.i + 1
), {name}_fallen AS (SELECT key FROM {name}_g WHERE fell)"""


@query("near_duplicate_texts")
def near_duplicate_texts(spark, d):
    """Documents that are more than 0.80 like an earlier kept one. All pairs in SQL take minutes on whole tables: tested against a loop."""
    return near_duplicates(table(spark, d, "documents"), "doc_id", "text", 0.80)


CASCADE_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, {SAID} AS text FROM conversations), r AS (
  SELECT conv_id, turn, role, {STRIP("regexp_replace(CASE WHEN regexp_matches(text, '(?is)<assistant_response[^>]*>(.*?)</assistant_response>') THEN regexp_extract(text, '(?is)<assistant_response[^>]*>(.*?)</assistant_response>', 1) ELSE text END, '(?is)<thinking[^>]*>.*?</thinking>', '', 'g')")} AS text FROM t
), c AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS u, min(CASE WHEN role = 'assistant' THEN turn END) AS a, max(CASE WHEN contains(text, '<foo a>') THEN 1 ELSE 0 END) AS residue FROM r GROUP BY conv_id
), x AS (SELECT c.*, coalesce(r.text, '') AS reply, conv_id % 3 AS style FROM c LEFT JOIN (SELECT conv_id AS k, turn AS w, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS i FROM r WHERE role = 'assistant') r ON r.k = c.conv_id AND r.w = c.a AND r.i = 1
), s AS (SELECT *, CASE WHEN residue = 1 THEN 'artifact_leak' WHEN NOT coalesce(u < a, false) THEN 'structural' WHEN length(reply) < CASE WHEN style = 0 THEN 80 ELSE 200 END THEN 'min_length'
    WHEN style = 0 AND (regexp_matches(reply, '(?im)^\\s*headline\\s*:') OR contains(lower(reply), 'you could also try')) THEN 'format_specific' WHEN style = 1 AND (regexp_matches(reply, '\\b\\d+\\s*%') OR regexp_matches(reply, '\\$\\s*\\d')) THEN 'style_b_specificity' END AS stage FROM x
), p AS (SELECT s.*, coalesce(q.text, '') AS prompt FROM s LEFT JOIN (SELECT conv_id AS k, turn AS w, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS i FROM r WHERE role = 'user') q ON q.k = s.conv_id AND q.w = s.u AND q.i = 1
), {near_sql("dr", "(SELECT conv_id AS key, reply AS text FROM p WHERE stage IS NULL)", 0.80)}, {near_sql("dp", "(SELECT conv_id AS key, prompt AS text FROM p WHERE stage IS NULL AND conv_id NOT IN (SELECT key FROM dr_fallen))", 0.85)
}, y AS (SELECT * REPLACE (coalesce(stage, CASE WHEN conv_id IN (SELECT key FROM dr_fallen) THEN 'duplicate' WHEN conv_id IN (SELECT key FROM dp_fallen) THEN 'prompt_duplicate' END) AS stage) FROM p
), k AS (SELECT *, CASE WHEN conv_id % 11 <> 0 THEN list_sort(list_distinct([conv_id % 40, conv_id % 5])) END AS ids FROM y), f AS (SELECT *, CASE WHEN stage IS NULL AND ids IS NOT NULL AND conv_id <> min(conv_id) OVER (PARTITION BY ids, stage IS NULL) THEN 'source_ad_duplicate' ELSE stage END AS final FROM k)"""


@query("filter_cascade", CASCADE_SQL + " SELECT conv_id AS example_id, final AS stage FROM f")
def filter_cascade(spark, d):
    """Language is taken as English for every example: the fixture's words are invented."""
    return examples.judged(chat_examples(spark, d), language=F.lit("en")).select("example_id", "stage")


@query("filter_cascade_stats", CASCADE_SQL + " SELECT coalesce(final, 'passed') AS stage, CAST(sum(CASE WHEN final = 'format_specific' THEN CAST(regexp_matches(reply, '(?im)^\\s*headline\\s*:') AS INT) + CAST(contains(lower(reply), 'you could also try') AS INT) ELSE 1 END) AS BIGINT) AS n FROM f GROUP BY 1")
def filter_cascade_stats(spark, d):
    return examples.stage_counts(examples.judged(chat_examples(spark, d), language=F.lit("en")))


@query("repaired_messages", f"SELECT conv_id AS example_id, bool_or(conv_id % 7 = 1 AND role = 'assistant' OR text <> {STRIP('text')}) AS repaired, CASE WHEN conv_id % 7 = 2 AND count_if(role = 'assistant') > 0 THEN 'assistant:<foo a>' END AS residue FROM conversations GROUP BY conv_id")
def repaired_messages(spark, d):
    return examples.repaired(chat_examples(spark, d)).select("example_id", "repaired", "residue")


@query("ingested_bundles", f"""{T}, b AS (SELECT ad_id, headline, CASE WHEN training_quality = 2 THEN 'nothing of it ' || repeat('filler ', 20) ELSE headline || ' ' || body END AS answer, training_quality = 0 AND language = 'fr' AS unknown, language = 'de' AS broken FROM tads
  ), w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(headline), '([a-z][a-z''-]+)'), lambda x: length(x) >= 4)) AS a, list_distinct(list_filter(regexp_extract_all(lower(answer), '([a-z][a-z''-]+)'), lambda x: length(x) >= 4)) AS c FROM b
  ), q AS (SELECT *, CASE WHEN broken OR {STRIP('answer')} = '' THEN 'parse' WHEN unknown THEN 'unknown_ad' WHEN len(a) >= 5 AND len(list_intersect(a, c))::DOUBLE / greatest(1, len(a)) < 0.6::DOUBLE THEN 'word_coverage'
    WHEN length(headline) >= 15 AND NOT coalesce(contains({PLAIN('answer')}, CASE WHEN len(string_split({PLAIN('headline')}, ' ')) >= 6 THEN array_to_string(string_split({PLAIN('headline')}, ' ')[1:6], ' ') END), false) THEN 'verbatim_signature' END AS reason FROM w)
  SELECT coalesce(reason, 'example') AS outcome, count(*) AS n FROM q GROUP BY 1""")
def ingested_bundles(spark, d):
    """Answers that hold the ad, that do not, that are of an unknown ad, and that cannot be parsed."""
    answer = F.when(F.col("training_quality") == 2, F.concat(F.lit("nothing of it "), F.repeat(F.lit("filler "), F.lit(20)))).otherwise(F.concat_ws(" ", "headline", "body"))
    known = ~((F.col("training_quality") == 0) & (F.col("language") == "fr"))
    output = F.concat(F.lit("<user_prompt>write</user_prompt><assistant_response>"), answer, F.when(F.col("language") == "de", "").otherwise("</assistant_response>"))
    rows = text_ads(spark, d).select(F.col("ad_id").alias("example_id"), output.alias("output"), F.when(known, F.col("headline")).alias("headline"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("description"))
    made, rejects = examples.ingested(rows)
    return made.select(F.lit("example").alias("outcome")).unionByName(rejects.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


# -- likeness


GOLD = "vec_id % 50 = 0"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.concat(F.lit("p"), (F.col("label") % 5).cast("string")).alias("platform"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"))


NEAR_SQL = "list_inner_product(g.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_inner_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])) * sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])))"


@query("nearest_references", f"""WITH n AS (SELECT g.vec_id AS gold_id, r.vec_id AS ref_id, {NEAR_SQL} AS near FROM embeddings g JOIN embeddings r ON g.label % 5 = r.label % 5 AND g.vec_id <> r.vec_id WHERE g.{GOLD})
  SELECT gold_id, ref_id, round(near, 6) AS near, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY near DESC, ref_id) AS place FROM n) WHERE place <= 5""")
def nearest_references(spark, d):
    """The five nearest of the same platform for every row whose id is divisible by 50, against all rows."""
    rows = vectors(spark, d)
    return similarity.nearest_references(rows.filter("id % 50 = 0"), rows).withColumn("near", F.round("near", 6))


@query("anchor_verticals", "WITH a AS (SELECT i, [CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0 END FOR k IN range(0, 64)] AS v FROM (SELECT unnest(range(0, 8)) AS i)), n AS (SELECT vec_id, i, list_inner_product(embedding::DOUBLE[], v) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS near FROM embeddings, a), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY near DESC, i) AS p FROM n) SELECT vec_id AS id, round(near, 6) AS near, CASE WHEN near >= 0.28::DOUBLE THEN 'anchor-' || CAST(i AS VARCHAR) ELSE 'unknown' END AS anchor FROM b WHERE p = 1")
def anchor_verticals(spark, d):
    anchors = [(f"anchor-{i}", [1.0 if k == i else 0.0 for k in range(64)]) for i in range(8)]
    return similarity.argmax_cosine(vectors(spark, d), "vector", anchors).select("id", F.round("near", 6).alias("near"), "anchor")


@query("reference_corpus", f"""WITH {V3_SQL}, b AS (SELECT ad_id, platform, {STRIP("vertical || ' ' || CAST(advertiser_id AS VARCHAR)")} AS blob FROM tiered WHERE tier = 'high'), o AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY CAST(ad_id AS BIGINT)) AS i FROM b), h AS (SELECT DISTINCT 'furniture ' || CAST(c_custkey AS VARCHAR) AS t FROM customer),
  k AS (SELECT * FROM o WHERE i = 1 AND blob NOT IN (SELECT t FROM h)) SELECT platform, count(*) AS n FROM (SELECT 'ALL' AS platform FROM k UNION ALL SELECT platform FROM k) GROUP BY platform""")
def reference_corpus(spark, d):
    rows = scored(spark, d, "ad_id", "platform", "vertical", "advertiser_id").select(F.col("ad_id").cast("long").alias("order"), "platform", "tier", copy.blob(F.concat_ws(" ", "vertical", F.col("advertiser_id").cast("string"))).alias("blob"))
    held = table(spark, d, "customer").select(F.concat(F.lit(" Furniture  "), F.col("c_custkey").cast("string")).alias("text"))
    return similarity.reference_corpus(rows, held)[0].groupBy("platform").agg(F.count("*").alias("n"))


@query("reference_metrics")
def reference_metrics(spark, d):
    """The second reply of each conversation against the first as gold, and against all others but itself."""
    said = table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    pairs = said.filter(F.size("m") >= 2).select("conv_id", F.get("m", F.lit(1))["text"].alias("text"), F.get("m", F.lit(0))["text"].alias("gold"), F.transform(F.filter("m", lambda x, i: i != 1), lambda x: x["text"]).alias("others"))
    made = similarity.with_reference_metrics(pairs, "text", "gold", "others")
    return made.select("conv_id", *[F.round(c, 6).alias(c) for c in made.columns if c.endswith(("_gold", "_multi", "excess"))])


@query("ab_grounding")
def ab_grounding(spark, d):
    """Headlines of three documents each as variants of a test: how often the winner is more like the winners of other tests than a loser is."""
    ads_ = text_ads(spark, d).select(F.expr("doc_id div 3").cast("string").alias("test_id"), (F.col("doc_id") % 3).cast("string").alias("variant"), (F.length("body") + 200).alias("impressions"), (F.length("headline") % 97).alias("clicks"), "headline")
    keyed = ads_.select(F.col("test_id").alias("_t"), F.col("variant").alias("_v"), F.col("headline").alias("text"))
    tests = ab_tests(ads_.drop("headline")).join(keyed, (F.col("test_id") == F.col("_t")) & (F.col("variant") == F.col("_v"))).drop("_t", "_v")
    return grounding.grounded_accuracy(materialise(tests, "ab-texts"))


@query("metric_summary")
def metric_summary(spark, d):
    """Mean and median of each score; scores that are not there stay null."""
    from copperleaf.operators.statistics import summary

    rows = materialise(reference_metrics(spark, d).withColumn("config", F.lit("all")), "metrics")
    return summary(rows, [c for c in rows.columns if c not in ("conv_id", "config")], ["config"])


@query("text_divergence")
def text_divergence(spark, d):
    """How near the vectors of even labels are to those of odd ones."""
    from copperleaf.operators.divergence import divergence

    return divergence(vectors(spark, d).withColumn("side", F.col("label") % 2 == 0), "vector", "side", clusters=16)


@query("eligible_ads", f"""{T}, e AS (SELECT ad_id, vertical, length({STRIP('headline')}) + length({STRIP('body')}) AS n, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score, CASE WHEN training_quality = 0 THEN 0.4::DOUBLE ELSE 0.9 END AS confidence FROM tads)
  SELECT ad_id, vertical, score FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY score DESC, ad_id) AS p FROM e WHERE score >= 0.7::DOUBLE AND n >= 60 AND confidence >= 0.5::DOUBLE) WHERE p <= 20""")
def eligible_ads(spark, d):
    """Ads with a score, enough copy and a vertical that is sure enough, the best 20 of each vertical (the reference's cap)."""
    rows = text_ads(spark, d).withColumns({"score": (F.col("doc_id") * 7919 % 1000) / 1000.0, "business_vertical_confidence": F.when(F.col("training_quality") == 0, 0.4).otherwise(0.9)})
    return construct.eligible(rows, F.col("headline"), F.col("body"), floor=0.7, cap=20).select("ad_id", "vertical", "score")


# -- records


@query("rendered_records", """SELECT conv_id AS example_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS rendered, count(*) AS turns FROM conversations GROUP BY conv_id""")
def rendered_records(spark, d):
    """Each conversation as a record of a dataset, as a chat template writes it."""
    none = F.lit(None).cast("string")
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    rows = chats.select(F.col("conv_id").alias("example_id"), F.lit("copywriting").alias("task_format"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"), none.alias("platform"), none.alias("vertical"), F.array().cast("array<string>").alias("source_tiers"), none.alias("construction_model"))
    return records.dataset_records(rows).select("example_id", F.md5(records.rendered("messages")).alias("rendered"), F.size("messages").cast("long").alias("turns"))


@query("divergence_summary", """WITH m AS (SELECT event_type AS config, user_id % 20 AS platform, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value::DOUBLE END AS mauve, value::DOUBLE - 1 AS ci_low, value::DOUBLE + 1 AS ci_high, event_id % 7 AS n_gen FROM events), g AS (SELECT config, platform, count(*) AS n, bool_or(isnan(mauve)) AS bad,
  avg(mauve) FILTER (NOT isnan(mauve)) AS mean, median(mauve) FILTER (NOT isnan(mauve)) AS middle, min(mauve) FILTER (NOT isnan(mauve)) AS low, max(mauve) FILTER (NOT isnan(mauve)) AS high, avg(ci_low) AS ci_low_mean, avg(ci_high) AS ci_high_mean, CAST(sum(n_gen) AS BIGINT) AS n_gen_total FROM m GROUP BY ALL)
  SELECT config, platform, n, CASE WHEN bad THEN 'nan'::DOUBLE ELSE round(mean, 6) END AS mauve_mean, CASE WHEN bad THEN 'nan'::DOUBLE ELSE round(middle, 6) END AS mauve_median, coalesce(round(low, 6), CASE WHEN bad THEN 'nan'::DOUBLE END) AS mauve_min, coalesce(round(high, 6), CASE WHEN bad THEN 'nan'::DOUBLE END) AS mauve_max,
  round(ci_low_mean, 6) AS ci_low_mean, round(ci_high_mean, 6) AS ci_high_mean, n_gen_total FROM g""")
def divergence_summary(spark, d):
    """Values of events by type and a part of the users; some are no numbers."""
    value = F.col("value").cast("double")
    rows = table(spark, d, "events").select(F.col("event_type").alias("config"), (F.col("user_id") % 20).alias("platform"), F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(value).alias("mauve"), (value - 1).alias("ci_low"), (value + 1).alias("ci_high"), (F.col("event_id") % 7).alias("n_gen"))
    made = records.divergence_summary(rows, ["config", "platform"])
    return made.withColumns({c: F.round(c, 6) for c in made.columns if c.startswith(("mauve_", "ci_"))})
