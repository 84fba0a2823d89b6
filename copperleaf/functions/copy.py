"""Copy of ads and answers: cleaning, wrapping, resolving, keys, hosts and names. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from copperleaf.functions.text import once, stripped, stripped_or_null

# What surrounds copy in an answer, in the order in which it is taken away; and the marks of a failed extraction.
THINK_BLOCK = r"(?is)<think\b[^>]*>.*?</think>"
LEADING_HEADER = r"(?i)^\s*\*{1,3}\s*(?:Ad\s*Copy|Copy|Final\s*Copy|Output|Response|Answer|Result)\s*[:.\-]?\s*\*{1,3}\s*\n+"
PREAMBLE = (
    r"(?i)^\s*(?:here(?:'s|\s+is)\s+(?:a|an|the|my|your|some|one|my\s+take|the\s+ad|the\s+copy|the\s+execution)[^\n]{0,80}[:.]\s*\n+"
    r"|sure[!,]?\s+(?:here|let|i)[^\n]{0,80}[:.\n]\s*\n+"
    r"|(?:below|above)\s+is[^\n]{0,80}[:.\n]\s*\n+"
    r"|i(?:'ll|\s+will|'ve|\s+have)?\s+(?:write|craft|draft|put\s+together|come\s+up\s+with|create)[^\n]{0,80}[:.\n]\s*\n+)"
)
TRAILING_META = (
    r"(?is)\n\s*(?:\*{0,3}\s*(?:why\s+this\s+works|rationale|analysis|notes?|why|reasoning|explanation)\s*[:.]?\s*\*{0,3}"
    r"|\*{0,3}\s*(?:strategy|approach|angle|audience)\s*[:.]\s*\*{0,3}).*\z"
)
EXTRACTION_FAILED, NO_COPY = "<EXTRACTION_FAILED>", "[Model produced no usable ad copy.]"
PLATFORM_ALIASES = {"meta": "facebook", "x": "twitter"}
PROVIDER_WORDS = {"claude": ["claude", "anthropic"], "gpt": ["gpt", "openai", "o1", "o3"], "gemini": ["gemini", "google"]}
CAMPAIGN_ORDER = ["title", "headline", "headlines", "long_headline", "primary_text", "text", "body", "description", "descriptions", "caption", "cta_label", "cta"]
CAMPAIGN_HIDDEN = [
    "platform", "final_url", "destination_url", "url", "asset_brief", "asset_image_url", "asset_url", "image_url", "video_brief", "image_brief", "display_name", "account", "handle", "username",
    "business_name", "path1", "path2", "meta", "requirements_check", "craft", "predicted_score", "predicted_scores", "violations", "brand", "brand_assets", "score", "scores",
]
RUN_ID, CONFIG_NAME = r"^\d{4}-\d{2}-\d{2}-[a-z0-9][a-z0-9-]*$", r"^[A-Za-z0-9_]+(@[A-Za-z0-9_-]+)?$"


def clean_copy(raw: Column) -> Column:
    """Without thinking, a header on its own line, a preamble, and remarks at the end. Null and empty stay."""
    text = F.regexp_replace(raw, THINK_BLOCK, "")
    left = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    for _ in range(2):
        text = F.regexp_replace(left(F.regexp_replace(left(text), LEADING_HEADER, "")), PREAMBLE, "")
    return F.when(F.coalesce(raw, F.lit("")) == "", raw).otherwise(stripped(F.regexp_replace(text, TRAILING_META, "")))


def unwrapped(text: Column) -> Column:
    """Without a code fence and then double quotes, each only where both ends have it."""
    t = stripped(text)
    lines = F.split(t, "\n")
    fenced = t.startswith("```") & t.endswith("```") & (F.size(lines) >= 2)
    t = F.when(fenced, stripped(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 2)), "\n"))).otherwise(t)
    quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    return F.when(quoted, stripped(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first pair of tags; empty without."""
    return stripped(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def blob(*fields: Column) -> Column:
    """The fields that are not blank, as they are, a line break between."""
    return F.array_join(F.array_compact(F.array(*[F.when(stripped(f) != "", f) for f in fields])), "\n")


def resolved(clean: Column, raw: Column) -> tuple[Column, Column]:
    """(text, used_clean): the cleaned text where there is one, nothing where cleaning failed, else the raw text."""
    return F.when(clean == EXTRACTION_FAILED, "").otherwise(F.coalesce(clean, raw, F.lit(""))), clean.isNotNull()


def judge_input(clean: Column, raw: Column) -> Column:
    return F.when(clean == EXTRACTION_FAILED, NO_COPY).otherwise(F.coalesce(clean, clean_copy(raw)))


def is_clean_record(text: Column) -> Column:
    return F.coalesce((stripped(text) != "") & ~text.contains(EXTRACTION_FAILED), F.lit(False))


def business_category(business: Column, vertical: Column) -> Column:
    """The business vertical, else what follows the last colon of the vertical."""
    return F.coalesce(F.nullif(business, F.lit("")), F.element_at(F.split(F.coalesce(vertical, F.lit("")), ":"), -1))


def vertical_key(business: Column, vertical: Column) -> Column:
    return F.coalesce(F.nullif(business, F.lit("")), vertical, F.lit(""))


def cluster_platform(vertical: Column, modal: Column) -> Column:
    """A vertical with a colon says its platform itself."""
    return F.when(vertical.contains(":"), F.split_part(vertical, F.lit(":"), F.lit(1))).otherwise(modal)


def platform_alias(platform: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PLATFORM_ALIASES.items() for x in kv])[platform], platform)


def ad_shape(body: Column, description: Column, least: int = 10) -> Column:
    return F.when((F.length(stripped(body)) >= least) | (F.length(stripped(description)) >= least), "has_body").otherwise("headline_only")


def provider(model: Column) -> Column:
    said = F.lower(F.coalesce(model, F.lit("")))
    made = F.lit("unknown")
    for name, words in reversed(PROVIDER_WORDS.items()):
        made = F.when(reduce(lambda a, b: a | b, [said.contains(w) for w in words]), name).otherwise(made)
    return made


def host(url: Column) -> Column:
    """Of an address with or without a scheme, in lower case and without user and port; empty where there is none. What stands behind the
    host may be of any form, as in the addresses of ads."""
    raw = F.translate(stripped(url), "\t\r\n", "")
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    place = F.regexp_replace(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    bare = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.split_part(place, F.lit(":"), F.lit(1)))
    return F.lower(F.coalesce(bare, F.lit("")))


def on_domain(url: Column, fragment: Column) -> Column:
    """The host is the fragment or below it; a fragment with a path is looked for in the whole address."""
    frag, at = F.lower(fragment), host(url)
    return F.coalesce(F.when(frag.contains("/"), F.lower(url).contains(frag)).otherwise((at == frag) | at.endswith(F.concat(F.lit("."), frag))), F.lit(False))


def with_query(base: str, **params: Column) -> Column:
    """An address with its parameters; those that are null are left out."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]))


def is_gold(config: Column) -> Column:
    return config.rlike("^GOLD(_|$)")


def variant_parts(config: Column) -> tuple[Column, Column]:
    """(base, variant) of a configuration's name; a null variant without one. A name of another form raises."""
    fine = F.when(config.rlike(CONFIG_NAME), config).otherwise(F.raise_error(F.concat(F.lit("no name of a configuration: "), config)).cast("string"))
    return F.split_part(fine, F.lit("@"), F.lit(1)), F.nullif(F.split_part(fine, F.lit("@"), F.lit(2)), F.lit(""))


def campaign_copy(campaign: Column, hidden: list[str] = CAMPAIGN_HIDDEN) -> Column:
    """campaign: a map of texts and JSON lists of texts. Its copy: the known keys in reading order, then the others as the map has them, without
    the hidden ones; blank texts left out, a blank line between."""
    known = F.array(*map(F.lit, CAMPAIGN_ORDER))
    rest = F.filter(F.map_keys(campaign), lambda k: ~F.array_contains(known, k))
    keys = F.filter(F.concat(known, rest), lambda k: ~k.isin(*hidden) & F.map_contains_key(campaign, k))
    texts = F.flatten(F.transform(keys, lambda k: F.coalesce(F.from_json(F.when(F.element_at(campaign, k).startswith("["), F.element_at(campaign, k)), "array<string>"), F.array(F.element_at(campaign, k)))))
    return F.array_join(F.filter(F.transform(texts, stripped), lambda x: x != ""), "\n\n")


def main_text(html: Column) -> Column:
    """Readable text of a page: without head, script, style, navigation, comments and tags, blocks on lines of their own, a few entities
    put back. Patterns, not a parser: a built-in function at any scale."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|footer|header|aside|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, sign in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n\s*", "\n"))


# Frequent short words that tell four languages apart.
FREQUENT = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "you", "this"], "de": ["der", "die", "und", "das", "nicht", "ist", "ein", "zu", "den", "mit", "sich", "auf"],
    "fr": ["le", "la", "les", "et", "des", "est", "un", "une", "que", "dans", "pour", "qui"], "es": ["el", "los", "las", "y", "es", "una", "que", "por", "con", "para", "del", "se"],
}


def language(*fields: Column, least: int = 12) -> Column:
    """The language most of whose frequent words are among the words; empty for short text, and where none or two are first."""
    said = F.lower(stripped(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields])))
    any_of = sorted({w for words in FREQUENT.values() for w in words})

    def tally(said: Column) -> Column:
        known = F.filter(F.split(said, r"[^\p{L}]+"), lambda w: w.isin(*any_of))
        return once(known, lambda k: F.array(*[F.struct(F.size(F.filter(k, lambda w: w.isin(*v))).alias("n"), F.lit(lang).alias("lang")) for lang, v in FREQUENT.items()]))  # noqa: B023

    def first(counts: Column) -> Column:
        best = F.array_max(F.transform(counts, lambda c: c["n"]))
        return once(best, lambda n: once(F.filter(counts, lambda c: c["n"] == n), lambda top: F.when((n == 0) | (F.size(top) > 1), "").otherwise(F.get(top, F.lit(0))["lang"])))

    return once(said, lambda s: F.when(F.length(s) < least, "").otherwise(once(tally(s), first)))


def safety(text: Column, lang: Column, bad_words: list[str]) -> tuple[Column, Column]:
    """(level, words): empty text, other languages and clean text pass; else the distinct words of the list that are in it, in order."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}']+"), lambda w: w.isin(*bad_words)))
    level = F.when(stripped(text) == "", "L0_empty").when(F.coalesce(lang, F.lit("")).isin("", "en"), F.when(F.size(words) > 0, "L1_wordlist").otherwise("L0_clean")).otherwise("L0_skip_lang")
    return level, F.when(level == "L1_wordlist", F.array_sort(words)).otherwise(F.array().cast("array<string>"))


def label_of_answer(line: Column) -> Column:
    """struct(ad_id, vertical, confidence, training_quality) of one line of a batch's output, whose answer is JSON inside JSON; null where
    it cannot be read."""
    v = F.try_parse_json(line)
    inner = F.try_parse_json(F.try_variant_get(v, "$.response.body.choices[0].message.content", "string"))
    made = F.struct(
        F.try_variant_get(v, "$.custom_id", "string").alias("ad_id"), F.try_variant_get(inner, "$.vertical", "string").alias("vertical"),
        F.coalesce(F.try_variant_get(inner, "$.confidence", "double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.try_variant_get(inner, "$.training_quality", "int"), F.lit(0)).alias("training_quality"),
    )
    return F.when(made["ad_id"].isNotNull() & made["vertical"].isNotNull(), made)


def stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped_or_null), lambda x: x != "")
