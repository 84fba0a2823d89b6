"""Raw ads of each provider as canonical rows. A raw ad is one JSON text; it is parsed once, as a variant.

A value that is missing, null or empty gives way to the next of its kind, and so does a count of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions.derived import any_date, bound, bucket_bounds

# Names of platforms and formats at the providers.
ADFLEX_PLATFORMS = {"facebook": "facebook", "tiktok": "tiktok", "x": "twitter", "pinterest": "pinterest", "reddit": "reddit"}
ADFLEX_FORMATS = ["image", "video", "carousel"]
BIGSPY_PLATFORMS = ["facebook", "instagram", "tiktok", "youtube", "google", "linkedin", "pinterest", "twitter"]
BIGSPY_FORMATS = ["image", "video", "carousel", "collection"]
COUNTS = ["likes", "comments", "shares", "reactions", "views"]
TEXTS = ["headline", "body", "description", "cta", "creative_url", "advertiser_id", "advertiser_name", "landing_page_url"]


def at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def text(*paths: str) -> Column:
    """The first that is there and not empty, else empty."""
    return F.coalesce(*[F.nullif(at(p), F.lit("")) for p in paths], F.lit(""))


def count(*paths: str) -> Column:
    """The first that is there and not 0, else 0."""
    return F.coalesce(*[F.nullif(at(p, "bigint"), F.lit(0)) for p in paths], F.lit(0)).cast("long")


def listed(path: str, field: str | None = None) -> Column:
    """The texts of a list that are not empty; of its objects, a field."""
    items = F.coalesce(F.try_variant_get("v", f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    said = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, f"$.{field}", "string"), F.lit("")) if field else F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    return F.filter(said, lambda x: x != "")


def length(path: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get("v", f"$.{path}", "array<variant>")), F.lit(0))


def named(value: Column, names: dict[str, str] | list[str], otherwise: str = "other") -> Column:
    pairs = names if isinstance(names, dict) else {n: n for n in names}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[F.lower(value)], F.lit(otherwise))


def ads(raw: DataFrame, json: str, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Canonical rows: what a provider does not say is empty, 0 or null by its kind."""
    parsed = raw.withColumn("v", F.try_parse_json(F.col(json)))
    empty = F.array().cast("array<string>")
    filled = {c: F.lit("") for c in TEXTS} | {c: F.lit(0).cast("long") for c in COUNTS} | {"country": empty, "placements": empty, "vertical": F.lit(""), "creative_format": F.lit("other")}
    filled |= {c: F.lit(None).cast("date") for c in ("first_seen", "last_seen")} | {c: F.lit(None).cast("long") for c in ("active_days", "spend_lower", "spend_upper", "impression_lower", "impression_upper")}
    return parsed.select(*(keep or []), *[c.alias(n) for n, c in (filled | columns).items()])


def adflex(raw: DataFrame, json: str = "json", platform: Column | str = "facebook", keep: list[str] | None = None) -> DataFrame:
    """Engagement is called otherwise on each platform; more than one attachment is a carousel."""
    kind = F.when(length("attachments") > 1, "carousel").otherwise(named(F.coalesce(at("attachments[0].type"), F.lit("")), ADFLEX_FORMATS))
    return ads(
        raw, json, keep, ad_id=text("id"), source=F.lit("adflex"), platform=named(F.lit(platform) if isinstance(platform, str) else platform, ADFLEX_PLATFORMS), headline=text("title"),
        body=text("attachments[0].subtitle"), description=text("description", "attachments[0].description"), creative_format=kind, creative_url=text("attachments[0].files.main"),
        country=listed("locations", "code"), placements=listed("placements", "label"), last_seen=any_date(at("updated_at")), active_days=at("active_days", "bigint"),
        likes=count("engagements.reactions", "engagements.likes"), comments=count("engagements.comments", "engagements.replies"), shares=count("engagements.shares", "engagements.reposts", "engagements.repins"),
        views=count("engagements.views", "engagements.plays"), reactions=count("engagements.saves", "engagements.favorites", "engagements.upvotes"),
        advertiser_id=text("owner.id"), advertiser_name=text("owner.name"), landing_page_url=text("display_site_url", "display_url"),
    )


def with_detail(base: DataFrame, details: DataFrame, json: str = "json", key: str = "ad_id") -> DataFrame:
    """``base`` with what the detail answers say; what they leave out or empty stays. details: (ad_id, JSON text), at most one for an ad."""
    one = details.withColumn("v", F.try_parse_json(F.col(json)))
    inner = "data.ad"
    found = one.select(
        F.col(key).alias("_key"), F.nullif(text(f"{inner}.cta"), F.lit("")).alias("_cta"), F.nullif(count(f"{inner}.impressions"), F.lit(0)).alias("_impressions"),
        any_date(at(f"{inner}.first_seen_at")).alias("_first"), any_date(at(f"{inner}.last_seen_at")).alias("_last"), listed(f"{inner}.interests", "name").alias("_interests"),
    )
    joined = base.join(found, F.col(key) == F.col("_key"), "left")
    made = {"cta": F.coalesce("_cta", "cta"), "impressions": F.col("_impressions"), "first_seen": F.coalesce("_first", "first_seen"), "last_seen": F.coalesce("_last", "last_seen"), "interests": F.coalesce("_interests", F.array().cast("array<string>"))}
    return joined.withColumns(made).drop("_key", "_cta", "_impressions", "_first", "_last", "_interests")


def meta_library(raw: DataFrame, json: str = "json", country: str = "", keep: list[str] | None = None) -> DataFrame:
    """Videos come before images, and those before cards; the body is a text or an object that holds one."""
    some = lambda k: (length(k) > 0) | (length(f"snapshot.{k}") > 0)
    kind = F.when(some("videos"), "video").when(some("images"), "image").when(some("cards"), "carousel").otherwise("other")
    first = F.lower(F.coalesce(at("publisherPlatform[0]"), at("publisherPlatform"), at("publisherPlatforms[0]"), at("publisherPlatforms"), F.lit("")))
    plain = lambda p: F.when(~F.coalesce(at(p), F.lit("")).startswith("{"), at(p))
    inside = lambda p: F.coalesce(at(f"{p}.text"), at(f"{p}.markup"), plain(p))
    limit = lambda p: F.coalesce(at(p, "bigint"), bound(at(p)))
    where = F.array(F.lit(country)) if country else F.when(length("country") > 0, listed("country")).otherwise(F.filter(F.array(text("country")), lambda x: x != ""))
    return ads(
        raw, json, keep, ad_id=text("adArchiveID", "id"), source=F.lit("meta_library"), platform=F.when(first.contains("instagram"), "instagram").otherwise("facebook"),
        headline=text("snapshot.title", "title", "snapshot.link_title"), body=F.coalesce(inside("snapshot.body"), inside("body"), F.lit("")), description=text("snapshot.link_description", "linkDescription"), cta=text("snapshot.cta_text", "ctaText"),
        creative_format=kind, creative_url=text("snapshot.images[0].url", "snapshot.images[0].original_image_url", "images[0].url", "images[0].original_image_url"), country=where,
        first_seen=any_date(at("startDate")), last_seen=any_date(at("endDate")), spend_lower=limit("spend.lower_bound"), spend_upper=limit("spend.upper_bound"),
        impression_lower=limit("impressions.lower_bound"), impression_upper=limit("impressions.upper_bound"), advertiser_id=text("pageID", "pageId"), advertiser_name=text("pageName"), landing_page_url=text("snapshot.link_url", "linkUrl"),
    )


def tiktok_library(raw: DataFrame, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    return ads(
        raw, json, keep, ad_id=text("adId", "id"), source=F.lit("tiktok_library"), platform=F.lit("tiktok"), headline=text("title"), body=text("caption", "text"), cta=text("callToAction"),
        creative_format=F.when(F.lower(text("adFormat")) == "image", "image").otherwise("video"), creative_url=text("videoUrl", "imageUrl"), country=F.when(length("targetRegions") > 0, listed("targetRegions")).otherwise(listed("regions")),
        first_seen=any_date(F.coalesce(at("firstShown"), at("createTime"))), last_seen=any_date(F.coalesce(at("lastShown"), at("updateTime"))), likes=count("likes"), comments=count("comments"), shares=count("shares"),
        advertiser_id=text("advertiserId"), advertiser_name=text("advertiserName"), landing_page_url=text("landingPageUrl"),
    )


def google_transparency(raw: DataFrame, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    kind = reduce(lambda made, k: F.when(F.lower(text("format")).contains(k), k).otherwise(made), ["text", "image", "video"], F.lit("other"))
    codes = F.when(F.size(listed("regions", "code")) > 0, listed("regions", "code")).otherwise(listed("regions"))
    return ads(
        raw, json, keep, ad_id=text("ad_id", "creative_id"), source=F.lit("google_transparency"), platform=F.lit("google"), headline=text("title"), body=text("text"), description=text("description"), creative_format=kind,
        creative_url=text("image_url"), country=codes, first_seen=any_date(at("first_shown")), last_seen=any_date(at("last_shown")), advertiser_id=text("advertiser_id"), advertiser_name=text("advertiser_name"), landing_page_url=text("destination_url"),
    )


def bigspy(raw: DataFrame, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    return ads(
        raw, json, keep, ad_id=text("ad_id", "id"), source=F.lit("bigspy"), platform=named(text("platform"), BIGSPY_PLATFORMS), headline=text("title"), body=text("content"), description=text("description"), cta=text("call_to_action"),
        creative_format=named(text("creative_type"), BIGSPY_FORMATS), creative_url=text("creative_url"), country=F.filter(F.array(text("country")), lambda x: x != ""), vertical=text("industry"),
        first_seen=any_date(F.nullif(text("first_seen_at", "created_at"), F.lit(""))), last_seen=any_date(F.nullif(text("last_seen_at", "updated_at"), F.lit(""))), likes=count("likes"), comments=count("comments"), shares=count("shares"),
        advertiser_id=text("advertiser_id", "page_id"), advertiser_name=text("advertiser_name", "page_name"), landing_page_url=text("landing_page"),
    )


def political(rows: DataFrame) -> DataFrame:
    """Rows of the public table of political ads: (ad_id, advertiser_id, advertiser_name, ad_type, ad_url, impressions as a bucket, spend bounds, dates, days)."""
    low, high = bucket_bounds(F.col("impressions"))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.filter(said("ad_id") != "").select(
        "ad_id", F.lit("google_transparency").alias("source"), F.lit("google").alias("platform"), said("advertiser_name").alias("headline"), said("ad_type").alias("body"), said("advertiser_id").alias("advertiser_id"), said("advertiser_name").alias("advertiser_name"),
        any_date(F.col("date_range_start").cast("string")).alias("first_seen"), any_date(F.col("date_range_end").cast("string")).alias("last_seen"), F.col("num_of_days").cast("long").alias("active_days"),
        F.col("spend_range_min_usd").cast("long").alias("spend_lower"), F.col("spend_range_max_usd").cast("long").alias("spend_upper"), low.alias("impression_lower"), high.alias("impression_upper"), said("ad_url").alias("landing_page_url"),
    )


# Fixed value: the year's rate of a rouble in dollars.
ROUBLE_2016 = 1 / 65


def archive(rows: DataFrame) -> DataFrame:
    """Rows of the released CSV, with its impressions as views, and the performance that scores are held against; only ads that were seen."""
    shown, clicked, cost = F.col("impressions").try_cast("bigint"), F.coalesce(F.col("clicks").try_cast("bigint"), F.lit(0)), F.col("cost").try_cast("double") * ROUBLE_2016
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.filter((said("id") != "") & (shown > 0)).select(
        F.col("id").alias("ad_id"), F.lit("facebook").alias("platform"), said("title").alias("headline"), said("description").alias("body"), any_date(F.col("created")).alias("first_seen"), any_date(F.col("ended")).alias("last_seen"),
        shown.alias("views"), clicked.alias("clicks"), cost.alias("cost_usd"), F.log1p(shown.cast("double")).alias("log_impressions"), F.log1p(clicked.cast("double")).alias("log_clicks"), F.when(cost > 0, F.log1p(cost)).alias("log_cost"),
    )
