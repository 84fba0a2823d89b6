"""Derived columns of an ad, and tolerant parsing of dates, numbers and ranges. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """top / bottom where bottom is above 0, else null or ``otherwise``."""
    ratio = F.when(bottom > 0, top / bottom)
    return ratio if otherwise is None else ratio.otherwise(otherwise)


def with_features(ads: DataFrame) -> DataFrame:
    """Longevity (the days that a source counts itself, else from first to last seen), engagement, weighted engagement
    and their velocities per day."""
    days = F.coalesce(F.col("active_days"), F.datediff("last_seen", "first_seen")).cast("long")
    total = F.col("likes") + F.col("comments") + F.col("shares") + F.col("reactions") + F.col("views")
    weighted = (5.0 * F.col("shares") + 3.0 * F.col("comments") + F.col("likes") + F.col("reactions")) + 0.1 * F.col("views")
    known = ads.withColumns({"longevity_days": days, "total_engagement": total, "weighted_engagement": weighted})
    return known.withColumns({
        "weighted_velocity": guarded(F.col("weighted_engagement"), F.col("longevity_days")),
        "velocity": guarded(F.col("total_engagement").cast("double"), F.col("longevity_days")),
    })


# Times as ISO 8601 has them behind a date, and the dates themselves: with hyphens, without, and by weeks.
_HOURS = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?|[0-5]\d([0-5]\d([.,]\d+)?)?)?"
_TIME = rf"(?:.{_HOURS}([+-]{_HOURS})?)?"
#: Seconds of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def _week_date(text: Column) -> Column:
    year, week = F.substring(text, 1, 4).try_cast("int"), F.regexp_extract(text, r"W(\d{2})", 1).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, r"W\d{2}-?([1-7])", 1).try_cast("int"), F.lit(1))
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.when((year > 0) & week.between(1, F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))), F.date_add(first, (week - 1) * 7 + day - 1))


def any_date(text: Column) -> Column:
    """An ISO date, with or without hyphens or by weeks and with or without a time, of which the date stands as it is; then y/m/d, d-m-y and m/d/y, whose
    days and months may have one digit; then seconds since 1970, as far as the years 1 to 9999 go; else null."""
    zoned = F.replace(text, F.lit("Z"), F.lit("+00:00"))

    def plain(x: Column, form: str) -> Column:
        made = F.try_to_timestamp(x, F.lit(form)).cast("date")
        return F.when(F.year(made) > 0, made)

    tried = [
        F.when(zoned.rlike(rf"(?s)\A\d{{4}}-\d\d-\d\d{_TIME}\z"), plain(F.substring(zoned, 1, 10), "yyyy-MM-dd")), F.when(zoned.rlike(rf"(?s)\A\d{{8}}{_TIME}\z"), plain(F.substring(zoned, 1, 8), "yyyyMMdd")),
        F.when(zoned.rlike(rf"(?s)\A\d{{4}}(-W\d\d(-[1-7])?|W\d\d[1-7]?){_TIME}\z"), _week_date(F.substring(zoned, 1, 10))),
    ]
    shapes = {r"\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d", r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d", r"\d{1,2}-\d{1,2}-\d{4}": "d-M-yyyy", r"\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy"}
    tried += [F.when(text.rlike(rf"\A{shape}\z"), plain(text, form)) for shape, form in shapes.items()]
    seconds = F.when(F.trim(text).rlike(r"\A[+-]?0*\d{1,12}(\.\d+)?\z"), F.floor(F.trim(text).try_cast("double")))
    days = F.floor(F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds) / 86400)
    return F.coalesce(*tried, F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))


def bound(text: Column) -> Column:
    """A whole number with thousands separators, or null."""
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def bucket_bounds(text: Column) -> tuple[Column, Column]:
    """Lower and upper end of '1000-2000', '<1000', '≤1000', '1000+', '>1000', '≥1000' or '1000'; no separators count."""
    clean = F.regexp_replace(text, r"[,\s]", "")
    pair = clean.rlike(r"^\d+-\d+$")
    first, second = (F.split_part(clean, F.lit("-"), F.lit(i)).try_cast("bigint") for i in (1, 2))
    digits = F.regexp_replace(clean, r"[^0-9]", "").try_cast("bigint")
    upper, lower = clean.rlike(r"^[<≤]+\d+$"), clean.rlike(r"^([>≥]+\d+|\d+\++)$")
    single = clean.rlike(r"^\d+$")
    low = F.when(pair, first).when(upper, F.lit(0).cast("long")).when(lower | single, digits)
    return low, F.when(pair, second).when(upper | single, digits)


def log_midpoint(low: Column, high: Column) -> Column:
    """log1p of the middle of two bounds, or of the one that is there; null unless above 0."""
    middle = F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"))
    return F.when(middle > 0, F.log1p(middle))
