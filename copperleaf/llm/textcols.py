"""Columns and patterns that several of these operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(*cols: Column) -> Column:
    """64 bits of the given columns, nulls told from empty strings."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])
