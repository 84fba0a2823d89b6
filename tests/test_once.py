"""Costly columns are computed once for a row, and patterns only where they can match."""

import re

from pyspark.sql import functions as F

from copperleaf.functions import copy, text
from copperleaf.operators import inputs


def test_language_and_facts_ask_for_their_text_once(spark):
    assert str(copy.language(F.col("said"))).count("said") == 1
    assert str(inputs.ad_facts(F.col("who"), F.col("said"))).count("said") == 1
    rows = [(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, "que que que que"), (4, "the der"), (5, "the"), (6, None), (7, "  you and this, 12 times  ")]
    got = {r["i"]: r["l"] for r in spark.createDataFrame(rows, "i int, t string").select("i", copy.language(F.col("t")).alias("l")).collect()}
    assert got == {1: "en", 2: "de", 3: "", 4: "", 5: "", 6: "", 7: "en"}
    facts = spark.createDataFrame(rows, "i int, t string").select("i", inputs.ad_facts(F.lit(""), F.col("t"), F.lit(" x ")).alias("f")).collect()
    said = {r["i"]: re.sub(r"(?s).*reads:\n\n", "", r["f"]) for r in facts}
    assert said[2] == "x" and said[7] == "you and this, 12 times\n\nx" and said[6] == "x"


def test_scripture_is_looked_for_once_and_signs_lose_nothing(spark):
    assert str(text.scripture_reason(F.col("said"))).count("said") == 1
    rows = [
        ("see 1 JOHN 3:16 now", "bible_verse_citation"), ("see John ٣:١٦", "bible_verse_citation"), ("at 10:30", None), ("{ م }", "arabic_brace_quotation"), ("{ a }", None),
        ("Holy Scrİpture", "explicit_scripture_term"), ("the toraK", None), ("Koran", "explicit_scripture_term"), ("New Teſtament", "explicit_scripture_term"), ("testament", None),
        ("For God so loved the world", "canonical_scripture_phrase"), ("blėssed are the meek", None), ("Blessed are the MEEK", "canonical_scripture_phrase"), ("Subhana Allah", "canonical_scripture_phrase"),
        ("﴿ a ﴾", "arabic_brace_quotation"), ("﴾ a ﴿", None), ("﴿ a ﴿", None), ("aِbِcِdِ", "diacritized_arabic"), ("Peace be upon hım", "canonical_scripture_phrase"), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    direct = F.when(F.regexp_count(F.coalesce("t", F.lit("")), F.lit(text.DIACRITICS)) >= 4, "diacritized_arabic")
    for name, pattern in text.SCRIPTURE:
        direct = direct.when(F.coalesce("t", F.lit("")).rlike(text.unicode(pattern)), name)
    got = df.select("i", text.scripture_reason(F.col("t")).alias("r"), direct.alias("d")).orderBy("i").collect()
    assert [r["r"] for r in got] == [r["d"] for r in got]
    assert [r["r"] for r in got if rows[r["i"]][1]] == [w for _, w in rows if w]


def test_what_a_pattern_takes_for_a_letter(spark):
    """Only these signs beside A-Z are letters to a pattern without case; the signs looked for are in their plain form."""
    df = spark.range(0x80, 0x10000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    letters = "|".join("abcdefghijklmnopqrstuvwxyz:")
    assert {r["c"] for r in df.filter(F.col("c").rlike(text.unicode(f"(?i)^(?:{letters})$"))).collect()} == {"İ", "ı", "ſ", "K"}
