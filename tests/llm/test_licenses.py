import re

import pytest
from pyspark.sql import functions as F

from copperleaf.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def base(text):
    found = words(text)
    at = [(i, label) for label, p in lic.PHRASES for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    return len(found), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def notice(label, i=0):
    return [t for x, _, t in lic.NOTICES if x == label][i]


def edited(text, every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split()))


MIT, GPL3, GPL2 = notice("mit"), notice("gpl-3", 1), notice("gpl-2", 1)
CASES = {
    "Released under the MIT License.": ("mit", 1.0),
    "x" * 9 + " under\nTHE mit-license, apache license (version 2): CC BY-NC": ("apache-2,cc-by-nc,mit", 1.0),
    "under the mit license " * 50: ("mit", 1.0),
    "This work is licensed under the GNU General Public License, version 3.": ("gpl-3", 1.0),
    "Licensed under CC BY-NC 4.0.": ("cc-by-nc", 1.0),
    "é" + MIT.upper() + "é": ("mit", None),
    "before " * 300 + MIT + " after" * 300: ("mit", 1.0),
    "before " + edited(MIT, 20) + " after": ("mit", None),
    MIT.replace("merge, publish,", "merge, and sometimes also publish,"): ("mit", None),
    MIT.replace("free of charge, ", ""): ("mit", None),
    edited(MIT, 3): ("", 0.0),
    GPL3: ("gpl-3", 1.0),
    GPL2: ("gpl-2", 1.0),
    f"{GPL3} and elsewhere {'word ' * 90} {GPL2}": ("gpl-2,gpl-3", 1.0),
    " ".join(MIT.split()[:20]): ("", None),
    " ".join(reversed(MIT.split())): ("", 0.0),
}


@pytest.fixture(scope="module")
def templates(spark):
    return lic.default_templates(spark)


def scan(docs, templates):
    return {r["id"]: r for r in lic.license_scan(docs, templates).collect()}


def test_labels_of_planted_notices_and_base_places(spark, templates):
    texts = [*CASES, None, "", "...", "cc by", "Cc By nC", "under the mit licenses", "under the mit", "underthe mit license", "ünder the mit license", "under the mit license", "cc by nc " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(3) for c in ("ID", "key", "label", "words", "_id", "base", "Text2")}).repartition(3)
    got = scan(docs, templates)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if t in CASES:
            labels, score = CASES[t]
            assert r["labels"] == labels and (score is None or r["score"] == score), t


def test_repeated_rows_null_ids_and_empty_tables(spark, templates):
    text = f"a {GPL3} b"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "cc by nc"), (None, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r["id"]), r["n_words"], r["labels"], r["n_base"]) for r in lic.license_scan(docs, templates).collect())
    n = len(words(text))
    assert got == sorted([("1", n, "gpl-3", 0)] * 2 + [("1", 3, "cc-by-nc", 1)] + [("None", n, "gpl-3", 0)] * 2 + [("None", 0, "", 0)])
    assert lic.license_scan(docs.limit(0), templates).collect() == []
    assert {r["labels"] for r in lic.license_scan(docs, templates.limit(0)).collect()} == {""}


def test_spans_say_where(spark, templates):
    text = f"one two {edited(MIT, 25)} end"
    rows = lic.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), templates).filter("verified").collect()
    assert [(r["label"], r["first"], r["last"]) for r in rows] == [("mit", 2, 1 + len(words(MIT)))]
    assert 0.8 <= rows[0]["coverage"] < 1


def test_templates_beyond_the_broadcast_give_the_same(spark, templates, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    want = sorted(map(tuple, lic.license_scan(docs, templates).collect()))
    monkeypatch.setattr(lic, "broadcast_if_small", lambda keys: keys.hint("merge"))
    assert sorted(map(tuple, lic.license_scan(docs, templates).collect())) == want


def test_a_short_template_is_refused():
    with pytest.raises(ValueError):
        lic.template_rows([("x", "two words")], [])
