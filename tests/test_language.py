"""Language told by what was learned from other texts."""

import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from copperleaf.operators import language

SF = "/root/testdata/sf0.01"


def runs(text):
    flat = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    return [x for k in (1, 2, 3) for i in range(len(flat) - k + 1) if (x := flat[i : i + k]) != " "] if len(flat) >= 3 else []


def test_equals_the_plain_model(spark):
    said = [("en", "the cat and the dog"), ("en", "this is that"), ("de", "der Hund und die Katze"), ("fr", "le chat est là, l'été"), (None, "nobody says"), ("fr", None), ("de", "")]
    model = language.language_model(spark.createDataFrame(said, "lang string, text string"), "text", "lang", most=60)
    counts = {}
    for lang, text in said:
        if lang:
            counts.setdefault(lang, Counter()).update(runs(text))
    known = {x for c in counts.values() for x in sorted(c, key=lambda r: (-c[r], r))[:60]}
    share = {lang: {x: math.log((c[x] + 1) / (sum(c[y] for y in known) + len(known))) for x in known} for lang, c in counts.items()}
    got = {(r["lang"], r["run"]): r["share"] for r in model.collect()}
    assert set(got) == {(lang, x) for lang in share for x in known} and all(abs(got[lang, x] - share[lang][x]) < 1e-12 for lang, x in got)
    texts = ["the dog", "die Hunde", "l'été est là", "", None, "123 !", "日本語", "x" * 9]
    want = []
    for t in texts:
        sums = {lang: sum(s[x] for x in runs(t) if x in known) for lang, s in share.items()} if any(x in known for x in runs(t)) else {}
        want.append(max(sums, key=lambda lang: (round(sums[lang], 6), lang)) if sums else "")
    found = language.with_language(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", model).collect()
    assert [r["language"] for r in sorted(found)] == want


def test_held_out_texts_of_fifty_signs_are_told(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.language_model(docs.filter(~held), "text", "lang")
    told = language.with_language(docs.filter(held), "doc_id", "text", model).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id"))
    rows = [(r["lang"], r["language"]) for r in told.filter(F.length("text") >= 50).collect()]
    right = sum(a == b for a, b in rows)
    assert len(rows) > 100 and right >= 0.95 * len(rows), (right, len(rows))
    assert zlib.crc32(b"5") >= 0


def test_without_labels_and_texts(spark):
    none = spark.createDataFrame([], "id long, lang string, text string")
    model = language.language_model(none, "text", "lang")
    assert model.count() == 0 and language.with_language(none, "id", "text", model).collect() == []
    one = spark.createDataFrame([(1, "en", "words")], "id long, lang string, text string")
    assert language.with_language(one, "id", "text", model).first()["language"] == ""


def test_pieces_tables_and_signs_beyond_the_plane(spark, monkeypatch):
    texts = ["a\U00010400b 日本 x", "ab" * 40, "", "  ", "é", None, "日本語日本語", "the end"]
    want = Counter(("l" + str(i % 2), x) for i, t in enumerate(texts) for x in runs(t))
    for signs, cells in ((1 << 20, 1 << 22), (5, 3)):
        got = Counter()
        pieces = [" " + re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip() + " " for t in texts]
        monkeypatch.setattr(language, "SIGNS", signs)
        monkeypatch.setattr(language, "CELLS", cells)
        for made, code, owner in language._runs([p if len(p) >= 3 else "" for p in pieces], 3):
            for c, o in zip(code.tolist(), owner.tolist(), strict=True):
                got["l" + str(o % 2), made[c]] += 1
        assert got == want
    rows = spark.createDataFrame([(f"l{i % 2}", t) for i, t in enumerate(texts)], "lang string, text string")
    assert {(r["key"], r["run"]): r["n"] for r in language.run_counts(rows, "lang", "text").collect()} == want


def test_runs_are_not_rows(spark):
    docs = spark.createDataFrame([(1, "en", "words and words")], "id long, lang string, text string")
    plan = language.with_language(docs, "id", "text", language.language_model(docs, "text", "lang"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
