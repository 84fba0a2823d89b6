import hashlib

import pytest
from pyspark.sql import functions as F

from copperleaf.llm import fill_in_middle as fim


def plain(doc_id, text, seed=1, fim_percent=90, spm_percent=20):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "a", "\n", " \t\r\n ", "é🎉é‍👩‍👧", "a\0b", "x<P>y", "<S", "S><M", "<M>", "ab<<S>>", "\\E[(", "q" * 63, "q" * 64, "q" * 65, "日" * 128, "日本🎉" * 1000,
]


@pytest.mark.parametrize("options", [{}, {"seed": 7, "fim_percent": 100, "spm_percent": 50}, {"fim_percent": 0}])
def test_cuts_and_restores_like_a_plain_version(spark, options):
    rows = [(i * 31 + j, t) for j, t in enumerate(TEXTS) for i in range(12)] + [(None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("id", "own", "output", "form", "N")})
    made = fim.fill_in_middle(docs, **options).withColumn("back", fim.restored_text("output", "form")).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:6] for r in made), key=order) == sorted((plain(*r, **options) for r in rows), key=order)
    assert all(r["back"] == plain(0, t, fim_percent=0)[5] for r in made for t in [r["output"]] if r["form"] == "plain")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r["back"] in texts[r["id"]] for r in made)


def test_long_texts_many_in_a_batch_and_odd_tables(spark, monkeypatch):
    long = "".join(chr(0x4E00 + i % 5000) + "\n" * (i % 7 == 0) for i in range(400_000))
    docs = spark.createDataFrame([(i, long[i:]) for i in range(9)] + [(i, "short") for i in range(9, 3000)], "doc_id long, text string").coalesce(1)
    made = fim.fill_in_middle(docs).withColumn("ok", fim.restored_text("output", "form") == F.when(F.col("id") >= 9, "short").otherwise(F.expr(f"substr('{long}', id + 1)")))
    assert made.filter("ok").count() == 3000
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
    text_ids = fim.fill_in_middle(spark.createDataFrame([("k1", "abc")], "key string, body string"), "key", "body").collect()
    assert tuple(text_ids[0]) == plain("k1", "abc")


def test_bytes_that_are_no_utf8_are_replaced(spark):
    docs = spark.sql("SELECT 3L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    row = fim.fill_in_middle(docs, fim_percent=100).withColumn("back", fim.restored_text("output", "form")).first()
    assert row["n"] == 3 and row["back"] == "a�b"
