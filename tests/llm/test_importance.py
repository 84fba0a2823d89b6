import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from copperleaf.llm import importance as imp


def features(text, longest=3):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets=10_000, longest=3):
    count = lambda texts: Counter(f % buckets for t in texts for f in features(t, longest)[1])
    s, t = count(x for _, x in docs), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        n, found = features(x, longest)
        out.append((i, n, len(found), sum(gain(f % buckets) for f in found)))
    return out


def drawn(rows, seed=42, percent=5, least=20):
    scored = []
    for i, n, k, w in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, k, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    most = percent * len(may) // 100
    return [(*r, k + 1 if k < most else None) for k, r in enumerate(may)] + [(*r, None) for r in scored if r[1] < least]


WORDS = "the of And ünter 日本語 x1 Z9 data-set a_b word's naïve \t\n ... ; ".split(" ")


def made(n):
    texts = [None, "", "...", "one", "Two words", "a b c", "ÀÉ à É", "x" * 5000, "the " * 3000]
    texts += [" ".join(WORDS[(i * j + j * j) % len(WORDS)] + str(j % (i % 9 + 1)) * (j % 3) for j in range(i % 60)) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, "again and again"), (7, "again and again"), (7, "other text"), (None, "no id " * 12), (None, "no id " * 12)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"buckets": 13, "longest": 2}, {"buckets": 70_000, "longest": 1}])
def test_weights_are_those_of_a_plain_version(spark, monkeypatch, options):
    docs, target = made(400), [None, "", "the of and", "word s naïve 日本語 data set", "again and again", "only here"]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ID", "bucket", "block", "salt", "gain")}).repartition(5, "doc_id")
    got = imp.importance_weights(table, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert rows_of(got) == sorted(plain(docs, target, **options), key=str)


def test_small_blocks_salts_and_pieces_change_nothing(spark, monkeypatch):
    docs, target = made(150), ["the of and", "x1 z9"]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(imp, "GROUP", 40)  # on the driver: five salts
    want = sorted(plain(docs, target), key=str)
    assert rows_of(imp.importance_weights(table, spark.createDataFrame([(t,) for t in target], "text string"))) == want
    monkeypatch.setattr(imp, "PIECE", 7)
    for _, text in docs:
        counts, n = imp.bucket_counts(text and text.encode(), 97, 3)
        words, found = features(text)
        assert n == words and Counter({b: int(c) for b, c in enumerate(counts) if c}) == Counter(f % 97 for f in found)


def test_packed_postings_come_back():
    import numpy as np

    for docs, counts in [([0], [1]), ([0, 3, 4000], [1, 2, 255]), ([255, 256], [256, 70_000]), (list(range(0, 4096, 3)), [1] * 1366)]:
        a, b = imp._unpacked(imp._packed(np.array(docs), np.array(counts, np.uint32)))
        assert a.tolist() == docs and b.tolist() == counts


def test_draw_breaks_ties_and_counts_only_long_texts(spark):
    rows = [(i, 15 + i % 10, 3 * i, i % 4) for i in range(400)] + [(9, 30, 1, 2), (9, 30, 1, 2), (None, 25, 2, 3), (1000, 0, 0, 0)]
    table = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long").repartition(3)
    for percent in (0, 5, 100):
        assert rows_of(imp.draw(table, percent=percent)) == sorted(drawn(rows, percent=percent), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert imp.draw(imp.importance_weights(none, none)).collect() == []
    docs = [(1, "a b"), (2, None)]
    assert rows_of(imp.importance_weights(spark.createDataFrame(docs, "doc_id long, text string"), none)) == sorted(plain(docs, []), key=str)
