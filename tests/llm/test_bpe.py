import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from copperleaf.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
REAL.no_truncation()
REAL.no_padding()
OWN = bpe.Bpe(open(PATH, encoding="utf-8").read())


def real(text):
    ids = REAL.encode(text or "", add_special_tokens=False).ids
    return ids, REAL.decode(ids, skip_special_tokens=False)


def agrees(text):
    ids, decoded = real(text)
    got = OWN.encode(text)
    assert got.tolist() == ids
    assert OWN.decode(got).decode() == decoded


@pytest.mark.parametrize(
    "text",
    [None, "", " \n ", "Hello, World's 42 cats!!", "a\x1cb \x1f", "<|startoftext|>Hi<|endoftext|>", "x<|endoftext|>y <|endoftext", "ΣΑΣ ΟΔΟΣ İstanbul", "é    x", "日本語テキスト 😀👍🏽",
     "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ththththththinthinthan" * 300, "</w> <w/></w>", "don't we'll I'VE it'S ''s"],
)
def test_known_cases(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrsth", min_size=1, max_size=80))
def test_frequent_letters(text):
    agrees(text)


def test_every_code_point():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 5000):
        text = "".join(f"a{c}. " for c in chars[i : i + 5000])
        assert OWN.encode(text).tolist() == REAL.encode(text, add_special_tokens=False).ids


def test_query_agrees_with_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op9_bpe(spark, sf).collect():
        ids, decoded = real(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "the cat"), (2, ""), (3, "the cat " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "ids": F.lit(1)})
    got = bpe.encode_decode(df, PATH, with_ids=True).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 2, 200000]
    assert next(r for r in got if r["id"] is None)["decoded"] == "the</w> cat</w>"
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
