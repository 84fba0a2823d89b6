"""The pipeline beside a plain version of every stage."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from copperleaf.llm.line_rules import OP4_SQL
from copperleaf.llm.mixing import OP8_SQL
from copperleaf.llm.quality_model import _sigmoid, features, train
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def in_sql(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in out.fetchall()}


def test_run_equals_the_plain_version(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rules = in_sql(OP4_SQL, docs)
    docs = [r for r in docs if rules[r["doc_id"]]["kept"]]
    now = spark.createDataFrame(docs)
    w = train(now, spark.read.parquet(f"{SF}/labels.parquet"))
    bits = (len(w) - 1).bit_length() - 1

    def score(text):
        at, x = features(text, bits)
        return _sigmoid(float(w[at] @ x))

    docs = [r for r in docs if score(r["text"]) >= 0.3]
    component = brute_components({r["doc_id"]: brute_fp(r["text"]) for r in docs})
    docs = [r for r in docs if component[r["doc_id"]] == r["doc_id"]]
    mix = in_sql(OP8_SQL, docs)
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs:
        m = mix[r["doc_id"]]
        ids = real.encode(r["text"], add_special_tokens=False).ids
        copies = int(m["taken"] / m["size"] + 0.5)
        if copies:
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += copies
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and sum(got.values()) > 50


def test_stages_keep_the_columns_of_documents_and_pass_odd_rows(spark, tmp_path):
    helpers = "kept score size id key _id _key _gone _rejected_id _rejected_key _copy_id _copy_hash _row _rows _mix_id _mix_k _mix_key _mix_copies _mix_rows place fp root copy component _text _label _doc".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in helpers} | {"carried": F.lit(None).cast("string"), "tags": F.create_map(F.lit("a"), F.lit(1)), "made": F.parse_json(F.lit("[1]"))})
    null = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for rows in (docs.limit(60).unionByName(docs.limit(5)).unionByName(null).unionByName(null), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
