"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns that documents came with. ``run`` writes every stage's rows as Parquet in
the shared folder and reads them again, so that a lost executor costs one stage at most.

Rows of ``documents`` may hold nulls in any column, repeat, or be none at all: each stage's module states
what it makes of them. An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copperleaf.cluster import materialise
from copperleaf.llm.bpe import encode_documents
from copperleaf.llm.line_rules import keep_good_lines
from copperleaf.llm.mixing import repeat_by_mix
from copperleaf.llm.quality_model import keep_good_quality
from copperleaf.llm.simhash import keep_one_of_each

STAGES = [
    ("quality rules", keep_good_lines),
    ("quality classifier", keep_good_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("mixing sources to target weights", repeat_by_mix),
    ("BPE encoding and decoding", encode_documents),
]

#: A trained model's verdict is not SQL; tests compare ``run`` to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
