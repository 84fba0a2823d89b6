"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from copperleaf.llm.bpe import op9_bpe
from copperleaf.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from copperleaf.llm.hnsw import op7_hnsw
from copperleaf.llm.importance import OP13_SQL, op13_importance
from copperleaf.llm.licenses import OP12_SQL, op12_licenses
from copperleaf.llm.line_rules import OP4_SQL, op4_line_frequency
from copperleaf.llm.mixing import OP8_SQL, op8_mixing
from copperleaf.llm.preferences import OP10_SQL, op10_preferences
from copperleaf.llm.quality_model import op1_quality
from copperleaf.llm.sharding import OP6_SQL, op6_extendible_hashing
from copperleaf.llm.simhash import op2_simhash
from copperleaf.llm.token_rollup import op3_token_rollup
from copperleaf.llm.warc import OP5_SQL, op5_arc_to_warc


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_token_rollup": op3_token_rollup,
        "op4_line_frequency": op4_line_frequency,
        "op5_arc_to_warc": op5_arc_to_warc,
        "op6_extendible_hashing": op6_extendible_hashing,
        "op7_hnsw": op7_hnsw,
        "op8_mixing": op8_mixing,
        "op9_bpe": op9_bpe,
        "op10_preferences": op10_preferences,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_licenses": op12_licenses,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_frequency": OP4_SQL,
        "op5_arc_to_warc": OP5_SQL,
        "op6_extendible_hashing": OP6_SQL,
        "op8_mixing": OP8_SQL,
        "op10_preferences": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_licenses": OP12_SQL,
        "op13_importance": OP13_SQL,
    }
