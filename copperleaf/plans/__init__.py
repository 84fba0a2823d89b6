"""All queries over the reference tables, with their SQL."""

from copperleaf.plans import copy_queries, corpus_queries, evaluation_queries, scoring_queries, selection_queries, source_queries  # noqa: F401
from copperleaf.plans.registry import ORACLES, QUERIES  # noqa: F401
