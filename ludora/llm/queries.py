"""Queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_interval_alignment
from .counts import op9_token_counts
from .exact import OP6_SQL, op6_exact_dedup
from .neardup import op4_order_minhash
from .ngramjoin import op13_ngram_join
from .packing import op3_cost_balanced_packing
from .pieces import op7_sentencepiece_prefix_table
from .quality import op10_quality_rules
from .ranking import op11_range_maximum_search
from .simhash import op8_simhash
from .toxicity import op5_toxicity_grammar
from .urls import op2_url_filter
from .wavelet import op1_wavelet_matrix

OPERATORS = (
    op1_wavelet_matrix, op2_url_filter, op3_cost_balanced_packing, op4_order_minhash, op5_toxicity_grammar, op6_exact_dedup,
    op7_sentencepiece_prefix_table, op8_simhash, op9_token_counts, op10_quality_rules, op11_range_maximum_search, op12_interval_alignment,
    op13_ngram_join,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL}
