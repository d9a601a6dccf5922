"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import op8_decontaminate
from .disclosure import op13_disclosure
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm_difference import op7_lm_difference
from .media import op9_media_columns
from .ngram_join import op1_ngram_jaccard_join
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_knn import op5_quality_knn
from .source_mix import OP3_SQL, op3_source_mix
from .token_counts import op2_token_counts
from .url_filter import OP4_SQL, op4_url_filter
from .whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_source_mix": op3_source_mix,
    "op4_url_filter": op4_url_filter,
    "op5_quality_knn": op5_quality_knn,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_difference": op7_lm_difference,
    "op8_decontaminate": op8_decontaminate,
    "op9_media_columns": op9_media_columns,
    "op10_chat_format": op10_chat_format,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_disclosure": op13_disclosure,
}

ORACLES: dict[str, str] = {
    "op3_source_mix": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
}
