"""The registered queries of this subpackage: ``QUERIES`` and their ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, host_rules, mixing, ngram_join, url_filter, warc
from .importance import op9_importance_resampling
from .line_dedup import op7_line_dedup
from .ngram_join import op3_ngram_jaccard_join
from .packing import op5_best_fit_packing
from .secrets import op2_secret_scan
from .url_filter import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_host_quality_rules": host_rules.op10_host_quality_rules,
}

#: DuckDB SQL of the same rows, where SQL can express them.
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embedding_dedup.ORACLE,
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op8_warc_round_trip": warc.ORACLE,
    "op10_host_quality_rules": host_rules.ORACLE,
}
