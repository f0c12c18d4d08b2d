"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage whose ``query(spark, sf_dir)`` it runs.
MODULES = {
    "op1_simhash": "simhash",
    "op2_sharding": "sharding",
    "op3_exact_dedup": "exact_dedup",
    "op4_toxicity": "toxicity",
    "op5_flac": "flac",
    "op6_packing": "packing",
    "op7_sentencepiece": "sentencepiece_bpe",
    "op8_token_files": "token_files",
    "op9_token_counts": "token_counts",
    "op10_language": "language",
    "op11_whitening": "whitening",
    "op12_sanitise": "sanitise",
    "op13_alignment": "alignment",
}


def runner(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"kinoframe.llm.{module}").query(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(module) for name, module in MODULES.items()}

#: Queries that DuckDB can say over the same tables.
ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
