"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, embedding_dedup, language_id, lexical_search, license_scan, line_dedup
from tidemark.llm import mixing, prefix_trie, sharding, simhash_dedup, token_counts, token_output, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1,
        "op2_embedding_dedup": embedding_dedup.op2,
        "op3_token_counts": token_counts.op3,
        "op4_license_scan": license_scan.op4,
        "op5_token_output": token_output.op5,
        "op6_sharding": sharding.op6,
        "op7_language_id": language_id.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_decontamination": decontamination.op9,
        "op10_simhash_dedup": simhash_dedup.op10,
        "op11_lexical_search": lexical_search.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_vector_search": vector_search.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL, "op2_embedding_dedup": embedding_dedup.OP2_SQL, "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_vector_search": vector_search.OP13_SQL,
    }
