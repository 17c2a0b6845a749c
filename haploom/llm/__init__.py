"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    from haploom.llm import byte_bpe, decontaminate, jaccard_join, licenses, merkle, nearest, quality, quotes, rules, search, substring_dedup, token_counts, toxicity

    return {
        "op1_quotes": quotes.op1_quotes,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_nearest": nearest.op6_nearest,
        "op7_licenses": licenses.op7_licenses,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_quality": quality.op10_quality,
        "op11_lexical_search": search.op11_lexical_search,
        "op12_quality_rules": rules.op12_quality_rules,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    from haploom.llm import licenses, merkle, nearest, quotes, rules, search

    return {
        "op1_quotes": quotes.SQL,
        "op6_nearest": nearest.SQL,
        "op7_licenses": licenses.sql(),
        "op11_lexical_search": search.SQL,
        "op12_quality_rules": rules.sql(),
        "op13_merkle": merkle.sql(),
    }
