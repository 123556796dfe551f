"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bag_minhash, embedding_dedup, html_extraction, lexical_search, packing, quality_rules, secret_scan, sentencepiece_backend, spelling, substring_automaton, substring_suffix, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        html_extraction.op1_html_extraction,
        substring_suffix.op2_suffix_dedup,
        quality_rules.op3_quality_rules,
        bag_minhash.op4_bag_minhash,
        embedding_dedup.op5_embedding_dedup,
        token_counts.op6_token_counts,
        sentencepiece_backend.op7_sentencepiece,
        packing.op8_packing,
        warc.op9_warc,
        substring_automaton.op10_automaton_dedup,
        lexical_search.op11_lexical_search,
        spelling.op12_spelling,
        secret_scan.op13_secrets,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL}
