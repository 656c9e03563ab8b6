"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantwell.llm import huffman, jaccard, media, packing, pseudolm, quality, secrets, suffixes, unigram, wordtable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_suffix_array_dedup": suffixes.op2_suffix_array_dedup,
        "op3_token_file": huffman.op3_token_file,
        "op4_bpe_round_trip": wordtable.op4_bpe_round_trip,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_gif_media": media.op7_gif_media,
        "op8_token_counts": unigram.op8_token_counts,
        "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
        "op10_pseudo_likelihood": pseudolm.op10_pseudo_likelihood,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.OP6_SQL}
