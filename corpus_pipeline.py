"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantwell.llm.common import Scratch, documents
from quantwell.llm.jaccard import first_of_each
from quantwell.llm.packing import pack_documents
from quantwell.llm.quality import keep_good
from quantwell.llm.secrets import redact_secrets
from quantwell.llm.suffixes import remove_duplicates

#: The tokenizer, the id that ends a document and the ids of a sequence.
TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs, Scratch(spark))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8."""
    return first_of_each(docs, Scratch(spark), width=5, p=80, q=100)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that an earlier document has."""
    return remove_duplicates(docs, length=50)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY, Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix order, lexing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
