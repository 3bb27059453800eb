"""A training corpus from the documents table, in stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns the packed pieces. A
stage's rows are written as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, documents
from tessera.llm.language import identified, piece_log_probs
from tessera.llm.near_duplicates import without_near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import kept, references
from tessera.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language (operator 7, learned from all labelled rows)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return identified(docs, path, *piece_log_probs(docs, path))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the divergence from the references keep (operator 5)."""
    return kept(docs, references(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each class of near duplicates (operator 8)."""
    return without_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the bytes that repeat earlier ones (operator 6)."""
    return without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents (operator 3)."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules),
          ("ngram_jaccard_join", ngram_jaccard_join), ("suffix_array_dedup", suffix_array_dedup),
          ("best_fit_packing", best_fit_packing)]

#: No SQL runs the tokenizers or the language model; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
