"""A training corpus from documents: quality, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes what its predecessor kept and returns whole rows with all their columns; the last returns the ids of
the tokens beside doc_id. Texts may be null: such a document has no words, so the first stage rejects it. Rows repeated
whole become one in the second stage; rows with one doc_id that differ in any column stay rows of their own unless their
texts are near-duplicates. An empty table stays empty at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import bpe, decontaminate, near, pii, quality
from veritrace.llm.common import read, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: linked by the SimHash trie or a prefix filter, and checked: Jaccard similarity of 5-word shingles 0.8 or more."""
    return near.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the token ids of each text and what they decode to."""
    return bpe.encode(docs, decoded=True, forget=True)


STAGES = [("quality", good), ("near_dedup", unique), ("decontaminate", clean), ("pii", private), ("bpe", tokens)]

#: Perplexity, fingerprint groups, boosted trees and BPE have no SQL form; tests/llm/test_pipeline.py compares run() with a plain Python run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stored as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
