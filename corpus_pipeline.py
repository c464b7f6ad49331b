"""A corpus pipeline of five stages over ``documents``.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``, in their order and
whatever else they are called. Every stage takes nulls in any column, texts of
any length, repeated rows and ids, and empty tables, which give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keylingo.llm import byte_bpe, curriculum_mix, exact_dedup, simhash, toxicity
from keylingo.llm.common import Scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a lexicon learned from the labelled ones. Each row is judged by its own text; null and empty texts stay, without labels all do."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id, null ids last; of rows equal in both one stays. Null and empty texts are one group."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, null ids last; one row stays where ids repeat. Null and empty texts are linked like any other."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out so that sources meet their targets. Texts without words go; null sources are one source."""
    return curriculum_mix.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to; a row a row, null texts as empty ones."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, path, pattern, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("curriculum_mix", mixed),
    ("byte_bpe", encoded),
]

#: The learned lexicon, the fingerprints' components and the merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
