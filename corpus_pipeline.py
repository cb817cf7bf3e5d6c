"""A corpus from raw documents to packed sequences: quality, near-duplicates, repeated passages, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before it kept; all but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads them back for the next.

In every stage a null text is an empty one, a null doc_id a row like others, columns beyond those of documents stay as they
are whatever their names (but in packing, which returns pieces), and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import stored, table
from quern.llm.near import one_of_each_similar
from quern.llm.packing import packed
from quern.llm.quality import kept_by_quality
from quern.llm.substring import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go. Empty and blank texts have a score like others, of their features; very long ones are read whole; rows that repeat, and ties at the threshold, fare alike. Without labels nothing is rejected."""
    return kept_by_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 or more of their 5-word shingles, the one of least doc_id stays; of rows of that doc_id the one of least text hash, and of rows alike in both one. Texts without words are one group; a text of fewer than five words is one shingle; very long ones are sketched in slices."""
    return one_of_each_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that start earlier too go; a document that loses all its words stays as an empty text. Earlier is by doc_id, a null one first; rows that repeat count as one document, and lose the same words; empty and blank texts, and those of fewer than 20 words, stay as they are; very long ones are read whole."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences. An empty text is its end id alone, a blank one has tokens like others; very long ones are cut; rows that repeat are packed each; ties go to the sequence that was begun first."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: SQL can express neither the ranking nor the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
