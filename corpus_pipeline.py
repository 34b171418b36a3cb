"""The corpus pipeline over ``documents``: five stages, each a corpus operator.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor, and returns the
columns of ``documents``, the last the encoded documents. ``run`` writes every stage as
Parquet to the cluster's shared folder and reads it again as the next one's input; what a stage
stored on its way, and its input, go once its result is written.

Defined cases, in every stage: further columns, of whatever names, are kept; an empty table gives
an empty result; equal rows are rows of their own, told apart by no stage but the mix, which may
take each of them; a null text, or one without words, is no document that the classifier keeps.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from postwarden.llm import bpe, grading, mixing, near_dedup, substring_dedup
from postwarden.llm.common import release, stored_alone, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the ratings of ``labels``, selects; all rows where nothing is rated."""
    return grading.selected(docs, grading.ratings(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, Jaccard 0.8 or more.

    The smallest doc_id stays, with all of its rows; rows without a doc_id or without words are linked with nothing and stay.
    """
    return near_dedup.first_copies(docs)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages of 50 words or more that a document with a smaller id holds too.

    A document of which no word is left goes; rows without a doc_id, or with one doc_id, take nothing from each other.
    """
    return substring_dedup.cut_repeats(docs, span=50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights; one that is taken n times is there n times. Texts without words are not taken."""
    return mixing.taken_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the bytes they decode to; a null text has none."""
    return bpe.encoded_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("substring repeats", substring_repeats),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: The classifier, the seeded mix and BPE are not expressible in SQL; tests/llm/ has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stored_alone(spark, functools.partial(stage, spark, docs, sf_dir))
        release(spark, getattr(before, "stored_at", None))
    return docs
