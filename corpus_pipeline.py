"""A training corpus from raw documents: quality, exact and near duplicates, repeated passages, packing.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. run applies them one after another, each stage's result written to the shared
folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from cadenza.llm.common import materialize, table, temporary
from cadenza.llm.queries import vocabulary

#: Bytes of a passage that counts as repeated: fewer than fifty words of any of the corpus's languages take.
PASSAGE_BYTES = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest id."""
    return exact_dedup.one_of_each_text(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES bytes or more that occur elsewhere too."""
    return substring_dedup.without_repeated_passages(docs, PASSAGE_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("suffix_array_dedup", no_repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the discriminant nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 < len(STAGES):
            with temporary(spark):
                docs = materialize(stage(spark, docs, sf_dir), name, outlive=True)
        else:
            docs = stage(spark, docs, sf_dir)
    return docs
