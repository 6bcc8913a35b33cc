"""From documents to token sequences: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), gets what its predecessor kept and
returns a DataFrame; ``run`` writes every stage's result as Parquet in the shared
scratch folder and reads it again for the next, so a lost executor repeats tasks
of one stage at most. All stages but the last return the columns of documents.

Defined results: null texts count as empty; null ids stay and sort after all others
where one of several rows is kept; labels that are null or of unknown documents
teach nothing, and without any all documents are kept; columns beside doc_id and text
pass through untouched; empty tables give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakehook.llm import exact_dedup, jaccard_join, packing, quality
from lakehook.llm.common import materialise, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, predicts to have label 1."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.75 or more."""
    return jaccard_join.keep_one(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", dissimilar_documents),
    ("packing", packed_documents),
]

# A trained model cannot be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
