"""The corpus pipeline: stages over documents, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents.

Defined cases, in every stage: null and repeated doc_ids and wholly repeated rows are rows of their own (near-dedup
makes one of equal ids with equal texts); null and empty texts are texts without words; extra columns stay as they are,
whatever they are called; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from predspark.llm import mixing, near_duplicates, quality_classifier, quality_rules, queries
from predspark.llm.common import materialize, ship_package, table


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go; one without a host is judged by itself.  Null and empty
    texts fail."""
    return quality_rules.keep_good(docs)


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of low quality go; equal texts are judged alike."""
    ship_package(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, with the least doc_id, null after all others; documents without
    words are in no class."""
    ship_package(spark)
    return near_duplicates.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once, or up to three times; one without words never.
    Rows that the mix cannot tell apart (equal id, source and size) share what it takes of them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, encoded and decoded again, a row for each row; other
    columns go."""
    return queries.bpe_digests(spark, docs)


STAGES = [
    ("quality rules", apply_rules),
    ("quality classifier", apply_classifier),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL has no form of the classifier, the signatures or the merges; tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; what a stage returns is written before the next reads it.  An empty
    table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = materialize(docs, "pipeline")
        docs = stage(spark, docs, sf_dir)
    return docs
