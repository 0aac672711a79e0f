"""A corpus pipeline over the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's documents; what the last but one wrote is removed then.

Defined cases, by the stages' operators: documents with null or empty text fail the quality rules; a
null id is an id of its own (of equal texts one row stays, whatever their ids); a null source is a
source; equal rows are one document; very long texts go through whole; an empty table gives an empty
result; all columns stay but the last stage's text, whose place ``ids`` takes, and a column ``ids`` of
the input gives way to it. The stages use names of their own, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrysql.llm import mixing, ngram_join, pieces, quality_rules, secret_scans
from quarrysql.llm.common import remove, table, work_dir
from quarrysql.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules pass."""
    return quality_rules.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.stage(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secret_scans.stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's pieces."""
    return pieces.stage(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

#: SQL can express neither the network's findings nor the Viterbi segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
