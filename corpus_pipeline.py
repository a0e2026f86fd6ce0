"""The training-corpus pipeline: five stages over documents, each written and read again.

quality rules -> exact deduplication -> near duplicates -> mixture of sources -> token ids.
Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and all but
the last return the columns of documents.

Edge cases are those of the operators: null texts count as empty and fail the quality rules; rows
without doc_id take part in every stage, a null being larger than all ids; an empty table passes
through all stages as an empty one; further columns of documents are carried to the mixture.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import mixing, ngram_join, piece_codec, repetition, stream_dedup
from treeloom.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return repetition.keep_clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id."""
    return stream_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the least doc_id."""
    return ngram_join.without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for."""
    return mixing.mixture(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with begin and end ids, and the digest of the text that they decode to."""
    ids = piece_codec.encode_ids(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]

#: Streams, set joins over all shingles and SentencePiece ids have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
