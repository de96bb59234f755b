"""The corpus pipeline: each stage is applied to what the one before it kept.

The frame between two stages is written as Parquet and read again, so a stage starts from files that
outlive any executor. All stages but the last return the columns of ``documents``; the last returns
doc_id, n_tokens, ids and round_trip of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import materialise, read_table
from docloom.llm.decontamination import keep_clean
from docloom.llm.jaccard_join import keep_one
from docloom.llm.language_id import keep_identified
from docloom.llm.line_dedup import rewrite_lines
from docloom.llm.sentencepiece_codec import op3_sentencepiece


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no language go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents repeat stay in one of them."""
    return rewrite_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left."""
    return op3_sentencepiece(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express language identification and SentencePiece; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
