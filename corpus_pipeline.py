"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage but the last returns the columns of its input. Stages: documents that the classifier calls toxic
go; of equal texts one stays; of texts whose sets of five-word shingles are connected by similarities of 0.8 or more
one stays; documents that hold a benchmark item go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import decontaminate, exact_dedup, jaccard_join, registry, sentencepiece_codec, toxicity
from gaugework.llm.shared import materialize, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on labelled documents of the input, then keeps those scored below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, k=5, num=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, registry.TOKENIZER)


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", token_ids),
]

#: SQL cannot express the classifier and the encoder; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
