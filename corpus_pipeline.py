"""Corpus pipeline: toxicity, exact copies, near copies, source mix, token ids; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinderbrook.llm.bpe import bpe_round_trip, read_ranks
from cinderbrook.llm.common import Scratch, freed
from cinderbrook.llm.exact_dedup import drop_exact_copies
from cinderbrook.llm.mixing import mixed_documents
from cinderbrook.llm.simhash import drop_near_copies
from cinderbrook.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the nearest labelled examples call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, the smallest doc_id."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that remains, with the digests of the ids and of what they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SimHash links and nearest examples aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage needed is freed when its result is written, and a result when the next stage's is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, earlier = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with freed():
            docs = tables.keep(stage(spark, docs, sf_dir), name)
        if earlier:
            tables.drop(earlier)
        earlier = name
    return docs
