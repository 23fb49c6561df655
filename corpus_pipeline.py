"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, temperature mixing, best-fit packing.

Every stage works on all that the one before it kept. All but the last return the columns of documents; the last returns
the pieces of documents with their token ids and places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, jaccard_join, line_crf, mixing, packing
from marginalia.llm.shared import Scratch, read

#: No source is passed over more often than this.
REPETITION_LIMIT = 2.0
SEQUENCE_TOKENS = 1024
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go. It learns from the labels of rows that aren't held out."""
    return line_crf.keep_good(docs, line_crf.fit_on(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more, directly or over others, the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays at least once; documents of small sources come more often, up to the repetition limit."""
    return mixing.mix(docs, repetition_limit=REPETITION_LIMIT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids, cut to pieces where they are longer than a sequence, with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("temperature mixing", mixed),
    ("best-fit packing", packed),
]

#: A fitted classifier and tokens aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = tmp.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
