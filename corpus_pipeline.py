"""Cleaning the documents for training, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents.  Stages judge the documents that their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barline.llm import decontamination, lines, near_dup, pieces, quality
from barline.llm.graph import Scratch
from barline.llm.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among docs."""
    weights = quality.train_quality(docs, quality.learned_from(table(spark, sf_dir, "labels")))
    return quality.good_documents(docs, weights)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; documents left without a line stay empty."""
    return lines.without_repeated_lines(spark, docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays; shingles of five words, from 0.8 on."""
    return near_dup.one_of_each(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"), decontamination.TOLERANT)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of the ids and of the text decoded from them."""
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
#: Classifier, sketches and encoder have no SQL text; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage keeps is written before the next reads it."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
