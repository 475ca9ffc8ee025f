"""From raw documents to packed training sequences, in five stages, each by one operator of velatura.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and the last returns one row for each piece of a document in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velatura.llm.common import cut, remove, shared_folder, table
from velatura.llm.decontaminate import drop_leaks
from velatura.llm.line_dedup import dedup_lines
from velatura.llm.near_dedup import drop_similar
from velatura.llm.packing import pack
from velatura.llm.quality_classifier import drop_low_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents of the folder, scores 0.3 or more."""
    return drop_low_quality(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more share; a shared line stays in the largest doc_id."""
    return dedup_lines(docs, min_chars=20, min_docs=3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_similar(docs, words=5, similarity=0.8, seed=42)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores, fingerprints and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the folder's documents. What each stage kept is written to the shared checkpoint folder, as long as it is read.

    Defined results, as the operators state them: null and empty texts are judged like any others, and stay or go as one group of
    copies; rows of one id are one document for shared lines and rows of their own elsewhere; an empty table gives no rows.
    """
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return packed
