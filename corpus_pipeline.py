"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Defined results: rows without an id are judged by their own text by the classifier and against the
benchmark, and all stay among near duplicates; equal rows go or stay together, but of near
duplicates, equal rows with an id among them, one row stays; rows without text or words pass the classifier as it scores them, lose no line, have no near duplicate
and hold no benchmark item, and are packed as empty documents; empty tables give no rows; without
labels the classifier keeps all. Further columns are carried to the last stage's input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.folders import removed, shared_folder
from lexidim.llm.common import read_table
from lexidim.llm.decontamination import clean_documents
from lexidim.llm.line_dedup import without_repeated_lines
from lexidim.llm.packing import packed_documents
from lexidim.llm.quality_classifier import kept_documents
from lexidim.llm.similarity_join import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more hold stay in the last of them only."""
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word n-grams, 0.8) one document stays."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit budget go."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of 2048 tokens."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Training a classifier and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes once the next one is written; the last one's stays,
    as the result is read from it."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
