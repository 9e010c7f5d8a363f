"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents.

Cases: a null or empty text has fewer than 50 words and goes in the first stage; texts of any length are read whole. Rows that
repeat a doc_id, and rows without one, are documents of their own until the near duplicates, where one row of each doc_id
stays and rows without an id all stay. Ties go to the smallest doc_id, or to the text that sorts first. Extra columns, whatever
their names, stay with their rows to the last stage but one. Labels of documents that are gone teach nothing. An empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaylens.llm import linedup, ngram_join, packing, quality, toxicity
from quaylens.llm.common import materialise, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a classifier learnt from the labels of documents that are still there."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share (but for the first document that has them)."""
    return linedup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, share=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each in its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("packing", pack_sequences),
]

#: A trained classifier decides in the second stage, which SQL can't express; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
