"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's result as Parquet to the shared scratch folder and reads it back as the next stage's input.

Defined cases: rows with a NULL or short text fail the quality rules; an empty input gives empty results in every stage;
further columns of ``docs`` pass through. Repeated rows with one doc_id share the fate of that doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemweave.llm.common import Scratch, table
from itemweave.llm.decontam import drop_leaks
from itemweave.llm.jaccard import keep_one
from itemweave.llm.line_dedup import drop_lines
from itemweave.llm.packing import pack
from itemweave.llm.quality import keep_quality
from itemweave.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules take for text."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that come earlier, give or take one character; documents left without a line go."""
    return drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at a similarity of 0.8."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return pack(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Weighed votes and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
