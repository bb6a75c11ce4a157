"""The corpus pipeline: documents through toxicity, line and near-duplicate filters, decontamination and tokenisation.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame;
all but the last return the columns of documents. The whole has no SQL: a fitted classifier, similarity
search and Viterbi decoding decide its rows; the tests hold each stage against brute force.

Every stage takes nulls in any column, empty and very long texts, repeated rows, other columns of any name, and no rows at
all: a null or empty text is clean, shares no lines, is nobody's copy, holds no benchmark item, and has no pieces; rows that repeat a
doc_id and its text are copies of each other only in that they are kept or dropped together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import decontaminate, linedup, neardup, toxicity, unigram
from sediment.llm.frames import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(spark, docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share; n_chars follows the text."""
    out = linedup.dedup_lines(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; a row without an id stays.

    Rows go by doc_id and text, so another text of the same doc_id stays. Up to neardup.TOLD of them are told to all tasks.
    """
    found = neardup.marked_rows(spark, docs)
    a, b = f"id{uuid.uuid4().hex}", f"hash{uuid.uuid4().hex}"  # names that no column of docs has
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct()
    gone = Scratch(spark).save(gone, narrow=True)
    if gone.count() <= neardup.TOLD:
        gone = F.broadcast(gone)
    same = (F.col("doc_id").cast("bigint") == F.col(a)) & (neardup.text_hash("text") == F.col(b))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; text is what decoding these gives."""
    return unigram.encode(spark, docs, decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that every stage keeps, as the last stage returns them."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
