"""Corpus pipeline: ordinary documents, without repeated lines and near copies, mixed to weights and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last keep
the columns of their input, whatever others it has; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from orrery.llm.shared import table, written


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject.

    Each row is judged by its own text, so repeated rows go or stay together; null and empty texts hold
    no evidence and stay, as do null identifiers; texts of any length are read whole.
    """
    return toxicity.ordinary_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats.

    Earlier is by identifier, nulls last, then by line. Every row stays: one whose lines all go, with an
    empty text; null texts stay null; rows that repeat a row keep their lines as that one does.
    """
    return line_dedup.deduplicated_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.

    The one with the smallest identifier stays, with all rows of that identifier. Documents without words and rows
    without identifier are linked with nothing and stay.
    """
    return near_dedup.distinct_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them.

    Null languages and sources are leaves of their own; empty texts hold no tokens and come with
    the epoch in which they stand; repeated rows share a place in the order and are taken together.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    One row for each row of ``docs``; null counts as empty, an empty text has no ids.
    """
    return bpe.encoded_documents(docs)


STAGES = [("toxicity", ordinary), ("line_dedup", lines), ("near_dedup", distinct), ("mixing", mixed), ("bpe", encoded)]

#: SQL expresses neither the toxicity models nor BPE; the tests hold the pipeline against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
