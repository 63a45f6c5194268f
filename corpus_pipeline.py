"""A corpus cleaned and packed in five stages, each of which calls one operator of ``stillkeep.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import stored, table, without
from stillkeep.llm.decontaminate import decontaminate
from stillkeep.llm.exact_dedup import exact_dedup
from stillkeep.llm.near_dedup import near_dedup
from stillkeep.llm.packing import packed_documents
from stillkeep.llm.toxicity import toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go; the model is fitted on these documents and their labels.

    A null or empty text has the score of a text without any sign and stays; repeated rows are judged alike.
    """
    return without(docs, toxicity(docs, table(spark, sf_dir, "labels"), 0.3).where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest doc_id; null counts as empty.

    Rows that repeat that doc_id and text stay together; a null id is the smallest.
    """
    return without(docs, exact_dedup(docs).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; sets of five words, similarity of 0.8 or more.

    Texts without words stay; a row without an id goes where its set has one; another text under a repeated doc_id is judged by itself.
    """
    return without(docs, near_dedup(docs, words=5, num=80, den=100).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go.

    Null and empty texts stay; another text under a repeated doc_id is judged by itself, and so are rows without an id.
    """
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; a null text is the end id alone, rows repeat."""
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learned score, a candidate search and a tokeniser are not SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
