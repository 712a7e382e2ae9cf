"""The corpus pipeline: toxic documents and copies go, sources are mixed, and what is left is encoded."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treadline.llm import bpe, exact, mixing, neardup, toxicity
from treadline.llm.catalog import vocabulary
from treadline.llm.common import table
from treadline.session import materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models take for toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest id stays."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays."""
    return neardup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass in which a document gives words to the mix, with the words that it gives."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, for every row of the mix."""
    return bpe.encoded(docs, vocabulary())


STAGES = [("toxicity", toxic), ("exact dedup", copies), ("MinHash near-dedup", near_copies), ("mixing sources", mix), ("BPE", encode)]

#: Models, signatures and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
