"""From raw documents to packed training sequences: five stages, each a whole operator.

Every stage takes all its predecessor kept and returns the columns of ``documents``; the last returns
pieces of packed sequences. Between stages the documents are a Parquet table in the shared folder, so
a lost executor repeats tasks of one stage only.

Defined results: null texts and texts without words fall to the first stage's base rule; rows with null or repeated ids are
documents of their own, told apart by their texts; of rows alike in every word one stays; further columns, of
whatever name, are carried to the last stage; an empty table gives an empty result; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import stored, table
from pointloom.llm.mixing import resampled
from pointloom.llm.near import one_of_each
from pointloom.llm.packing import packed
from pointloom.llm.pii import key_of, without_pii
from pointloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced within its format, under the key of the session (see ``key_of``)."""
    return without_pii(docs, key_of(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come twice."""
    return resampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pseudonyms), ("mixing", mixing), ("packing", packing)]

#: Tokens and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
