"""A corpus from documents: quality, near duplicates, benchmark leaks, personal data, mixture.

Each stage maps (spark, docs, sf_dir) to a DataFrame, which is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents; the last returns, for
each document of the mixture, how many of its words are taken.

All stages give an empty table for an empty one, treat repeated rows alike and pass further columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlink.llm.decontaminate import decontaminated
from lumenlink.llm.dsir import resampled
from lumenlink.llm.mixing import mix_sources
from lumenlink.llm.near import one_of_each
from lumenlink.llm.pii import pseudonymise
from lumenlink.llm.store import keep, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps.  Texts without a word, null and empty ones too, go; rows with equal keys stay or go together."""
    return resampled(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8), that with the least id.  Texts without a word are in no group and stay; rows without an id cannot be told apart."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item of five words or more.  Null and empty texts stay."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data.  Null and empty texts stay as they are."""
    return pseudonymise(docs, count_col=None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the words taken, repeats counted.  Null texts have no words and are not taken; null sources are one source."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL expresses neither the fitted model nor the keyed surrogates; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
