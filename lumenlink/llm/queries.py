"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenlink.llm.decontaminate import contaminated
from lumenlink.llm.dsir import importance_resampling
from lumenlink.llm.mixing import MIX_SQL, mix_sources
from lumenlink.llm.near import NEAR_SQL, near_duplicates
from lumenlink.llm.passages import near_passages
from lumenlink.llm.pii import pseudonymise
from lumenlink.llm.rules import decision_list
from lumenlink.llm.store import ship
from lumenlink.llm.suffix import cut_repeats
from lumenlink.llm.urls import URL_SQL, page_captures, page_entries, temporal_filter
from lumenlink.llm.warc import WARC_SQL, round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents with surrogates for personal data, and the number of entities."""
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the learned list for every document."""
    return decision_list(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, judged by the list entries active when it was fetched."""
    pages = _table(spark, sf_dir, "pages")
    return temporal_filter(page_captures(pages), page_entries(pages))


def op4_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when 400-byte strings that start elsewhere too are removed."""
    return cut_repeats(_table(spark, sf_dir, "documents"))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of every document."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it, with the place and the edits."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, Gumbel key and verdict of every document."""
    return importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, found through the index and read back."""
    return round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by 4-word shingles at 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate passages of all documents with their partners."""
    return near_passages(_table(spark, sf_dir, "documents"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name; those that run Python on the executors send the package there first if they must."""
    native = (op3_temporal_url_list, op5_water_filling)
    python = (op1_pii_surrogates, op2_decision_list, op4_columnwise_suffix_dedup, op6_cgk_decontamination, op7_importance_resampling, op8_warc_index, op9_minhash_inverted_join, op10_compact_windows)
    found = {f.__name__: f for f in native} | {f.__name__: _shipped(f) for f in python}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_temporal_url_list": URL_SQL, "op5_water_filling": MIX_SQL, "op8_warc_index": WARC_SQL, "op9_minhash_inverted_join": NEAR_SQL}
