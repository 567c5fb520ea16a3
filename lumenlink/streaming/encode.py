"""Linkage of a stream of records against a standing record set.

Encoders and block keys are column expressions, so they run unchanged on a streaming frame; each
micro-batch is joined with the standing set's blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlink.functions import text as X
from lumenlink.operators import blocking, encoders, linkage


def encode(records: DataFrame, attrs: list[str], block_attr: str, k: int = 10, n: int = 1000, q: int = 2) -> DataFrame:
    """Records, streaming or not, with grams, the filter's bits and the block key."""
    grams = X.record_qgrams([F.col(a) for a in attrs], q)
    return records.withColumn("grams", grams).withColumn("bits", encoders.clk(F.col("grams"), k, n)).withColumn("block_key", blocking.soundex_key(F.col(block_attr)))


def link_batch(batch: DataFrame, standing: DataFrame, n: int, least: float) -> DataFrame:
    """Pairs of a batch and the standing set, both encoded, with a filter similarity of at least ``least``."""
    keys = lambda df: df.select("entity_id", "block_key").distinct()
    return linkage.link_bits(batch, standing, keys(batch), keys(standing), "bits", n, least)


def link_stream(stream: DataFrame, standing: DataFrame, attrs: list[str], block_attr: str, sink: Callable[[DataFrame, int], None], checkpoint: str, least: float = 0.8, n: int = 1000) -> StreamingQuery:
    """Run ``sink(pairs, batch id)`` for every micro-batch; a sink that replaces by batch id makes it exactly once."""
    known = encode(standing, attrs, block_attr, n=n)

    def each(batch: DataFrame, number: int) -> None:
        sink(link_batch(encode(batch, attrs, block_attr, n=n), known, n, least), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def bit_counts(stream: DataFrame, bits: Column) -> DataFrame:
    """Running (bit, freq) of the filters seen so far, for complete or update mode."""
    return stream.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("freq"))
