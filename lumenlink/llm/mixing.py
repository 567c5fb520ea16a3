"""Mixing sources to target weights by capped water-filling.

Targets are shares of a budget in proportion to weights; a source stops at ``most`` times its
size and what it cannot take is shared out again by weight among the others until none is above.
Each round is one aggregate over the table of sources: it clamps what the level of the round before
overfills and gives the next level, which only rises.  Documents are then taken in the order of a
keyed hash: whole repetitions of all of them, and of the fraction that remains the documents up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlink.llm.store import keep

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_turn(sources: DataFrame) -> DataFrame:
    """``sources`` with their places, from 0, in ascending order of the source, null last.

    Sources are sorted in ranges; a place is that inside its range after the sizes of the ranges
    before it, of which there are as many as shuffle partitions.
    """
    order = F.col("source").asc_nulls_last()
    ranged = keep(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return inside.join(before, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def water_fill(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size), sources distinct -> these, target.

    Sources in ascending order, null last, weigh ``weights`` in turn; the budget is the sum of the sizes.
    """
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    s = in_turn(sources.select("source", "source_size")).withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), turn + 1))
    s = keep(s.withColumn("cap", F.col("source_size") * most).drop("place"), "weights")
    wide = "decimal(19,0)"
    budget, left, share = s.agg(F.sum("source_size"), F.sum("source_size"), F.sum("weight")).first()
    while True:
        # Sources at their cap: cap / weight <= left / share, without division.
        full = F.col("cap").cast(wide) * F.lit(share or 0).cast(wide) <= F.col("weight").cast(wide) * F.lit(left or 0).cast(wide)
        taken, rest = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest or (budget - (taken or 0), rest) == (left, share):
            break
        left, share = budget - (taken or 0), rest
    level = (F.col("weight") * F.lit(left or 0)).cast("double") / F.lit(float(share or 1))
    return s.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(level).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix-17") -> DataFrame:
    """One row per row of ``docs``: the id, size, source_size, target, taken, source.

    size counts words (null text: 0).  taken is floor(target / source_size) whole repetitions of the
    document and its part of the rest, which goes to the documents of the source in the order of
    md5(seed:id), the last one partly, so that each source's sum is its target rounded.  Ties in
    that order fall to the smaller id, then size; equal rows are interchangeable.  Null sources are
    one source, the last.  An empty table gives none; other columns are not read.

    A source's running total is taken in two levels - over 4096 hash ranges, then inside each - so
    that no task has to hold a source.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    # Words are counted once; what is kept has no text.
    rows = keep(rows, "sizes").withColumn("range", F.substring("key", 1, 3)).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull())
    by = ["name", "nameless", "range"]
    ranges = rows.groupBy(*by).agg(F.sum("size").alias("size"))
    named = F.when(F.col("nameless"), F.lit(None)).otherwise(F.col("name"))
    totals = ranges.groupBy("name", "nameless").agg(F.sum("size").alias("source_size"))
    targets = water_fill(totals.select(named.alias("source"), "source_size"), weights, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target")
    before = ranges.withColumn("before", F.sum("size").over(W.partitionBy("name", "nameless").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).drop("size")
    plan = before.join(targets, ["name", "nameless"])
    inside = W.partitionBy(*by).orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(plan, by)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - whole * F.col("source_size") + F.lit(0.5)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before") - F.col("within")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), F.col("source").alias(source_col))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, row_number() OVER o AS rnk,
         CAST(sum(source_size) OVER () - sum(cap) OVER o + cap AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT rnk, rest, weights FROM r WHERE cap * weights > weight * rest ORDER BY rnk LIMIT 1),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN f.rnk IS NULL OR r.rnk < f.rnk THEN CAST(r.cap AS DOUBLE) ELSE CAST(r.weight * f.rest AS DOUBLE) / f.weights END AS target
  FROM r LEFT JOIN f ON true),
p AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ASC NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p
"""
