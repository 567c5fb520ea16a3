"""Precision, recall and F1; confusion counts over a threshold sweep; record statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(11)]


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def prf_distance(pairs: DataFrame, threshold: float, true: str = "true_dis", estimated: str = "est_dis") -> DataFrame:
    """One row: counts and precision, recall, F1 of "distance <= threshold", each row counting ``pairs`` times; null where a ratio is undefined."""
    is_, said = F.col(true) <= threshold, F.col(estimated) <= threshold
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("pairs"))), F.lit(0))
    c = pairs.agg(tally(said & is_).alias("tp"), tally(said & ~is_).alias("fp"), tally(~said & ~is_).alias("tn"), tally(~said & is_).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "tn", "fn", F.round(_ratio(tp, tp + fp), 9).alias("precision"), F.round(_ratio(tp, tp + fn), 9).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


def threshold_sweep(pairs: DataFrame, left: DataFrame | int, right: DataFrame | None = None, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, tn, fn) of similarity >= threshold; pairs have entity_a, entity_b, sim, and equal ids are true.

    All pairs of ``left`` and ``right`` count; their number is a row of its own, counted when the sweep runs,
    unless ``left`` is that number.

    True pairs below a threshold count as missed only if they are among ``pairs``.
    """
    match = F.col("entity_a") == F.col("entity_b")
    at = pairs.select(match.alias("match"), "sim").groupBy("match", "sim").agg(F.count(F.lit(1)).alias("n"))
    return counted_sweep(at, left, right, thresholds)


def counted_sweep(at: DataFrame, left: DataFrame | int, right: DataFrame | None = None, thresholds: list[float] = THRESHOLDS, by: tuple[str, ...] = ()) -> DataFrame:
    """As threshold_sweep, of (match, sim, n), n pairs each, for each value of ``by``."""
    long = at.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    hit = F.col("sim") >= F.col("threshold")
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = long.groupBy(*by, "threshold").agg(tally(hit & F.col("match")).alias("tp"), tally(hit & ~F.col("match")).alias("fp"), tally(~hit & F.col("match")).alias("fn"))
    size = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    known = right is None
    all_of = F.lit(left).cast("long") if known else F.col("_left") * F.col("_right")
    out = out if known else out.crossJoin(F.broadcast(size(left, "_left").crossJoin(size(right, "_right"))))
    return out.select(*by, "threshold", "tp", "fp", (all_of - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "fn")


def precision_recall(sweep: DataFrame) -> DataFrame:
    """Precision and recall to four places, 0 where undefined."""
    part = lambda a, b: F.round(F.coalesce(_ratio(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 4)
    return sweep.select(*(c for c in sweep.columns if c not in ("tp", "fp", "tn", "fn")), part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"))


def duplicate_grams(grams: Column) -> tuple[Column, Column]:
    return F.size(grams), F.size(grams) - F.size(F.array_distinct(grams))


def bits_per_gram(bits: Column, grams: Column) -> Column:
    """Set bits over grams; null without grams."""
    return _ratio(F.size(bits), F.size(grams))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 60) -> DataFrame:
    """(bin, n): equal bins, the last one closed; values outside are left out."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
