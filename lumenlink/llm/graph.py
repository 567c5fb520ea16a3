"""Connected components of an undirected edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlink.llm.store import keep


def _neighbours(edges: DataFrame, both: bool) -> DataFrame:
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: each node's neighbours are tied to the least of them.

    The least neighbour comes from an aggregate with map-side combine and is joined back, so a
    node with very many neighbours is never gathered in one task.
    """
    n = _neighbours(edges, both)
    least = n.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = n.join(least, "u")
    if both:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(tied.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while not np.array_equal(jump := new[new], new):
            new = jump
        new = new[low]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _contract(batches):
    """The edges of a task -> (node, least node reachable over them)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, low = union(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["a", "b"])


#: Edges that one task contracts at most on average.
TASK_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, comp) for every node of an edge; comp is the least node reachable.

    Tasks first contract their own shares of the edges, of a bounded size, again and again while that makes
    them much fewer; that is all if one task comes to hold them.  Otherwise alternating large-star and
    small-star steps follow, each round written to the shared folder; only one row of counts reaches the driver.
    """
    e = keep(edges.select("a", "b").where("a <> b"), "edges")
    n = e.count()
    while n > TASK_EDGES:
        e = keep(e.repartition(-(-n // TASK_EDGES)).mapInArrow(_contract, "a long, b long").where("a <> b"), "contracted")
        was, n = n, e.count()
        if n > 0.7 * was:
            break
    if n <= TASK_EDGES:
        return e.repartition(1).mapInArrow(_contract, "node long, comp long")
    before = None
    while True:
        e = keep(_star(_star(e, True), False), "stars")
        state = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
