"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models over hashed word 1-grams and 2-grams - one of target text, one of all raw
text - give every document the log importance weight sum(log p_target - log p_raw) over its
n-grams.  A sample without replacement in proportion to the weights is the top k of
log weight + Gumbel noise; the noise is a keyed hash of the document's id and text, so reruns agree.

Target text is the documents labelled good and not toxic, at most ``MAX_TARGET`` of them (the least by a
hash of the id).  One half of them fits the target model, the other half, which that model has
not seen, tells how far down the sample must reach; everything else covers all documents.  The
target's rate of a bucket is the raw one times a factor with a Gamma(``PRIOR``, ``PRIOR``) prior,
whose posterior mean is (seen + PRIOR) / (expected + PRIOR): n-grams too rare to judge weigh
nothing, and those that the target should hold and does not weigh much.  Only the two count vectors,
of the fixed length ``BUCKETS``, and the bounded label sample come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlink.llm import kernels as K
from lumenlink.llm.store import hash_sample, keep

BUCKETS = 1 << 18
#: Buckets of one row of partial counts.
CHUNK = 1 << 12
#: Labelled documents that the models and the size of the sample are fitted on, at most.
MAX_TARGET = 20_000
#: Share of the labelled good documents whose weight the sample must reach down to.
RETAINED = 0.995
PRIOR = 16.0


def _buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all 1-grams and 2-grams of a block, and the document of each."""
    w = K.Words(buf, offs)
    h = w.hashes()
    two = K.grams(h, 2)
    same = w.doc[1:] == w.doc[: len(two)] if len(h) > 1 else np.zeros(0, dtype=bool)
    top = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([h >> top, two[same] >> top]).astype(np.int64), np.concatenate([w.doc, w.doc[: len(two)][same]])


def _count(target: np.ndarray) -> Callable:
    """Partial counts of a task: rows (chunk, raw, target) of CHUNK counts each."""

    def run(batches):
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            mine = np.isin(ids, target) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, buf, offs in K.blocks(batch.column(1)):
                bucket, doc = _buckets(buf, offs)
                raw += np.bincount(bucket, minlength=BUCKETS)
                hit = bucket[mine[i:j][doc]]
                if len(hit):
                    good += np.bincount(hit, minlength=BUCKETS)
        yield _chunks(np.flatnonzero(raw.reshape(-1, CHUNK).any(1)), raw, good)

    return run


def _chunks(some: np.ndarray, raw: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
    rows = [x.reshape(-1, CHUNK)[some] for x in (raw, good)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in rows)], names=["chunk", "raw", "target"])


def _add(batches):
    """The sums of the partial counts of a task's chunks; it holds one vector at most, whatever the number of rows."""
    raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for chunk, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
            raw[at] += np.frombuffer(r, dtype=np.int64)
            good[at] += np.frombuffer(t, dtype=np.int64)
    yield _chunks(np.flatnonzero(raw.reshape(-1, CHUNK).any(1)), raw, good)


def log_ratio(raw: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from the counts of all text and of the target."""
    expected = hit.sum() * raw / max(1, raw.sum())
    factor = (hit + PRIOR) / (expected + PRIOR)
    return np.log(factor) - np.log(max((raw * factor).sum(), 1e-300) / max(1, raw.sum()) if raw.any() else 1.0)


def _scores(ids: pa.Array, texts: pa.Array, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams, log weight and Gumbel key of each row."""
    parts = []
    for i, j, buf, offs in K.blocks(texts):
        bucket, doc = _buckets(buf, offs)
        n = np.bincount(doc, minlength=j - i)
        weight = np.bincount(doc, weights=ratio[bucket], minlength=j - i).astype(np.float64)  # of nothing it counts in integers
        own = ids.slice(i, j - i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        body = K.Rolling(buf).of(offs[:-1], offs[1:])
        u = (K.mix(K.mix(own + np.uint64(seed)) ^ body) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        parts.append((n, weight, weight - np.log(-np.log(u))))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _order(key: np.ndarray) -> np.ndarray:
    """Keys as longs in steps of 2**-20, which keep their order."""
    return np.floor(key * (1 << 20)).astype(np.int64)


def _weigh(ratio: np.ndarray, seed: int) -> Callable:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, weight, key = _scores(batch.column(0), batch.column(1), ratio, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(key, mask=n == 0), pa.array(_order(key), mask=n == 0)], names=["id", "n", "log_weight", "gumbel_key", "step"])

    return run


def _filter(ratio: np.ndarray, seed: int, cut: int, id_at: int, text_at: int) -> Callable:
    """The rows whose key reaches the cut, all columns as they are."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, _, key = _scores(batch.column(id_at).cast(pa.int64()), batch.column(text_at), ratio, seed)
                yield batch.filter(pa.array((n > 0) & (_order(key) >= cut)))

    return run


def kth_largest(df: DataFrame, key: str, k: int, bits: int = 16) -> int | None:
    """The k-th largest value of a long column, by counting its digits from the top.

    Each pass counts one digit of the values that share the digits found so far, so the driver
    gets at most 2**bits counts and no task gathers values.
    """
    if k <= 0:
        return None
    prefix, shift = None, 64
    while shift > 0:
        shift -= bits
        part = df if prefix is None else df.where(F.shiftright(key, shift + bits) == prefix)
        rows = part.groupBy(F.shiftright(key, shift).alias("digit")).count().collect()
        for digit, n in sorted(((r[0], r[1]) for r in rows), reverse=True):
            if k <= n:
                prefix = digit
                break
            k -= n
        else:
            return None
    return prefix


LEAST = -(1 << 63)


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, good: str, seed: int, retained: float) -> tuple[DataFrame, object, int]:
    """The weighed rows, the broadcast model, and the step that the keys of the sample reach."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    named = lambda rule: labels.where(rule).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    chosen = named(good)
    toxic = named(TOXIC) if "toxic" in labels.columns else chosen.limit(0)
    chosen = chosen.join(toxic.withColumn("toxic", F.lit(True)), "id", "left")
    sample = hash_sample(chosen, "id", MAX_TARGET).collect()
    # Toxic ones leave the halves that they are in, so the halves do not depend on them.
    target, unseen = (np.sort(np.array([r.id for r in sample[k::2] if not r.toxic], dtype=np.int64)) for k in (0, 1))
    schema = "chunk long, raw binary, target binary"
    counts = rows.mapInArrow(_count(target), schema).repartition("chunk").mapInArrow(_add, schema)
    raw, hit = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for chunk, r, t in counts.collect():
        at = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        raw[at], hit[at] = np.frombuffer(r, dtype=np.int64), np.frombuffer(t, dtype=np.int64)
    ratio = log_ratio(raw, hit)
    table = spark.sparkContext.broadcast(ratio)
    weighed = keep(rows.mapInArrow(lambda batches: _weigh(table.value, seed)(batches), "id long, n long, log_weight double, gumbel_key double, step long"), "weighed")
    some = weighed.where("n > 0")
    # The ids are at most MAX_TARGET / 2 longs.
    known = some.join(F.broadcast(spark.createDataFrame([(int(x),) for x in unseen], "id long")), "id", "left_semi")
    floor = known.select(F.expr(f"percentile(log_weight, {1 - retained})")).first()[0]
    if floor is None:
        return weighed, table, LEAST
    cut = kth_largest(some, "step", some.where(F.col("log_weight") >= floor).count())
    return weighed, table, LEAST if cut is None else cut


GOOD, TOXIC = "quality = 1", "toxic = 1"


def importance_resampling(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = GOOD, seed: int = 20, retained: float = RETAINED) -> DataFrame:
    """One row per row of ``docs``: id, n_grams, log_weight, gumbel_key, kept.

    kept marks the k documents with the largest Gumbel keys, where k counts the documents whose
    weight is at least that which all but ``1 - retained`` of the labelled good ones reach.
    Documents without a word (null and empty texts too) have no key and are not kept.  Rows with
    equal keys are kept or dropped together.  Documents labelled toxic, in a row of any quality, are
    no target and do not set k; a null in toxic, or no such column, says nothing.  Without labelled
    good documents every document with a word is kept.  Only the id, the text and the labels' columns are read.
    """
    weighed, _, cut = fit_sample(docs, labels, id_col, text_col, good, seed, retained)
    kept = F.coalesce(F.col("step") >= F.lit(cut), F.lit(False))
    return weighed.select(F.col("id").alias(id_col), F.col("n").alias("n_grams"), "log_weight", "gumbel_key", kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = GOOD, seed: int = 20, retained: float = RETAINED) -> DataFrame:
    """The rows and columns of ``docs`` that ``importance_resampling`` keeps; the last pass only filters, without a join."""
    _, table, cut = fit_sample(docs, labels, id_col, text_col, good, seed, retained)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _filter(table.value, seed, cut, id_at, text_at)(batches), docs.schema)
