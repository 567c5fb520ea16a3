"""Pairs of two record sets that share a block, their similarity, and the quality of a threshold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import coins as C


def shared_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """The keys of both sides, with the sizes of their blocks."""
    size = lambda t, c: t.groupBy("block_key").agg(F.count(F.lit(1)).alias(c))
    return size(left, "n_left").join(size(right, "n_right"), "block_key")


def candidates(left: DataFrame, right: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct (entity_a, entity_b) that share a block.  Only ids go through the join; vectors are attached later.

    ``most`` deals blocks with more records of the left side into parts of about that many, each of which
    meets the whole right side of the block in a task of its own; the pairs are the same.
    """
    a = left.select(F.col("entity_id").alias("entity_a"), "block_key")
    b = right.select(F.col("entity_id").alias("entity_b"), "block_key")
    keys = ["block_key"]
    if most is not None:
        parts = left.groupBy("block_key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1")
        dealt = lambda side: side.join(parts, "block_key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        a = dealt(a).withColumn("_part", F.expr("cast(pmod(xxhash64(entity_a), _parts) as int)"))
        b = dealt(b).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        keys.append("_part")
    return a.join(b, keys).select("entity_a", "entity_b").distinct()


def dice_sets(a: Column, b: Column) -> Column:
    """2 |A & B| / (|A| + |B|) of distinct grams; null where both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double") * 2.0, (F.size(x) + F.size(y)).cast("double"))


def dice_bag(a: Column, b: Column) -> Column:
    """2 x the grams of b, repeats counted, that occur in a, over the sum of both lengths; null where both are empty."""
    hits = F.size(F.filter(b, lambda x: F.array_contains(a, x)))
    return F.try_divide(hits.cast("double") * 2.0, (F.size(a) + F.size(b)).cast("double"))


def dice_bits(words_a: list[Column], words_b: list[Column], ones_a: Column, ones_b: Column) -> Column:
    """Dice of packed vectors; 0 where both are empty."""
    return F.coalesce(B.dice(B.common(words_a, words_b), ones_a, ones_b), F.lit(0.0))


def link_grams(a: DataFrame, b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame, least: float) -> DataFrame:
    """(entity_a, entity_b, sim) of the candidates with gram similarity of at least ``least``; frames have entity_id, grams."""
    pairs = candidates(blocks_a, blocks_b)
    left = a.select(F.col("entity_id").alias("entity_a"), F.array_distinct("grams").alias("grams_a"))
    right = b.select(F.col("entity_id").alias("entity_b"), F.array_distinct("grams").alias("grams_b"))
    sim = F.try_divide(F.size(F.array_intersect("grams_a", "grams_b")).cast("double") * 2.0, (F.size("grams_a") + F.size("grams_b")).cast("double"))
    return pairs.join(left, "entity_a").join(right, "entity_b").select("entity_a", "entity_b", sim.alias("sim")).where(F.col("sim") >= least)


def packed(df: DataFrame, bits: str, n: int) -> DataFrame:
    """entity_id, the words of a filter and its ones, computed once for each record."""
    return df.select("entity_id", *(c.alias(k) for k, c in B.words(F.col(bits), n).items()), F.size(bits).alias("ones"))


def link_bits(a: DataFrame, b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame, bits: str, n: int, least: float) -> DataFrame:
    """As link_grams, on filters of n bits.  A bound on the ones drops pairs that cannot reach ``least`` before the words meet."""
    w = [f"w{k}" for k in range(-(-n // 64))]
    left = packed(a, bits, n).select(F.col("entity_id").alias("entity_a"), *(F.col(c).alias(f"{c}_a") for c in w), F.col("ones").alias("ones_a"))
    right = packed(b, bits, n).select(F.col("entity_id").alias("entity_b"), *(F.col(c).alias(f"{c}_b") for c in w), F.col("ones").alias("ones_b"))
    pairs = candidates(blocks_a, blocks_b).join(left, "entity_a").join(right, "entity_b")
    reach = F.least("ones_a", "ones_b") * 2.0 >= least * (F.col("ones_a") + F.col("ones_b"))
    sim = dice_bits([F.col(f"{c}_a") for c in w], [F.col(f"{c}_b") for c in w], F.col("ones_a"), F.col("ones_b"))
    return pairs.where(reach).select("entity_a", "entity_b", sim.alias("sim")).where(F.col("sim") >= least)


#: Records of each side whose similarities lie side by side.
TILE = 1024


def _unpacked(column: pa.ChunkedArray, rows: np.ndarray, n: int) -> np.ndarray:
    packed = b"".join(v.as_py() for v in column.combine_chunks().take(pa.array(rows)))
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, :n]


def _tiles(group: pa.Table, vector: str, n: int):
    """(rows of side a, rows of side b, common positions, ones of a, ones of b) of a group whose ``_side`` is true for b."""
    side = group["_side"].to_numpy()
    a, b = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(a) or not len(b):
        return
    left, right = _unpacked(group[vector], a, n), _unpacked(group[vector], b, n)
    ones = left.sum(axis=1, dtype=np.int64), right.sum(axis=1, dtype=np.int64)
    for j in range(0, len(b), TILE):
        of_b = right[j : j + TILE].astype(np.float32).T
        for i in range(0, len(a), TILE):
            yield a[i : i + TILE], b[j : j + TILE], left[i : i + TILE].astype(np.float32) @ of_b, ones[0][i : i + TILE], ones[1][j : j + TILE]


def _sims(both: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As dice_bits, on arrays."""
    return np.where(ones > 0, both.astype(np.float64) * 2.0 / np.maximum(ones, 1), 0.0)


#: So many positions are first counted as one, and the share of pairs that may pass then; of more, they are counted one by one.
FOLD, PASSED = 2, 0.05


def _folded(words: np.ndarray, n: int, fold: int) -> np.ndarray:
    """Ones of each of the positions that are equal modulo the width n / fold."""
    bits, width = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n], -(-n // fold)
    return np.pad(bits, ((0, 0), (0, width * fold - n))).reshape(len(words), fold, width).sum(axis=1, dtype=np.uint8)


def _near(group: pa.Table, vector: str, n: int, least: float):
    """(rows of side a, rows of side b, similarity, words of a, words of b) of the pairs of a group that reach ``least``, tile by tile.

    The ones that two filters have in common are at most the product of their folded counts.  Products of floats below 2**24
    are exact; where by Cauchy-Schwarz they fit 24 / k bits, one float holds those of k filters.  Pairs that pass are compared by words.
    """
    sides = []
    for rows in (np.flatnonzero(~group["_side"].to_numpy()), np.flatnonzero(group["_side"].to_numpy())):
        packed = b"".join(v.as_py() for v in group[vector].combine_chunks().take(pa.array(rows)))
        words = np.frombuffer(packed, dtype=np.uint64).reshape(len(rows), -(-n // 64))
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        order = np.argsort(ones, kind="stable")
        sides.append((rows[order], words[order], ones[order]))
    (a, words_a, ones_a), (b, words_b, ones_b) = sides
    fold, most = FOLD, lambda f: float((f.astype(np.int64) ** 2).sum(axis=1).max())
    for j in range(0, len(b), 3 * TILE):
        w, o = words_b[j : j + 3 * TILE], ones_b[j : j + 3 * TILE]
        held = {}
        for i in range(0, len(a), TILE):
            u, p = words_a[i : i + TILE], ones_a[i : i + TILE]
            # sides are in order of their ones, so the ends of a tile bound its similarities
            if 2 * min(p[-1], o[-1]) < least * (p[0] + o[0]) or p[-1] == 0 or o[-1] == 0:
                continue
            if fold not in held:
                held[fold] = (f := _folded(w, n, fold), most(f), {})
            right, far, by = held[fold]
            left = _folded(u, n, fold)
            room = (most(left) * far) ** 0.5
            k = 3 if room < 255 else 2 if room < 4095 else 1
            if k not in by:
                f = np.pad(right, ((0, -len(right) % k), (0, 0))).astype(np.int32)
                by[k] = np.ascontiguousarray(sum(f[c::k] << (24 // k * c) for c in range(k)).T.astype(np.float32))
            met = (left.astype(np.float32) @ by[k]).astype(np.int32)
            need = np.maximum(1, np.ceil((p + o[0]) * (least / 2) - 1e-6)).astype(np.int64)[:, None]
            if k == 3:
                x, y = np.divmod(np.flatnonzero(met.view(np.uint8) >= np.minimum(need, 255).astype(np.uint8)), 4 * met.shape[1])
                y = y // 4 * 3 + y % 4
            else:
                parts = [np.nonzero((met >> (24 // k * c)) % (1 << 24 // k) >= need) for c in range(k)]
                x, y = np.concatenate([q[0] for q in parts]), np.concatenate([q[1] * k + c for c, q in enumerate(parts)])
            fold = 1 if len(x) > PASSED * len(p) * len(o) else fold
            for s in range(0, len(x), 1 << 16):
                c, d = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                sim = _sims(np.bitwise_count(u[c] & w[d]).sum(axis=1, dtype=np.int64), p[c] + o[d])
                c, d, sim = c[keep := sim >= least], d[keep], sim[keep]
                yield a[i + c], b[j + d], sim, u[c], w[d]


def _tasks(df: DataFrame) -> int:
    return 8 * df.sparkSession.sparkContext.defaultParallelism


def link_all(a: DataFrame, b: DataFrame, bits: str, n: int, least: float, blocks: int = 16, codes: Callable | None = None) -> DataFrame:
    """(entity_a, entity_b, sim) of all pairs whose filters of n bits reach ``least``, which is above 0.

    Both sides are dealt into blocks; each pair of blocks is a group, and one matrix product compares a tile of it.
    ``codes`` gives the block keys of rows of booleans, as bytes on a third axis; then only pairs that share one are returned.
    """
    mine = F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = lambda df, is_b: df.select("entity_id", C.packed(F.col(bits), n).alias("_vector"), F.lit(is_b).alias("_side"), mine.alias("_own")).select("entity_id", "_vector", "_side", "_own", every.alias("_other"))
    dealt = side(a, False).withColumns({"_x": F.col("_own"), "_y": F.col("_other")}).unionByName(side(b, True).withColumns({"_x": F.col("_other"), "_y": F.col("_own")})).drop("_own", "_other")

    def meet(group: pa.Table) -> pa.Table:
        ids, found = group["entity_id"].combine_chunks(), [[], [], []]
        for x, y, sim, left, right in _near(group, "_vector", n, least):
            if codes is not None:
                left, right = (codes(np.unpackbits(w.view(np.uint8), axis=1, bitorder="little")[:, :n]) for w in (left, right))
                shared = (left == right).all(axis=2).any(axis=1)
                x, y, sim = x[shared], y[shared], sim[shared]
            for out, part in zip(found, (x, y, sim), strict=True):
                out.append(part)
        x, y, sim = (np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found)
        return pa.table({"entity_a": ids.take(pa.array(x)), "entity_b": ids.take(pa.array(y)), "sim": sim.astype(np.float64)})

    kind = a.schema["entity_id"].dataType.simpleString()
    return dealt.repartition(_tasks(a), "_x", "_y").groupBy("_x", "_y").applyInArrow(meet, f"entity_a {kind}, entity_b {kind}, sim double")


def link_far(a: DataFrame, b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame, bits: str, n: int, least: float) -> DataFrame:
    """As link_bits with ``least`` above 0, for blocks that hold a large part of all records, such as those of filters' empty
    segments: first the pairs whose filters reach ``least``, then of these the pairs that share a block."""
    keys = lambda t, s: t.groupBy(F.col("entity_id").alias(f"entity_{s}")).agg(F.collect_set("block_key").alias(f"_keys_{s}"))
    pairs = link_all(a, b, bits, n, least).join(keys(blocks_a, "a"), "entity_a").join(keys(blocks_b, "b"), "entity_b")
    return pairs.where(F.arrays_overlap("_keys_a", "_keys_b")).select("entity_a", "entity_b", "sim")


def tallies(a: DataFrame, b: DataFrame, key: str, vectors: dict[str, tuple[str, int]], least: float, levels: list[float], most: int = 4096) -> DataFrame:
    """(config, match, sim, n): for each named vector (column, bits) the pairs of records that share the value of ``key``, one
    block for each record, and reach ``least``; similarities are lowered to the next of the rising ``levels``, those below
    the first to ``least``.  Equal ids match.

    A block is a group, and matrix products compare its tiles; blocks of more than ``most`` records of a side are
    dealt into parts that meet in groups of their own.
    """
    names, steps = list(vectors), np.array(levels)
    columns = [C.packed(F.col(c), n).alias(f"_v{k}") for k, (c, n) in enumerate(vectors.values())]
    parts = lambda df, c: df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(c)).where(F.col(c) > 1)
    many = parts(a, "_pa").join(parts(b, "_pb"), "_key", "full")

    def side(df, is_b):
        rows = df.where(F.col(key).isNotNull()).select("entity_id", F.col(key).alias("_key"), *columns, F.lit(is_b).alias("_side")).join(many, "_key", "left")
        own, other = ("_pb", "_pa") if is_b else ("_pa", "_pb")
        rows = rows.withColumn("_own", F.expr(f"cast(pmod(xxhash64(entity_id), coalesce({own}, 1)) as int)")).withColumn("_other", F.explode(F.expr(f"sequence(0, coalesce({other}, 1) - 1)")))
        return rows.withColumns({"_x": F.col("_other" if is_b else "_own"), "_y": F.col("_own" if is_b else "_other")}).drop("_pa", "_pb", "_own", "_other")

    sizes = [n for _, n in vectors.values()]

    def meet(group: pa.Table) -> pa.Table:
        _, code = np.unique(group["entity_id"].to_numpy(zero_copy_only=False), return_inverse=True)
        rows = []
        for k, name in enumerate(names):
            count = np.zeros((2, len(steps) + 1), dtype=np.int64)
            for x, y, both, ones_a, ones_b in _tiles(group, f"_v{k}", sizes[k]):
                sim = _sims(both, ones_a[:, None] + ones_b[None, :])
                for same, part in ((1, sim[code[x][:, None] == code[y][None, :]]), (0, sim)):
                    part = part[part >= least]
                    reach = np.array([len(part), *(np.count_nonzero(part >= t) for t in steps)])
                    reach[1:] = np.minimum(reach[1:], len(part))
                    at = reach - np.append(reach[1:], 0)
                    count[same] += at
                    count[0] -= at if same else 0
            rows += [(name, bool(same), float(least if not s else max(least, steps[s - 1])), int(count[same, s])) for same in (0, 1) for s in range(len(steps) + 1) if count[same, s]]
        config, match, sim, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"config": pa.array(config, pa.string()), "match": pa.array(match, pa.bool_()), "sim": pa.array(sim, pa.float64()), "n": pa.array(n, pa.int64())})

    met = side(a, False).unionByName(side(b, True)).repartition(_tasks(a), "_key", "_x", "_y")
    return met.groupBy("_key", "_x", "_y").applyInArrow(meet, "config string, match boolean, sim double, n bigint")


def link_both(a: DataFrame, b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame, bits: str, n: int) -> DataFrame:
    """(entity_a, entity_b, sim, es_sim): bag similarity of the grams and Dice of the filters, in one projection of one table of candidates."""
    w = [f"w{k}" for k in range(-(-n // 64))]
    side = lambda df, s: df.select(F.col("entity_id").alias(f"entity_{s}"), F.col("grams").alias(f"grams_{s}"), F.size(bits).alias(f"ones_{s}"), *(c.alias(f"{k}_{s}") for k, c in B.words(F.col(bits), n).items()))
    pairs = candidates(blocks_a, blocks_b).join(side(a, "a"), "entity_a").join(side(b, "b"), "entity_b")
    es_sim = dice_bits([F.col(f"{c}_a") for c in w], [F.col(f"{c}_b") for c in w], F.col("ones_a"), F.col("ones_b"))
    return pairs.select("entity_a", "entity_b", dice_bag(F.col("grams_a"), F.col("grams_b")).alias("sim"), es_sim.alias("es_sim"))


def reduction_ratio(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: candidates, records of both sides, and the share of all pairs that blocking saves."""
    n = pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
    a, b = left.agg(F.count(F.lit(1)).alias("n_left")), right.agg(F.count(F.lit(1)).alias("n_right"))
    ratio = F.lit(1.0) - F.try_divide(F.col("n_pairs").cast("double"), F.col("n_left").cast("double") * F.col("n_right"))
    return n.crossJoin(a).crossJoin(b).select("n_pairs", "n_left", "n_right", F.round(ratio, 6).alias("reduction_ratio"))
