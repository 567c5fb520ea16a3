"""Golden values and properties of the column functions."""

import hmac
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlink.functions import bits as B
from lumenlink.functions import coins
from lumenlink.functions import hashing as H
from lumenlink.functions import text as X
from lumenlink.functions.jrandom import JavaRandom, coefficients, pair_draws
from lumenlink.operators import blocking, encoders, hardening, linkage, metrics, numeric
from lumenlink.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_grams(spark):
    g = lambda s, **k: one(spark, X.qgrams(F.lit(s), 2, **k))
    assert g("banana") == ["ba", "an", "na", "an", "na"]
    assert g("123") == ["1", "2", "3"] and g("") == [] and g("a") == []
    assert g("ab", padded=True) == ["_a", "ab", "b_"]
    assert one(spark, X.counted(X.qgrams(F.lit("banana"), 2))) == ["ba1", "an1", "na1", "an2", "na2"]
    assert one(spark, X.qgrams(F.lit("x"), 1)) == ["x"]


@pytest.mark.parametrize("name,code", [("Rossi", "r200"), ("Pfister", "p123"), ("Tymczak", "t520"), ("Ashcraft", "a261"), ("Honeyman", "h500"), ("", "0000"), ("1bf", "1000")])
def test_soundex(spark, name, code):
    assert one(spark, X.soundex_variant(F.lit(name))) == code


@pytest.mark.parametrize(
    "family,want",
    [
        ("dh", [664, 288, 912, 536, 808, 432, 56, 680, 304, 928]),
        ("edh", [664, 665, 669, 679, 699, 734, 790, 874, 994, 159]),
        ("rh", [872, 312, 817, 914, 512, 443, 47, 85, 461, 760]),
        ("hmac", [741, 176, 611, 46, 481, 916, 351, 786, 221, 656]),
    ],
)
def test_hash_families(spark, family, want):
    assert one(spark, H.family(family)(F.lit("an"), 10, 1000)) == want


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        H.family("zz")
    with pytest.raises(ValueError):
        hardening.harden(spark.range(1), "b", 8, "id", "what")


def test_hmac(spark):
    assert one(spark, H.hmac_digest(F.lit("an"), "bloomfilter")) == "7422c47eae1bb9b32756db08989294221cae4065"
    assert one(spark, H.hmac_digest(F.lit("ü"), "k" * 80, "md5")) == hmac.new(b"k" * 80, "ü".encode(), "md5").hexdigest()


def test_seeded_draws():
    assert pair_draws(1000)[:5] == [(130, 763), (248, 884), (970, 525), (505, 918), (519, 93)]
    assert JavaRandom(42).permutation(2000)[:8] == [1712, 944, 251, 1251, 850, 1719, 525, 706]
    assert JavaRandom(42).permutation(1000)[:8] == [572, 653, 636, 6, 892, 569, 525, 905]
    assert coefficients(160)[0][:4] == [1709459168, 803930606, 172412737, 173204059]


def test_s_curve():
    t, points = blocking.s_curve(32, 5)
    assert t == 0.5
    assert [round(p, 5) for _, p in points] == [0, 0.00032, 0.01019, 0.0749, 0.28062, 0.63794, 0.92501, 0.99723, 1.0, 1.0]


def test_urap_parameters():
    assert [round(x, 6) for x in hardening.urap_parameters(1)] == [0.622459, 0.377541, 0.606531]
    assert [round(x, 6) for x in hardening.urap_parameters(2)] == [0.731059, 0.268941, 0.367879]


def bits_of(n, seed):
    r = JavaRandom(seed)
    return sorted({r.next_int(n) for _ in range(n // 4)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hardening_against_plain_loops(spark, seed):
    n = 60
    b = bits_of(n, seed)
    v = [int(i in b) for i in range(n)]
    c = F.array(*(F.lit(x) for x in b))
    up = lambda w: [i for i, x in enumerate(w) if x]
    assert one(spark, hardening.rule90(c, n)) == up(v[i - 1] ^ v[(i + 1) % n] for i in range(n))
    assert one(spark, hardening.xor_fold(c, n)) == up(v[i] ^ v[i + n // 2] for i in range(n // 2))
    w = list(v)
    for i in range(n):
        w[i] ^= w[(i + 1) % n]
    assert sorted(one(spark, hardening.wxor(c, n))) == up(w)
    assert one(spark, hardening.resample_xor(c, n)) == up(v[p] ^ v[q] for p, q in pair_draws(n))
    both = v + [1 - x for x in v]
    assert one(spark, hardening.balance(c, n)) == up(both[p] for p in JavaRandom(42).permutation(2 * n))
    assert one(spark, hardening.blip(c, n, F.lit(5), 0.0)) == b
    assert len(one(spark, hardening.compress(c, n, 0.2))) in (len(b), *range(len(b)))
    assert set(b) <= set(one(spark, hardening.uldp(c, n, F.lit(5))))


def test_words(spark):
    a, b = bits_of(200, 1), bits_of(200, 9)
    x, y = (F.array(*(F.lit(p) for p in v)) for v in (a, b))
    wa, wb = list(B.words(x, 200).values()), list(B.words(y, 200).values())
    assert one(spark, B.common(wa, wb)) == len(set(a) & set(b))
    assert one(spark, B.hamming(wa, wb)) == len(set(a) ^ set(b))


def test_dice(spark):
    arr = lambda *v: F.array(*(F.lit(x) for x in v)).cast("array<string>")
    assert one(spark, linkage.dice_sets(arr("a", "b", "b"), arr("b", "c"))) == 0.5
    assert one(spark, linkage.dice_bag(arr("a", "b"), arr("b", "b", "c"))) == 0.8
    assert one(spark, linkage.dice_sets(arr(), arr())) is None


def test_optimal_k_and_encoders(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c", "d", "e", "f"],)], "grams array<string>")
    assert encoders.optimal_k(df, df, "grams", 1000).first().k == math.floor(math.log(2) * 1000 / 3 + 0.5)
    both = encoders.rbf([F.array(F.lit("an")), F.array(F.lit("na"))], 10, 1000)
    assert 10 < len(one(spark, both)) <= 20


def test_all_pairs_in_blocks(spark):
    df = spark.range(57).select("id", (F.col("id") * 1.0).alias("value"))
    for size in (1000, 10, 7):
        got = {(r.id_a, r.id_b) for r in numeric.all_pairs(df, "id", ["value"], size).collect()}
        assert got == {(a, b) for b in range(57) for a in range(b)}


def test_precision_recall_of_nothing(spark):
    empty = spark.createDataFrame([], "entity_a string, entity_b string, sim double")
    assert metrics.threshold_sweep(empty, 10).count() == 0
    sweep = spark.createDataFrame([(0.5, 0, 0, 10, 0)], "threshold double, tp long, fp long, tn long, fn long")
    assert tuple(metrics.precision_recall(sweep).first()) == (0.5, 0.0, 0.0)


def test_coins_of_a_batch_are_the_keyed_coins(spark):
    ids = ["1", "22", "", "é" * 3, "a" * 41, "b" * 47, "c" * 130, None]
    batch = coins.Coins("s", ids)
    some = np.array([0, 7, 10, 99, 100, 999, 1000])
    grid, at = batch.grid(some, "fair"), batch.at(np.repeat(np.arange(len(ids)), len(some)), np.tile(some, len(ids)), "fair")
    assert (grid.ravel() == at).all()
    df = spark.createDataFrame([(k, r) for k, r in enumerate(ids)], "k long, r string").select("k", F.explode(F.array(*(F.lit(int(p)) for p in some))).alias("p"), "r")
    for r in df.select("k", "p", B.coin("s", F.col("r"), F.col("p"), "fair").alias("u")).collect():
        assert grid[r.k, list(some).index(r.p)] == r.u * 4294967296


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bf_encode_uldp", "harden_uldp", "harden_indexd"])
def test_noise_is_drawn_for_batches_on_all_cores(spark, name):
    """A digest for each bit in an interpreted lambda, in the one task that reads a small file, took too long."""
    plan = planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPython" in plan and "response" not in plan and "replace" not in plan
    assert "hashpartitioning(c_custkey" in plan


@pytest.mark.parametrize("blocks", [1, 3])
def test_distances_of_all_pairs(spark, blocks):
    """Against all pairs one by one: tiles, equal records, an estimate of the Hamming distance alone and one of more."""
    rng, m = np.random.default_rng(5), 70
    value = rng.integers(0, 6, 1100).astype(float)
    bits = rng.random((1100, m)) < 0.02 + value[:, None] / 10
    bits[:200] = bits[200:400] & (value[:200] == value[200:400])[:, None]
    bits[:200][value[:200] != value[200:400]] = False
    df = spark.createDataFrame([(float(v), [int(p) for p in np.flatnonzero(b)], float(b.sum())) for v, b in zip(value, bits, strict=True)], "value double, bits array<int>, x double")
    h = (bits[:, None, :] != bits[None, :, :]).sum(axis=2).astype(float)
    ones, pairs = bits.sum(axis=1).astype(float), np.triu(np.ones((1100, 1100), dtype=bool), 1)
    true = np.abs(value[:, None] - value[None, :])
    for x, estimate in ((None, lambda h, a, b: h * 3 - 1), ("x", lambda h, a, b: h / 7 - np.maximum(a, b))):
        est = estimate(h, ones[:, None], ones[None, :])
        got = numeric.distances(df, "value", "bits", m, estimate, (2.0, 20.0), x, blocks)
        got = got.groupBy("true_dis").agg(F.sum("n"), F.min("least"), F.max("most"), F.sum(F.get("within", 0)), F.sum(F.get("within", 1)))
        want = {}
        for d in np.unique(true[pairs]):
            e = est[pairs & (true == d)]
            want[d] = (len(e), e.min(), e.max(), (e <= 2).sum(), (e <= 20).sum())
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


@pytest.mark.parametrize("m,noise", [(300, 0.1), (600, 0.5), (4300, 0.5), (9000, 0.5)])
def test_distances_by_flips_are_those_of_the_pairs(spark, m, noise):
    """Three counts in a float, two, one; bounds that need no product; an empty block; columns that do not fill a float."""
    rng = np.random.default_rng(7)
    value = np.repeat([1.0, 2.0, 9.0], [50, 61, 37])
    bits = (np.arange(m) < value[:, None] * m / 10) ^ (rng.random((len(value), m)) < noise)
    ones, pairs = bits.sum(axis=1).astype(float), np.triu(np.ones((len(value),) * 2, dtype=bool), 1)
    h, true = (ones[:, None] + ones - 2 * (bits.astype(np.float32) @ bits.T.astype(np.float32))).astype(float), np.abs(value[:, None] - value)
    df = spark.createDataFrame([(float(v), [int(p) for p in np.flatnonzero(b)], float(b.sum())) for v, b in zip(value, bits, strict=True)], "value double, bits array<int>, x double")
    limits = (m * 0.18, m * 0.5, m * 0.66)
    for x, estimate in ((None, lambda h, a, b: h / 1.1), ("x", lambda h, a, b: h / 1.1 - np.maximum(a, b) / 7)):
        est = estimate(h, ones[:, None], ones[None, :])
        for ends in (True, False):
            got = numeric.distances(df, "value", "bits", m, estimate, limits, x, 2, 2, ends, True)
            got = got.groupBy("true_dis").agg(F.sum("n"), F.min("least"), F.max("most"), *(F.sum(F.get("within", k)) for k in range(3)))
            want = {}
            for d in np.unique(true[pairs]):
                e = est[pairs & (true == d)]
                want[d] = (len(e), *((e.min(), e.max()) if ends else (None, None)), *((e <= t).sum() for t in limits))
            assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_records_of_two_values_meet_by_their_flips(spark):
    """Products of whole vectors, one pair in a float, took too long."""
    rng = np.random.default_rng(3)
    side = lambda v: numeric._Side(pa.table({"_value": np.full(40, v), "_n": np.ones(40), "_vector": [rng.bytes(16) for _ in range(40)]}), 128)
    a, b = side(1.0), side(2.0)
    met = a.flips(a.parts[0]).flipped_in(numeric._Right(b, b.parts[0]), None, 3)
    assert met.dtype == np.uint8 and met.shape == (40, 4 * 14)


@pytest.mark.parametrize("name", ["est_distance_dprl", "est_distance_v1", "est_distance_v2", "est_distance_v3", "est_distance_ue", "prf_distance", "prf_distance_v3", "distance_grid", "store_prf"])
def test_noisy_distances_come_from_tiles(spark, name):
    """One joined row for each pair of vectors took too long."""
    plan = planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def filters(spark, seed, count, n):
    rng = np.random.default_rng(seed)
    base = rng.random((12, n)) < 0.3
    rows = [(str(k), [int(p) for p in np.flatnonzero(base[k % 12] & (rng.random(n) < 0.8))] if k else [], f"k{k % 5 if k % 7 else 0}") for k in range(count)]
    return spark.createDataFrame(rows, "entity_id string, bits array<int>, key string")


def test_links_by_tiles_are_those_of_the_blocks(spark):
    a, b = filters(spark, 1, 90, 100), filters(spark, 2, 70, 100)
    keys = lambda t: blocking.blocks(t, blocking.hlsh_segment_keys(F.col("bits"), 100, 20))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(linkage.link_bits(a, b, keys(a), keys(b), "bits", 100, 0.5))
    assert want and rows(linkage.link_far(a, b, keys(a), keys(b), "bits", 100, 0.5)) == want


@pytest.mark.parametrize("n,share", [(100, 0.3), (1000, 0.1), (9000, 0.5)])
def test_links_by_codes_are_those_of_the_blocks(spark, n, share):
    """Folded counts of three filters in a float, of two and of one; the keys of the filters without a join of keys."""
    rng = np.random.default_rng(4)
    base = rng.random((12, n)) < share
    rows = lambda c: spark.createDataFrame([(str(k), [int(p) for p in np.flatnonzero(base[k % 12] & (rng.random(n) < 0.8))] if k else []) for k in range(c)], "entity_id string, bits array<int>")
    a, b, samples = rows(90), rows(70), blocking.sampled_positions(6, 8, n)
    for keys, codes in ((blocking.hlsh_random_keys(F.col("bits"), samples), blocking.hlsh_random_codes(samples)), (blocking.hlsh_segment_keys(F.col("bits"), n, n // 20 - 1), blocking.hlsh_segment_codes(n, n // 20 - 1))):
        want = sorted(map(tuple, linkage.link_bits(a, b, blocking.blocks(a, keys), blocking.blocks(b, keys), "bits", n, 0.5).collect()))
        assert want and sorted(map(tuple, linkage.link_all(a, b, "bits", n, 0.5, 3, codes).collect())) == want


@pytest.mark.parametrize("name", ["link_bf_hlsh", "link_bf_hlsh_segment"])
def test_links_carry_no_keys(spark, name):
    """The keys of both records, as strings, went through two joins with every pair that reaches the threshold."""
    plan = planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("most", [7, 4096])
def test_tallies_of_blocks_are_those_of_the_pairs(spark, most):
    a, b = filters(spark, 1, 90, 100), filters(spark, 2, 70, 100)
    keys = lambda t: blocking.blocks(t, F.array("key"))
    want = sorted(map(tuple, metrics.threshold_sweep(linkage.link_bits(a, b, keys(a), keys(b), "bits", 100, 0.5), a, b).collect()))
    at = linkage.tallies(a, b, "key", {"x": ("bits", 100)}, 0.5, metrics.THRESHOLDS, most)
    assert sorted(map(tuple, metrics.counted_sweep(at, a, b, by=("config",)).drop("config").collect())) == want


@pytest.mark.parametrize("name", ["link_bf_hlsh", "link_bf_hlsh_segment", "private_sweep", "private_grid"])
def test_filters_meet_in_tiles(spark, name):
    """Blocks that hold a large part of all records gave a row for each pair before the filters were compared."""
    plan = planned(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroupsInArrow" in plan
