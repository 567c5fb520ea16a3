import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenlink.llm import dsir, mixing, store


def fill(sizes, weights, most):
    """Targets by repeated sharing: the plain form of the rule."""
    target, open_, left = {}, dict(enumerate(sizes)), sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k, s in open_.items() if weights[k] * left > most * s * total]
        if not full:
            for k in open_:
                target[k] = weights[k] * left / total
            break
        for k in full:
            target[k] = most * open_.pop(k)
            left -= target[k]
    return [float(target.get(k, 0)) for k in range(len(sizes))]


def test_water_filling_matches_the_plain_rule(spark):
    r = random.Random(1)
    for case in range(6):
        sizes = [r.choice([0, 1, 3, 10, 100, 5000]) for _ in range(r.randrange(1, 12))]
        names = [f"s{k:02d}" for k in range(len(sizes))]
        if case % 2:
            names[-1] = None
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {x.source: x.target for x in mixing.water_fill(frame, (5, 2, 1), 3).collect()}
        want = fill(sizes, [[5, 2, 1][k % 3] for k in range(len(sizes))], 3)
        assert np.allclose([got[n] for n in names], want), (sizes, got, want)


def test_sources_reach_their_targets(spark):
    r = random.Random(2)
    rows = [(k, None if k % 40 == 0 else " ".join(["w"] * r.randrange(0, 50)), r.choice([None, "a", "b", "c", "d", "Ä"]) if k % 3 else "a", "clash") for k in range(900)] + [(5, "x y", "a", "c")] * 3 + [(None, "x y z", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix_sources(docs)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "source"]
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        by.setdefault(x.source, [0, 0, x.source_size, x.target])
        by[x.source][0] += x.taken
        by[x.source][1] += x.size
    for taken, size, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 0.5 and target <= 3 * size
    assert abs(sum(v[3] for v in by.values()) - sum(v[1] for v in by.values())) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_kth_largest(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(-(2**62), 2**62, 300), rng.integers(-5, 5, 200), [-(2**63), 2**63 - 1]])
    frame = spark.createDataFrame([(int(v),) for v in values], "key long")
    for k in (1, 2, 7, 250, 502):
        assert dsir.kth_largest(frame, "key", k) == sorted(values.tolist(), reverse=True)[k - 1]
    assert dsir.kth_largest(frame, "key", 0) is None and dsir.kth_largest(frame, "key", 503) is None


def test_sample_prefers_target_text_and_is_stable(spark):
    r = random.Random(6)
    good = lambda: " ".join(f"g{int(r.expovariate(0.02))}" for _ in range(r.randrange(60, 200)))
    junk = lambda: " ".join(f"j{int(r.expovariate(0.02))}###" for _ in range(r.randrange(60, 200)))
    rows = [(k, junk() if k % 5 == 0 else good(), 1.0) for k in range(1500)] + [(2000, None, 0.0), (2001, "", 0.0), (2002, " \n", 0.0)] + [(7, "repeated text of g1 g2 g3", 0.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), "x") for k in range(0, 1500, 2)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    out = dsir.importance_resampling(docs, labels)
    got = {(x.doc_id, x.n_grams): x.kept for x in out.collect()}
    unseen = [k for k in range(1, 1500, 2)]
    kept = {d for (d, _), v in got.items() if v}
    assert np.mean([k in kept for k in unseen if k % 5]) > 0.97
    assert np.mean([k in kept for k in unseen if k % 5 == 0]) < 0.03
    assert not kept & {2000, 2001, 2002}
    again = {(x.doc_id, x.n_grams): x.kept for x in dsir.importance_resampling(docs.repartition(5), labels).collect()}
    assert got == again
    rows = sorted((x.doc_id, x.text) for x in dsir.resampled(docs, labels).collect())
    assert {d for d, _ in rows} == kept and len(rows) == sum(v for v in out.select(F.col("kept").cast("int")).toPandas()["kept"])


def test_toxic_documents_are_no_target(spark):
    r = random.Random(8)
    word = lambda: f"g{int(r.expovariate(0.02))}"
    text = lambda toxic: " ".join(f"t{r.randrange(30)}" if toxic and r.random() < 0.5 else word() for _ in range(r.randrange(60, 200)))
    toxic = {k for k in range(1500) if k % 8 in (0, 1)}
    docs = spark.createDataFrame([(k, text(k in toxic)) for k in range(1500)], "doc_id long, text string")
    # Of the rest every other one has a null in toxic; each toxic document has a second row that says nothing of it.
    rows = [(k, 1, 1 if k in toxic else (0 if k % 4 else None)) for k in range(0, 1500, 2)] + [(k, 1, None) for k in sorted(toxic) if k % 2 == 0]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in dsir.importance_resampling(docs, labels).collect() if x.kept}
    assert {x.doc_id for x in dsir.resampled(docs, labels).collect()} == kept
    unseen = range(1, 1500, 2)
    assert np.mean([k in kept for k in unseen if k not in toxic]) > 0.97
    assert np.mean([k in kept for k in unseen if k in toxic]) < 0.05


def test_weights_match_a_plain_recomputation(spark):
    """Counts, models and weights from strings, by dictionaries; only the bucket of an n-gram is the operator's."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["Aa", "bb", "cc,", "dd", "ee", "ünï"][: 2 + k % 5]) for _ in range(r.randrange(0, 40))) for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 120, 3)], "doc_id long, quality int")
    got = {x.doc_id: x for x in dsir.importance_resampling(docs, labels).collect()}

    def bucket(gram):
        data = gram.encode()
        return int(dsir._buckets(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[0][-1])

    def grams(text):
        words = text.split(" ") if text else []
        return [bucket(w) for w in words] + [bucket(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)]

    sample = [x.id for x in store.hash_sample(labels.select(F.col("doc_id").alias("id")), "id", dsir.MAX_TARGET).collect()]
    raw, hit = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(grams(t))
        if k in sample[::2]:
            hit.update(grams(t))
    n_raw, n_hit = sum(raw.values()), sum(hit.values())
    rate = {b: raw[b] / n_raw * (hit[b] + dsir.PRIOR) / (n_hit * raw[b] / n_raw + dsir.PRIOR) for b in raw}
    total = sum(rate.values())
    weights = {k: sum(np.log(rate[b] / total) - np.log(raw[b] / n_raw) for b in grams(t)) for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        assert got[k].n_grams == len(grams(t)) and abs(got[k].log_weight - weights[k]) < 1e-6
    floor = np.quantile([weights[k] for k in sample[1::2] if texts[k]], 1 - dsir.RETAINED)
    size = sum(w >= floor - 1e-9 for k, w in weights.items() if texts[k])
    best = sorted((x.gumbel_key for x in got.values() if x.n_grams), reverse=True)[:size]
    assert {d for d, x in got.items() if x.kept} == {d for d, x in got.items() if x.n_grams and x.gumbel_key >= best[-1] - 2e-6}


def test_gumbel_draws_follow_the_weights(spark):
    """Chance of a place in the sample grows with the weight, and equal weights differ by the draw alone."""
    keys = dsir._scores
    import pyarrow as pa

    ids, texts = pa.array(range(4000), pa.int64()), pa.array(["a b c"] * 4000)
    ratio = np.zeros(dsir.BUCKETS)
    _, weight, key = keys(ids, texts, ratio, 1)
    noise = key - weight
    assert abs(noise.mean() - 0.5772) < 0.06 and abs(noise.std() - 1.2825) < 0.06


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, quality int")
    assert dsir.importance_resampling(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in dsir.importance_resampling(some, labels).collect()} == {1: True, 2: False}
