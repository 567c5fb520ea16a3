"""Every operator on rows with nulls, ties, repetitions, very long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lumenlink.llm import decontaminate, dsir, mixing, near, passages, pii, rules, store, suffix

KIND = "doc_id long, text string, source string, id long, row string, key string, n long, node string, size string, label int, quality int, toxic int"
LONG = "word" * 50_000 + " " + " ".join(f"w{k}" for k in range(20_000))
TEXTS = [None, "", " \n\t", "one", LONG, LONG, "a b c d e f g " * 20, "ÄÖ ü 'é' 中文 \U0001f600 " * 30, "\x00\x01 \x7f", "#" * 999]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, s, None, "r", "k", None, "n", "s", 1, 0, None) for d, t in [*enumerate(TEXTS), (None, "null id"), (4, LONG), (4, LONG), (None, None)] for s in ("a",)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, None, 1), (4, 1, None), (4, 0, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, text int")


def test_row_for_row(spark, docs, labels):
    n = docs.count()
    assert pii.pseudonymise(docs).count() == n
    assert rules.decision_list(docs, labels).count() == n
    assert dsir.importance_resampling(docs, labels).count() == n
    assert near.near_duplicates(docs).count() == n
    assert mixing.mix_sources(docs).count() == n
    cut = suffix.cut_repeats(docs).collect()
    assert len(cut) == n and {r.n_removed == r.n_bytes for r in cut if r.doc_id == 4} == {True}
    assert pii.pseudonymise(docs, count_col=None).columns == docs.columns


def test_searches(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "a b"), (4, "w5 w6 w7 w8 w9 w10"), (None, "w50 w51 w52 w53 w54")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(6, 1), (4, 4), (5, 4), (4, -1), (5, -1)}
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {4, 5, 6} == set()
    pairs = {frozenset((r.doc_id, r.partner_id)) for r in passages.near_passages(docs).collect()}
    assert pairs == {frozenset((4, 5))}


def test_filters_return_the_rows(spark, docs, labels):
    for out in (dsir.resampled(docs, labels), near.one_of_each(docs)):
        assert out.columns == docs.columns and out.schema == docs.schema
        assert out.exceptAll(docs).count() == 0


def test_hash_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).select(F.col("id"), F.lit("x").alias("v"))
    got = [r.id for r in store.hash_sample(df, "id", 100).collect()]
    assert len(got) == 100 == len(set(got)) and got == [r.id for r in store.hash_sample(df.repartition(3), "id", 100).collect()]
    assert store.hash_sample(df.limit(7), "id", 100).count() == 7
