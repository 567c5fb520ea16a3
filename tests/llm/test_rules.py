import re
from collections import Counter

import numpy as np

from lumenlink.llm import rules

SAMPLES = [
    None,
    "",
    " \t\n",
    "one",
    "a b a b a b",
    "x y z\nx y z\n\nx y z \n",
    "ünï ß a   b\x0bc\x0cd\re",
    "# * $ % & | < > #*$\nline\nline",
    "w " * 3000 + "\n" + "long " * 2000,
    "A! B? " * 30 + "tail of the text 12 345",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, marked = Counter(three), set()
    for i, g in enumerate(three):
        if times[g] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_counts_match_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(SAMPLES)] + [(None, "a b c", "x", 2), (3, "one", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, label int")
    got = [tuple(r) for r in rules.text_statistics(docs).select("id", *rules.COUNTS[:5]).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)


def test_counts_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in rules.text_statistics(docs).select("id", *rules.COUNTS[:5]).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text)


def test_learned_list_finds_a_planted_conjunction():
    rng = np.random.default_rng(0)
    x = {f: rng.random(4000) for f in rules.FEATURES}
    bad = (x["symbols_a_word"] > 0.7) & (x["words"] < 0.4) | (x["word_length"] > 0.9)
    learned = rules.learn_list(x, bad)
    got = np.zeros(len(bad), dtype=bool)
    for r in learned:
        got |= r.covers(x)
    assert (got & bad).sum() > 0.9 * bad.sum() and (got & ~bad).sum() < 0.02 * (~bad).sum()
    assert rules.learn_list(x, np.zeros(4000, dtype=bool)) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    out = rules.decision_list(docs, train).join(test, "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    assert out
    got = {(r.quality, r.kept): r["count"] for r in rules.decision_list(docs, train).join(test, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    good, bad = got.get((1, True), 0) / (got.get((1, True), 0) + got.get((1, False), 0)), got.get((0, False), 0) / (got.get((0, True), 0) + got.get((0, False), 0))
    print(good, bad)
    assert good > 0.98 and bad > 0.85


def test_verdict_is_the_learned_list(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = rules.decision_list(docs, labels)
    assert out.columns == ["doc_id", *rules.COUNTS[:5], "base_failed", "kept", *rules.COUNTS[5:]]
    table = out.toPandas()
    learned = rules.fit_rules(rules.text_statistics(docs), labels)
    assert learned
    for r in table.to_dict("records"):
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        x = {f: eval(e, {}, r) if r["n_words"] else 0 for f, e in rules.FEATURES.items()}  # noqa: S307
        rejected = any(all(x[f] >= at if above else x[f] <= at for f, above, at in rule.conditions) for rule in learned)
        assert r["kept"] == (not failed and not rejected)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.decision_list(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "w%d " % 1 + " ".join(f"w{i}" for i in range(60))), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.base_failed, r.kept) for r in rules.decision_list(some, labels).collect()} == {1: (False, True), 2: (True, False)}
