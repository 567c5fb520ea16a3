import random
from collections import defaultdict

import numpy as np
import pytest

from lumenlink.llm import graph, near

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute(rows, n):
    """(id, size, component) by comparing all pairs."""
    s = sets([t for _, t in rows], n)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                if a != b:
                    up[a] = b
    least = defaultdict(list)
    for k in range(len(rows)):
        least[find(k)].append(rows[k][0])
    return sorted((rows[k][0], len(s[k]), min(least[find(k)])) for k in range(len(rows)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts = [None, "", " \t ", "one", "One", "two words", "two  words\n", "a b c d", "A b C d e"]
    bases = [[word() for _ in range(r.randrange(30, 200))] for _ in range(12)]
    for b in bases:
        for _ in range(r.randrange(1, 7)):
            w = list(b)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts += [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(30)] + [texts[12]] * 3
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n long, node string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs, shingle=4).collect())
    assert got == brute(rows, 4)


def test_long_lists_lose_no_link(spark, monkeypatch):
    """A group of drifting copies, far longer than a block: chains of links, and many candidates that are no links."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows, pool = [], [base]
    for d in range(260):
        w = list(r.choice(pool))
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        pool.append(w)
        rows.append((d, " ".join(w)))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect())
    want = brute(rows, 4)
    assert got == want
    assert 1 < len({c for *_, c in want}) < 260


def test_empty_null_ids_and_repeated_rows(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "other words here now ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in near.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("None", 4, False), ("4", 4, True), ("4", 4, True), ("None", None, True), ("9", 9, True)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in near.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(None, None), (None, "a b c d e f"), (4, "a b c d e f"), (9, "other words here now ok")], key=str)


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    want = {x: find(x) for x in up}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.comp for r in graph.components(frame).collect()} == want
    monkeypatch.setattr(graph, "TASK_EDGES", 50)
    assert {r.node: r.comp for r in graph.components(frame).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
