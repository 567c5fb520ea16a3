import numpy as np

from lumenlink.llm import decontaminate as D


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items, similarity=0.8, min_words=5):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, t in items:
            v = (t or "").lower().split()
            most = D.allowed(len(v), similarity)
            if len(v) >= min_words and any(lev(v, w[s : s + len(v)]) <= most for s in range(len(w))):
                out.add((d, i))
    return out


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k, what = int(rng.integers(len(out))), rng.integers(3)
        if what == 0:
            out[k] = f"new{rng.integers(999)}"
        elif what == 1:
            del out[k]
        else:
            out.insert(k, f"new{rng.integers(999)}")
    return out


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        assert D.edit_distance(a, b, 99) == lev(a.tolist(), b.tolist())
        assert min(D.edit_distance(a, b, 3), 4) == min(lev(a.tolist(), b.tolist()), 4)


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"v{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(6, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short")]
    docs = [(0, None), (1, ""), (2, "word"), (3, items[0][1].upper())]
    for d in range(4, 160):
        w = list(rng.choice(vocab, rng.integers(0, 120)))
        if d % 2:
            item = items[int(rng.integers(25))][1].split()
            k = int(rng.integers(len(w) + 1))
            w[k:k] = edited(rng, item, int(rng.integers(0, D.allowed(len(item), 0.8) + 1)))
        docs.append((d, " ".join(w)))
    want = brute(docs, items)
    frame = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, item_id long, edits string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want) > 60


def search(items, words):
    """The edits of each item that is found in one document of words."""
    h = lambda w: np.array([hash(x) & (2**63 - 1) for x in w], dtype=np.uint64)
    index = D.Items(list(range(len(items))), [h(w) for w in items], 0.8, 11)
    text = h(words)
    return {i: e for _, i, _, e in index.find(text, np.zeros(len(text), dtype=np.int64), np.array([0, len(text)]))}


def test_recall_at_the_full_edit_bound():
    """Copies with as many edits as are allowed, of all kinds, by length of the item."""
    rng = np.random.default_rng(8)
    for n in (15, 20, 30, 40, 59):
        hits = total = 0
        for _ in range(60):
            item = [f"a{rng.integers(10**6)}" for _ in range(n)]
            copy = edited(rng, item, D.allowed(n, 0.8))
            words = [f"b{k}" for k in range(30)] + copy + [f"c{k}" for k in range(30)]
            if any(lev(item, words[s : s + n]) <= D.allowed(n, 0.8) for s in range(len(words))):
                total += 1
                hits += search([item], words) != {}
        assert hits >= 0.95 * total and total > 20, (n, hits, total)


def test_memory_is_bounded_by_words_not_by_the_longest_item():
    import tracemalloc

    rng = np.random.default_rng(9)
    long = [f"w{rng.integers(10**6)}" for _ in range(20_000)]
    short = [[f"w{rng.integers(10**6)}" for _ in range(12)] for _ in range(3000)]
    tracemalloc.start()
    found = search([*short, long], ["x"] * 50 + short[7] + long + ["y"] * 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {7: 0, 3000: 0} and peak < 150e6, peak


def test_a_run_that_all_items_share():
    rng = np.random.default_rng(10)
    run = "all items begin with these".split()
    items = [run + [f"w{rng.integers(10**6)}" for _ in range(15)] for _ in range(2000)]
    words = (run + ["other"] * 15) * 40 + items[5] + edited(rng, items[9], 2)
    found = search(items, words)
    assert found[5] == 0 and 9 in found and len(found) == 2


def test_blocks_are_bounded_by_items_and_words(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(8 + 60 * (k == 3)))) for k in range(9)], "item_id long, text string")
    blocks = list(D.item_blocks(items, "item_id", "text", 0.8, 5, 11))
    assert sorted(i for b in blocks for i in b.ids) == list(range(9)) and all(b.length.sum() <= 40 or len(b.ids) == 1 for b in blocks)
    docs = spark.createDataFrame([(k, f"x i{k}w0 i{k}w1 i{k}w2 i{k}w3 i{k}w4 i{k}w5 i{k}w6 i{k}w7 y") for k in range(9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(k, k) for k in range(9) if k != 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(none, items).collect() == []
    assert D.contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items).collect() == []
