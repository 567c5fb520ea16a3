import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumenlink.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_the_transform_is_that_of_all_suffixes():
    """All suffixes of all columns, sorted by comparison: places, common prefixes in bytes, and the symbols before."""
    rng = np.random.default_rng(0)
    for case in range(12):
        n, letters = int(rng.integers(1, 40)), list(b"ab\xc3")[: 1 + case % 3]
        word = lambda most: bytes(rng.choice(letters, int(rng.integers(0, most))).tolist())  # noqa: E731, B023
        left, right, group = [word(9) for _ in range(n)], [word(9) for _ in range(n)], np.sort(rng.integers(0, 4, n))
        size = 5 + group
        heads, tails = suffix.columns(left, True), suffix.columns(right, False)
        made = suffix.Collection(n, wide=case % 2 == 0)
        for c in range(tails.shape[1] - 1, -1, -1):
            rows = np.flatnonzero(tails[:, c])
            made.round(rows, tails[rows, c])
        made.cores(np.arange(n), group, size)
        for c in range(1, heads.shape[1] + 1):
            rows = np.flatnonzero(heads[:, -c])
            got, shared = made.round(rows, heads[rows, -c])
            assert sorted(got.tolist()) == rows.tolist()
        letters_of = [[(b + 1, 1) for b in x] + [(made.core + int(g), int(z))] + [(b + 1, 1) for b in y] for x, g, z, y in zip(left, group, size, right, strict=True)]
        suffixes = sorted((x[k:], min(x[k - 1][0], made.core) if k else 0) for x in letters_of for k in range(len(x) + 1))
        assert len(made.bwt) == len(suffixes)
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            same = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
            assert made.prefix[k] == sum(z for _, z in a[:same])
        at = 0
        while at < len(suffixes):  # equal suffixes are in any order
            end = at
            while end < len(suffixes) and suffixes[end][0] == suffixes[at][0]:
                end += 1
            assert sorted(made.bwt[at:end].tolist()) == sorted(c for _, c in suffixes[at:end])
            at = end


def test_parts_hold_every_window_once():
    r = random.Random(3)
    for _ in range(50):
        length = r.randrange(32, 60)
        width = length - length // 2
        text = bytes(r.randrange(97, 100) for _ in range(3 * length))
        place = length
        hi = r.randrange(width)
        lo = r.randrange(hi, width)
        core = length - width + 1
        left, right = text[place - lo : place], text[place + core : place - hi + length]
        seen = []
        for a, w, least, joined, head, tail in suffix.parts_of(width, hi, left, right):
            whole = head + joined[:a] + text[place : place + core] + joined[a:] + tail
            for offset in range(least, len(head) + 1):
                seen.append(a + offset)
                assert whole[len(head) - offset :][:length] == text[place - a - offset :][:length]
            assert len(tail) == w - 1 - least
        assert sorted(seen) == list(range(hi, lo + 1))


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [word(r.randrange(length, 4 * length)) for _ in range(6)]
    texts = [None, "", "x", "a" * (3 * length), "ab" * length, word(length), word(length - 1)]
    for _ in range(60):
        parts = [word(r.randrange(0, 2 * length)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts.insert(r.randrange(4), s[a : a + r.randrange(length // 2, 3 * length)])
        texts.append("".join(parts))
    return texts + texts[-3:] + [texts[-1] + "!"] * 2


@pytest.mark.parametrize("seed,length,most", [(1, 32, 4096), (2, 50, 4096), (3, 41, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, length, most):
    """The last case splits every bucket of more than two strings."""
    monkeypatch.setattr(suffix, "BUCKET", most)
    monkeypatch.setattr(suffix, "COLLECTION", 64)
    texts = corpus(seed, length)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, key string, row int")
    got = {r[0]: tuple(r)[1:5] for r in suffix.cut_repeats(docs, length).collect()}
    want = brute(texts, length)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 20


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r[0]: tuple(r)[1:5] for r in suffix.cut_repeats(docs).collect() if r.kept == (r.n_removed == 0)}
    assert [got[d] for d, _ in rows] == brute([t for _, t in rows], 400)


def test_ids_and_empty_table(spark):
    assert suffix.cut_repeats(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    t = "".join(map(str, range(300)))
    out = suffix.cut_repeats(spark.createDataFrame([(None, t), (7, t), (7, "other")], "doc_id int, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out) == [("7", 5, 0), ("7", len(t), len(t)), ("None", len(t), len(t))]
