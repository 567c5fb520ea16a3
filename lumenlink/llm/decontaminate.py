"""Benchmark decontamination by CGK embeddings and bit-sampling LSH over item-sized windows.

Texts and items are sequences of words.  Every window of a document that could hold a copy of an
item, as many words long as the item, is embedded by the CGK random walk, which maps edit
distance to Hamming distance: the walk repeats or passes a word by a shared random bit of
(step, word), so that two walks that part at an edit soon run together again.  Repeated samples
of positions of the embedding are the LSH keys; windows and items that share a key are
candidates, and each candidate is verified by its exact word edit distance.

*Which windows.*  A window within ``e`` edits of an item of ``n`` words keeps one of ``e + 1`` equal
pieces of the item untouched.  Only starts that the first words of such a piece propose, moved by up to e
words either way, are embedded; this loses nothing that the threshold admits.  A piece proposes each
start and length once, however many items hold it there.

*Recall.*  ``REPEATS`` samples of ``SAMPLED`` positions are taken.  A window that differs from the
item by d edits has an embedding that differs in few positions; with d = 0 all keys agree.  The
tests measure recall against brute force.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlink.llm import kernels as K
from lumenlink.llm.store import limit_batches

#: Benchmark items, and words of them, that one pass over the documents handles at most; more go in further passes.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1 << 21
#: Longest run of words by which windows are proposed.
RUN = 4
WALK, REPEATS, SAMPLED = 3, 48, 5
#: Windows, and words of them, embedded at once; proposals held at once.
ROWS, WORDS, PROPOSED = 2048, 1 << 16, 1 << 18
U = np.uint64


def allowed(n: int, similarity: float) -> int:
    """Edits that an item of n words may show."""
    return int(n * (1 - similarity) + 1e-9)


def run_length(n: int, similarity: float) -> int:
    e = allowed(n, similarity)
    return max(1, min(RUN, -(-(n - e) // (e + 1))))


def cgk(h: np.ndarray, n: np.ndarray, seed: int, walks: int) -> np.ndarray:
    """The embeddings (rows, walks, WALK * width) of the first n words of rows of word hashes; past its end a walk emits 0.

    64 of the shared bits of (walk, word) come from one hash, a bit for each step.
    """
    rows, width = h.shape
    steps = WALK * width
    padded = np.zeros((rows, width + 1), dtype=np.uint64)
    padded[:, :width] = np.where(np.arange(width) < n[:, None], h, U(0))
    out = np.zeros((rows * walks, steps), dtype=np.uint64)
    line, walk = np.repeat(np.arange(rows), walks), np.tile(np.arange(walks, dtype=np.uint64), rows)
    last, at = n[line], np.zeros(rows * walks, dtype=np.int64)
    salt = K.mix(np.arange(walks * -(-steps // 64), dtype=np.uint64) + U(seed + 1)).reshape(walks, -1)[walk.astype(np.int64)]
    for step in range(steps):
        word = padded[line, at]
        out[:, step] = word
        bit = (K.mix(word ^ salt[:, step >> 6]) >> U(step & 63)) & U(1)
        at = np.minimum(at + bit.astype(np.int64), last)
    return out.reshape(rows, walks, steps)


#: Repeats that share a walk.
SHARED = 4


def lsh_keys(h: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """REPEATS keys for each row: hashes of its length and of SAMPLED positions of its embedding."""
    rows = len(h)
    e = cgk(h, n, seed, REPEATS // SHARED)
    lengths, of = np.unique(n, return_inverse=True)
    where = np.stack([np.random.default_rng([seed, int(m)]).integers(0, WALK * int(m), (REPEATS, SAMPLED)) for m in lengths])[of] if rows else np.zeros((0, REPEATS, SAMPLED), dtype=np.int64)
    keys = K.mix(n.astype(np.uint64)[:, None] * U(1 << 32) + np.arange(1, REPEATS + 1, dtype=np.uint64))
    line, walk = np.arange(rows)[:, None], (np.arange(REPEATS) // SHARED)[None, :]
    for k in range(SAMPLED):
        keys = K.mix(keys * U(0xD1342543DE82EF95) + e[line, walk, where[:, :, k]])
    return keys


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two sequences, or most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        sub = row[:-1] + (b != x)
        new = np.concatenate([[i], np.minimum(sub, row[1:] + 1)])
        ramp = np.arange(len(b) + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > most:
            return most + 1
    return int(row[-1])


def _chunks(n: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of rows of n words, shortest first, in chunks of at most ROWS rows and WORDS words when filled up to the longest, or one row."""
    order = np.argsort(n, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + ROWS)
        while b > a + 1 and int(n[order[b - 1]]) * (b - a) > WORDS:
            b = a + max(1, min(b - a - 1, WORDS // int(n[order[b - 1]])))
        yield order[a:b]
        a = b


class Items:
    """A block of benchmark items, indexed by the first words of their pieces and by the LSH keys of each."""

    def __init__(self, ids: list[int], words: list[np.ndarray], similarity: float, seed: int):
        self.ids, self.words, self.similarity, self.seed = ids, words, similarity, seed
        self.length = np.array([len(w) for w in words])
        self.most = np.array([allowed(len(w), similarity) for w in words])
        runs: dict[int, list[np.ndarray]] = defaultdict(list)
        for w, n, e in zip(words, self.length.tolist(), self.most.tolist(), strict=True):
            q = run_length(n, similarity)
            at = np.arange(e + 1) * n // (e + 1)
            runs[q].append(np.stack([K.grams(w, q)[at], np.full(e + 1, n, dtype=np.uint64), at.astype(np.uint64)]))
        #: For each length of runs: its hashes in order, and the length of the item and the place in it of each.
        self.runs = {}
        for q, parts in runs.items():
            g, n, at = np.unique(np.concatenate(parts, axis=1), axis=1)
            self.runs[q] = (g, n.astype(np.int64), at.astype(np.int64))
        keys, owner = [], []
        for part in _chunks(self.length):
            rows = np.zeros((len(part), int(self.length[part].max())), dtype=np.uint64)
            for k, i in enumerate(part):
                rows[k, : len(words[i])] = words[i]
            keys.append(lsh_keys(rows, self.length[part], seed).ravel())
            owner.append(np.repeat(part, REPEATS))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def proposals(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, words, document) of windows in which a piece of an item of as many words begins as in the item; about PROPOSED at a time."""
        for q, (g, n, at) in self.runs.items():
            if len(h) < q:
                continue
            mine = K.grams(h, q)
            hit = np.flatnonzero(_member(mine, g) & (doc[: len(mine)] == doc[q - 1 :]))
            lo, hi = np.searchsorted(g, mine[hit]), np.searchsorted(g, mine[hit], side="right")
            total = np.cumsum(hi - lo)
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PROPOSED, side="right")))
                each = (hi - lo)[a:b]
                rows = K._ranges(lo[a:b], each)
                run = np.repeat(hit[a:b], each)
                yield run - at[rows], n[rows], doc[run]
                a = b

    def find(self, h: np.ndarray, doc: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, edits): the best window for each document and item."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for start, n, home in self.proposals(h, doc):
            start, n, home = np.unique(np.stack([start, n, home]), axis=1)
            # A window that is an item without an edit is not moved.
            exact = self._check(start, n, home, h, offs, found)
            left = np.array([x not in exact for x in zip(home.tolist(), start.tolist(), n.tolist(), strict=True)], dtype=bool)
            start, n, home = start[left], n[left], home[left]
            around = (n * (1 - self.similarity) + 1e-9).astype(np.int64)
            ends = np.cumsum(2 * around + 1)
            a = 0
            while a < len(start):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PROPOSED, side="right")))
                row = np.repeat(np.arange(a, b), 2 * around[a:b] + 1)
                self._check(start[row] + K._ranges(-around[a:b], 2 * around[a:b] + 1), n[row], home[row], h, offs, found)
                a = b
        for (d, i), (edits, s) in found.items():
            yield d, i, s, edits

    def _check(self, start, n, home, h, offs, found) -> set[tuple[int, int, int]]:
        """Note the best windows of each document and item in ``found`` -> (document, start, words) of those without an edit."""
        exact = set()
        # At the edges of a document the window is what lies inside it.
        start = np.maximum(start, offs[home])
        end = np.minimum(start + n, offs[home + 1])
        start, end, home, n = np.unique(np.stack([start, end, home, n])[:, end > start], axis=1)
        for part in _chunks(n):
            s, e, m = start[part], end[part], n[part]
            place = s[:, None] + np.arange(int(m.max()))
            rows = np.where(place < e[:, None], h[np.minimum(place, len(h) - 1)], U(0))
            keys = lsh_keys(rows, m, self.seed).ravel()
            lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
            window = np.repeat(np.repeat(np.arange(len(s)), REPEATS), hi - lo)
            whose = self.owner[K._ranges(lo, hi - lo)]
            for code in np.unique(window * len(self.ids) + whose).tolist():
                k, i = divmod(code, len(self.ids))
                most, d = int(self.most[i]), int(home[part[k]])
                edits = edit_distance(self.words[i], h[s[k] : e[k]], most)
                if edits <= most and (edits, s[k]) < found.get((d, i), (most + 1, 0)):
                    found[d, i] = (edits, int(s[k]))
                if not edits:
                    exact.add((d, int(s[k]), int(m[k])))
        return exact


def _member(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Is x among the values?  A table of the top 16 bits settles most at once."""
    top = np.zeros(1 << 20, dtype=bool)
    top[(sorted_values >> U(44)).astype(np.int64)] = True
    out = top[(x >> U(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    where = np.minimum(np.searchsorted(sorted_values, x[at]), len(sorted_values) - 1)
    out[at] = sorted_values[where] == x[at]
    return out


def _scan(items: Items) -> Callable:
    def run(batches):
        for batch in batches:
            for i, j, buf, offs in K.blocks(batch.column(1)):
                w = K.Words(buf, offs, lower=True)
                got = list(items.find(w.hashes(), w.doc, w.offs))
                if got:
                    d, k, s, e = (np.array(c, dtype=np.int64) for c in zip(*got, strict=True))
                    ids = batch.column(0).slice(i, j - i).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(items.ids)[k]), pa.array(s - w.offs[d]), pa.array(items.length[k]), pa.array(e)], names=["id", "item_id", "start_word", "n_words", "edits"])

    return run


def _nothing(batches):
    for _ in batches:
        pass
    return iter(())


SCHEMA = "id long, item_id long, start_word long, n_words long, edits long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, min_words: int = 5, seed: int = 11) -> DataFrame:
    """One row per document and item found in it: id, item_id, start_word, n_words, edits.

    A window of as many words as the item (fewer at a document's end) with at most
    floor((1 - similarity) * n) word edits, A-Z in lower case, is a copy of the item; the best
    one, then the first, is given.  Items with fewer than ``min_words`` words, null or empty
    ones, cannot be told from chance and are passed over; null and empty texts hold nothing.
    Items with equal ids are each sought.  Repeated documents have a row each.

    The benchmark goes to the tasks in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_WORDS`` words, with
    a pass over the documents for each block, so what is sent at once has a bound.  Empty tables give nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text, similarity, min_words, seed):
        held = rows.sparkSession.sparkContext.broadcast(items)
        found = rows.mapInArrow(lambda batches, held=held: _scan(held.value)(batches), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return (rows.mapInArrow(_nothing, SCHEMA) if out is None else out).withColumnRenamed("id", id_col)


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, similarity: float, min_words: int, seed: int) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, or one item, read one partition at a time."""
    limit_batches(benchmark.sparkSession)
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        text = np.frombuffer(r.text.encode(), dtype=np.uint8)
        h = K.Words(text, np.array([0, len(text)]), lower=True).hashes()
        if len(h) >= min_words:
            if block and (len(block) == BLOCK_ITEMS or size + len(h) > BLOCK_WORDS):
                yield Items([i for i, _ in block], [h for _, h in block], similarity, seed)
                block, size = [], 0
            block.append((-1 if r.item_id is None else r.item_id, h))
            size += len(h)
    if block:
        yield Items([i for i, _ in block], [h for _, h in block], similarity, seed)


def _clean(items: Items, text_at: int) -> Callable:
    """The rows in whose text no item is found, all columns as they are."""

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for i, _, buf, offs in K.blocks(batch.column(text_at)):
                w = K.Words(buf, offs, lower=True)
                for d, *_ in items.find(w.hashes(), w.doc, w.offs):
                    clean[i + d] = False
            yield batch.filter(pa.array(clean))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, min_words: int = 5, seed: int = 11) -> DataFrame:
    """The rows and columns of ``docs`` in whose text ``contaminated`` finds no item.

    Null and empty texts stay, repeated rows are treated alike, and empty tables lose nothing.
    """
    out, text_at = docs, docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text, similarity, min_words, seed):
        held = docs.sparkSession.sparkContext.broadcast(items)
        out = out.mapInArrow(lambda batches, held=held: _clean(held.value, text_at)(batches), docs.schema)
    return out
