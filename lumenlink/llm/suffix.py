"""Substring dedup by column-wise construction of a collection's Burrows-Wheeler transform.

``Collection`` builds the transform and the common prefixes of many strings at once, from their last
column to their first.  Each round inserts one symbol of every string: the symbol goes to where the
string's last suffix lies in the transform, the rank of it among its like tells where the new,
longer suffix belongs, and the transform and the prefixes are written anew in one pass from the old
ones, with the new suffixes in between.  The prefix of a new suffix and a neighbour that begins with the
same symbol is that symbol and the least prefix on the way between the two old places.

To find what repeats in a corpus, its texts are first cut into strings that can be compared
column by column.  Every window of ``length`` bytes has an *anchor*: of the 16-byte grams that
start in its first half, the leftmost with the least hash.  The anchor depends on the window's
bytes alone, so equal windows have it at the same offset, and windows of one anchor are
neighbours.  An anchor's string reaches from its first window's start to its last window's end, in
columns relative to the anchor; equal windows then begin in the same column.  All windows of
an anchor share the bytes after it, more than half of ``length``: they are the string's *core*, one
symbol of the transform, which is named by their hash.  Strings of one core are a *bucket*, and equal
strings of a bucket are one string with a weight.  Buckets of one occurrence have nothing to compare.
A collection is built of whole buckets; a window repeats if its string has weight or its suffix
shares ``length`` bytes with a neighbour in the transform, when its round has been inserted.

Buckets are split by the offsets of the windows: windows of near offsets share more bytes beside the
anchor, which become part of the core and so of the bucket's name, and the strings get shorter.  Every
bucket is split once where its collection is built, which makes rounds few and transforms small; a bucket
with more than ``BUCKET`` different strings is first split into buckets of the whole corpus, again and again until
they are small enough; at a single offset equal windows are equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.llm import kernels as K
from lumenlink.llm.near import _complete_groups
from lumenlink.llm.store import keep

GRAM = 16
#: Strings that a collection holds, unless its last bucket has more; different strings of a bucket; parts that a larger one is split into.
COLLECTION, BUCKET, SPLIT = 1024, 2048, 8
_CHUNK = 1 << 22
U = np.uint64


class Collection:
    """The transform of ``count`` strings, in which every round inserts the next symbol to the left of some of them.

    ``bwt`` holds, in the order of the suffixes, the symbol before each, and 0 where none has come yet;
    ``prefix[k]`` the common prefix of suffixes k - 1 and k in bytes; ``at`` where each string's longest
    suffix lies.  Both are read and written front to back once a round, as files would be; a
    collection has a bounded size, so they are kept in memory.  Symbols are 1 to ``core`` - 1; cores are the largest.
    """

    def __init__(self, count: int, wide: bool = False):
        self.count = count
        self.kind, self.core = (np.uint16, 1 << 15) if wide else (np.uint8, 255)
        self.bwt = np.zeros(count, dtype=self.kind)
        self.prefix = np.zeros(count + 1, dtype=np.int16)
        self.at = np.arange(count)

    def round(self, rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Insert a symbol of each of ``rows`` -> the rows in the order of their new suffixes, and the larger common prefix of each with a neighbour."""
        at = self.at[rows]
        self.bwt[at] = symbols
        # Old places by their symbols: the k-th is followed, in the new transform, by ``count`` + k.
        order = np.argsort(self.bwt, kind="stable")[len(self.bwt) - np.count_nonzero(self.bwt) :]
        new = np.zeros(len(self.bwt), dtype=bool)
        new[at] = True
        rank = np.flatnonzero(new[order])
        owner = np.empty(len(self.bwt), dtype=np.int32)
        owner[at] = rows
        old = order[rank]
        first, final = np.maximum(rank - 1, 0), np.minimum(rank + 1, len(order) - 1)
        before = (rank > 0) & (self.bwt[order[first]] == self.bwt[old])
        after = (rank < len(order) - 1) & (self.bwt[order[final]] == self.bwt[old])
        return self._insert(owner[old], rank, old, (before, order[first]), (after, order[final]), np.ones(len(rank), dtype=np.int16))

    def cores(self, rows: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``round``, for the cores of all rows at once: core ``group[k]`` of ``size[k]`` bytes."""
        at = self.at[rows]
        self.bwt[at] = self.core
        order = np.lexsort((at, group))
        old, group = at[order], group[order]
        same = group[1:] == group[:-1]
        before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
        rank = np.count_nonzero(self.bwt) - len(rows) + np.arange(len(rows))
        return self._insert(rows[order], rank, old, (before, np.roll(old, 1)), (after, np.roll(old, -1)), size[order].astype(np.int16))

    def _insert(self, rows, rank, old, before, after, size) -> tuple[np.ndarray, np.ndarray]:
        some_before, some_after = (np.flatnonzero(x[0]) for x in (before, after))
        start = np.concatenate([before[1][some_before], old[some_after]]) + 1
        end = np.concatenate([old[some_before], after[1][some_after]]) + 1
        least = np.zeros(len(start), dtype=np.int16)
        if len(start):
            by = np.argsort(start, kind="stable")  # so that what lies between two ranges is passed once
            bounds = np.empty(2 * len(start), dtype=np.int64)
            bounds[::2], bounds[1::2] = start[by], end[by]
            least[by] = np.minimum.reduceat(self.prefix, bounds)[::2]
        left, right = np.zeros(len(rows), dtype=np.int16), np.zeros(len(rows), dtype=np.int16)
        left[some_before] = least[: len(some_before)] + size[some_before]
        right[some_after] = least[len(some_before) :] + size[some_after]
        place = self.count + rank
        stays = np.ones(len(self.bwt) + len(rows), dtype=bool)
        stays[place] = False
        bwt, prefix = np.zeros(len(stays), dtype=self.kind), np.zeros(len(stays) + 1, dtype=np.int16)
        bwt[stays], prefix[:-1][stays] = self.bwt, self.prefix[:-1]
        prefix[place], prefix[place + 1] = left, right
        prefix[place] = left  # a new suffix after another one
        self.bwt, self.prefix, self.at[rows] = bwt, prefix, place
        return rows, np.maximum(left, right)


def columns(parts: list[bytes], flush_right: bool) -> np.ndarray:
    """Strings as rows of a table of symbols, a byte's being 1 more than it; what a shorter one has not is 0."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    width = int(size.max(initial=0))
    table = np.zeros((len(parts), width), dtype=np.uint16)
    row = np.repeat(np.arange(len(parts)), size)
    place = K._ranges(width - size if flush_right else np.zeros(len(parts), dtype=np.int64), size)
    table[row, place] = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint16) + 1
    return table


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], width: np.ndarray, hi: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the largest and the least offset, len(left) >= offset >= hi bytes before its core, of a window that repeats; -1 for none."""
    lo = np.array([len(x) for x in left], dtype=np.int64)
    most, least = np.where(weight > 1, lo, -1), np.where(weight > 1, hi, -1)
    heads, tails = columns(left, True), columns(right, False)
    bwt = Collection(len(left), bool(max(heads.max(initial=0), tails.max(initial=0)) >= 255))
    for k in range(tails.shape[1] - 1, -1, -1):
        rows = np.flatnonzero(tails[:, k])
        bwt.round(rows, tails[rows, k])
    rows, shared = bwt.cores(np.arange(len(left)), group, length - width + 1)
    for offset in range(heads.shape[1] + 1):
        if offset:
            rows = np.flatnonzero(heads[:, -offset])
            rows, shared = bwt.round(rows, heads[rows, -offset])
        found = rows[(shared >= length) & (lo[rows] >= offset) & (hi[rows] <= offset)]
        most[found] = np.maximum(most[found], offset)
        least[found] = np.where(least[found] < 0, offset, np.minimum(least[found], offset))
    return most, least


class Sites:
    """The anchors of the windows of a block: document, place, offsets of the windows, keys."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int):
        self.width = length - length // 2  # grams that a window chooses from
        roll = K.Rolling(buf)
        n = len(buf) - length + 1
        start, anchor = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, max(n, 0), _CHUNK):
            b = min(n, a + _CHUNK)
            at = np.arange(a, b + self.width - 1)
            h = K.mix(roll.raw(at, at + GRAM))
            h = (h >> U(24) << U(24)) | (at - a).astype(np.uint64)
            span = 1
            while span * 2 <= self.width:
                h = np.minimum(h[: len(h) - span], h[span:])
                span *= 2
            least = np.minimum(h[: b - a], h[self.width - span : self.width - span + b - a])
            start.append(np.arange(a, b))
            anchor.append((least & U((1 << 24) - 1)).astype(np.int64) + a)
        start, anchor = np.concatenate(start), np.concatenate(anchor)
        doc = np.searchsorted(offs, start, side="right") - 1
        inside = start + length <= offs[doc + 1]
        start, anchor, doc = start[inside], anchor[inside], doc[inside]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        self.place, self.doc = anchor[first], doc[first]
        self.begin, self.end = start[first], start[last] + length
        self.lo, self.hi = self.place - self.begin, self.place - start[last]
        self.key = roll.of(self.place, self.place + length - self.width + 1) if len(first) else np.zeros(0, dtype=np.uint64)
        self.string = K.mix(roll.of(self.begin, self.end) + self.lo.astype(np.uint64) * U(0x9E3779B97F4A7C15)) if len(first) else self.key


def _sites(length: int) -> Callable:
    """Rows (row, text) -> (row, key, string, pos, more, weight), pos packing the place and the offsets of an anchor's windows.

    Equal strings of a text no more than ``length`` apart, as in a text of one word, are one row: its
    first place, how far the last one lies behind, and their number.  Their windows all repeat,
    and together cover all that lies between.
    """

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for i, _, buf, offs in K.blocks(batch.column(1)):
                s = Sites(buf, offs, length)
                if len(s.doc):
                    order = np.lexsort((s.place, s.string, s.doc))
                    doc, string, place = s.doc[order], s.string[order], s.place[order]
                    new = np.ones(len(doc), dtype=bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (string[1:] != string[:-1]) | (place[1:] - place[:-1] > length)
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(doc)) - 1
                    at = order[first]
                    pos = ((place[first] - offs[doc[first]]) << 24) | (s.lo[at] << 12) | s.hi[at]
                    columns = [pa.array(rows[i + doc[first]]), K.signed(s.key[at]), K.signed(string[first]), pa.array(pos), pa.array(place[last] - place[first]), pa.array(last - first + 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "string", "pos", "more", "weight"])

    return run


SITE = "row long, key long, string long, pos long, more long, weight long"


def repeated_in_buckets(group: np.ndarray, left: list[bytes], right: list[bytes], width: np.ndarray, hi: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeated_windows``, with one collection for every COLLECTION or so of the strings' parts."""
    cores: dict[tuple, int] = {}
    kinds: dict[tuple, int] = {}
    made: list[tuple] = []  # (group, width, hi, left, right) of each kind
    of, which, shift = [], [], []
    for k, (g, w, h, x, y) in enumerate(zip(group.tolist(), width.tolist(), hi.tolist(), left, right, strict=True)):
        for a, wide, least, core, head, tail in parts_of(w, h, x, y):
            c = cores.setdefault((g, a, core), len(cores))
            kind = kinds.setdefault((c, least, head, tail), len(made))
            if kind == len(made):
                made.append((c, wide, least, head, tail))
            of.append(k)
            which.append(kind)
            shift.append(a)
    of, which, shift = (np.array(x, dtype=np.int64) for x in (of, which, shift))
    weights = np.bincount(which, weights=weight[of], minlength=len(made)).astype(np.int64)
    core = np.array([m[0] for m in made], dtype=np.int64)
    start = np.array([m[2] for m in made], dtype=np.int64)
    most = np.where(weights > 1, [len(m[3]) for m in made], -1)
    least = np.where(weights > 1, start, -1)
    order = np.argsort(core, kind="stable")
    order = order[np.bincount(core)[core[order]] > 1]
    for part in _parts(core[order]):
        r = order[part]
        _, c = np.unique(core[r], return_inverse=True)
        most[r], least[r] = repeated_windows(c, [made[k][3] for k in r], [made[k][4] for k in r], np.array([made[k][1] for k in r], dtype=np.int64), start[r], weights[r], length)
    top, bottom = np.full(len(group), -1), np.full(len(group), 1 << 40)
    got = most[which] >= 0
    np.maximum.at(top, of[got], (shift + most[which])[got])
    np.minimum.at(bottom, of[got], (shift + least[which])[got])
    return top, np.where(top < 0, -1, bottom)


STRING = "key long, string long, weight long, width long, hi long, left binary, right binary"
_STRING = (pa.int64(),) * 5 + (pa.binary(),) * 2
_NAMES = ["key", "string", "weight", "width", "hi", "left", "right"]


def _batch(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _strings(length: int) -> Callable:
    """Rows (text, wanted strings of it) -> (key, string, weight, width, hi, left and right of the core)."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for i, _, buf, offs in K.blocks(batch.column(0)):
                s = Sites(buf, offs, length)
                names, keys = s.string.view(np.int64), s.key.view(np.int64)
                bounds, after = np.searchsorted(s.doc, np.arange(len(offs))), s.place + (length - s.width + 1)
                out = []
                for d in range(len(offs) - 1):
                    ask = {w["string"]: w["weight"] for w in wanted[i + d]}
                    for k in range(bounds[d], bounds[d + 1]):
                        weight = ask.pop(int(names[k]), None)
                        if weight is not None:
                            out.append((int(keys[k]), int(names[k]), weight, s.width, int(s.hi[k]), buf[s.begin[k] : s.place[k]].tobytes(), buf[after[k] : s.end[k]].tobytes()))
                if out:
                    yield _batch(out, _STRING, _NAMES)

    return run


def _judge(length: int) -> Callable:
    """Strings sorted by key, whole buckets together -> (key, string, most, least) of those with a window that repeats."""

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for table in _complete_groups(batches, 1):
            held.append(table)
            rows += table.num_rows
            if rows >= COLLECTION:
                yield from judged(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield from judged(pa.concat_tables(held))

    def judged(table):
        # A text that is there twice has sent its strings twice.
        key, string = (table.column(c).to_numpy() for c in _NAMES[:2])
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (string[1:] != string[:-1])
        table = table.filter(pa.array(new))
        key, string, weight, width, hi = (table.column(c).to_numpy() for c in _NAMES[:5])
        left, right = table.column("left"), table.column("right")
        alone = np.ones(len(key), dtype=bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        # A string without another one of its bucket repeats as a whole or not at all.
        whole = np.flatnonzero(alone & (weight > 1))
        if len(whole):
            yield pa.RecordBatch.from_arrays([pa.array(key[whole]), pa.array(string[whole]), pa.array([len(left[int(k)].as_py()) for k in whole], pa.int64()), pa.array(hi[whole])], names=VERDICT_NAMES)
        rows = np.flatnonzero(~alone)
        for part in _parts(key[rows]):
            r = rows[part]
            group = np.cumsum(np.concatenate([[0], (key[r][1:] != key[r][:-1]).astype(np.int64)]))
            most, least = repeated_in_buckets(group, *([c[int(k)].as_py() for k in r] for c in (left, right)), width[r], hi[r], weight[r], length)
            got = most >= 0
            if got.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[got]) for x in (key[r], string[r], most, least)], names=VERDICT_NAMES)

    return run


VERDICT, VERDICT_NAMES = "key long, string long, most long, least long", ["key", "string", "most", "least"]


def _parts(key: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in runs of about COLLECTION that keep equal keys together."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    a = 0
    while a < len(key):
        k = np.searchsorted(cuts, a + COLLECTION, side="right")
        b = int(cuts[k - 1]) if k and cuts[k - 1] > a else int(cuts[k]) if k < len(cuts) else len(key)
        if len(key) - a <= COLLECTION:
            b = len(key)
        yield np.arange(a, b)
        a = b


def parts_of(width: int, hi: int, left: bytes, right: bytes) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """The parts of a string whose windows lie 0 to ``width`` - 1 bytes before its core: (first offset, width, hi, bytes that join the core, left, right)."""
    step = -(-width // SPLIT)
    for a in range(0, width, step):
        b = min(width, a + step)  # windows at offsets a to b - 1
        if hi < b and len(left) >= a:
            lo, least, grown = min(len(left), b - 1), max(hi, a) - a, width - b
            yield a, b - a, least, left[len(left) - a :] + right[:grown], left[len(left) - lo : len(left) - a], right[grown : width - 1 - a - least]


def _split(batches):
    """Strings of large buckets -> those of their parts, with the string that each is of and the first offset of the part."""
    for batch in batches:
        out = []
        for key, string, weight, width, hi, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a, w, least, core, head, tail in parts_of(width, hi, left, right):
                name = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big", signed=True)
                out.append((name(key, a, core), name(least, head, tail), weight, w, least, head, tail, key, string, a))
        if out:
            yield _batch(out, _STRING + (pa.int64(),) * 3, [*_NAMES, "of_key", "of_string", "first"])


def _cut(length: int) -> Callable:
    """Rows (id, text, spans) -> (id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""

    def run(batches):
        for batch in batches:
            out = []
            buf, offs = K.strings(batch.column(1))
            for d, spans in enumerate(batch.column(2).to_pylist()):
                text = buf[offs[d] : offs[d + 1]]
                if not spans:
                    out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                    continue
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                start, end = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64).T
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge)[:-1] > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _verdicts(strings: DataFrame, length: int) -> DataFrame:
    """Strings (STRING), some perhaps twice -> (key, string, most, least); buckets above BUCKET are split until there are none."""
    large = keep(strings.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "large")
    is_large = not large.isEmpty()
    calm = strings.join(large, "key", "left_anti") if is_large else strings
    out = calm.repartition("key").sortWithinPartitions("key", "string").mapInArrow(_judge(length), VERDICT)
    if is_large:
        parts = keep(strings.join(large, "key", "left_semi").dropDuplicates(["key", "string"]).mapInArrow(_split, f"{STRING}, of_key long, of_string long, first long"), "parts")
        whole = parts.groupBy("key", "string").agg(F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in _NAMES[3:]))
        inner = keep(_verdicts(keep(whole.select(_NAMES), "strings"), length), "verdicts")
        back = parts.select("key", "string", "of_key", "of_string", "first").join(inner, ["key", "string"])
        out = out.unionByName(back.groupBy(F.col("of_key").alias("key"), F.col("of_string").alias("string")).agg(F.max(F.col("first") + F.col("most")).alias("most"), F.min(F.col("first") + F.col("least")).alias("least")))
    return out


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """Rows (row, text), row naming the text -> (row, start, end): spans that cover exactly the bytes of repeated windows."""
    if not 2 * GRAM <= length < 4096:
        raise ValueError(f"length must be from {2 * GRAM} to 4095 bytes")
    sites = rows.where(F.octet_length("text") >= length).mapInArrow(_sites(length), SITE)
    met = sites.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    shared = keep(sites.join(met, "key", "left_semi"), "sites")
    strings = keep(shared.groupBy("key", "string").agg(F.sum("weight").alias("weight"), F.min("row").alias("row")), "strings")
    asked = strings.groupBy("row").agg(F.collect_list(F.struct("string", "weight")).alias("wanted"))
    texts = rows.join(asked, "row").select("text", "wanted")
    verdicts = _verdicts(keep(texts.mapInArrow(_strings(length), STRING), "texts"), length)
    hits = shared.join(keep(verdicts, "verdicts"), ["key", "string"])
    place = F.shiftright("pos", 24)
    return hits.select("row", (place - F.col("most")).alias("start"), (place + F.col("more") - F.col("least") + length).alias("end"))


def row_name(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def cut_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans, kept_sha256, kept (nothing is removed).

    Texts are UTF-8 bytes (null: empty).  Every byte covered by a ``length``-byte string that also
    starts elsewhere - in another row or in the same one, overlaps included - is removed; all are
    judged on the input.  Repeated rows repeat each other.  Shorter texts lose nothing, and an empty
    table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", row_name("id", "text"))
    spans = repeated_spans(rows.select("row", "text"), length).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = dict(docs.dtypes)[id_col]
    cut = rows.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(_cut(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumn("kept", F.col("n_removed") == 0).withColumnRenamed("id", id_col)
