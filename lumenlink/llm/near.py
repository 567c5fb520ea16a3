"""Near-duplicate documents by a signature-coordinate inverted join.

Every document has a min-hash signature of ``COORDS`` coordinates.  The first ``PREFIX`` of
them are posted in an inverted index under (coordinate, value); the others are skipped in the
index and only merged in - compared, one byte each - for documents that meet in a list.  Two
documents whose signatures agree in at least ``MATCHES`` coordinates are candidates, and each
candidate is confirmed on the full shingle sets.  A pair at Jaccard 0.8 shares none of the
posted coordinates with probability 0.2 ** 12 < 5e-9 and agrees in fewer than 80 of 128
coordinates with probability below 2e-6.

Documents with equal sets are one class from the start.  Posting lists of up to ``SMALL`` classes
are compared pair by pair.  Longer ones are dealt, anew for each list, into blocks of about
``BLOCK``, and a block proposes only a spanning forest of its best matches, so a group of g near
copies makes g proposals and not g * g.  What the blocks and forests have passed over is settled
exactly: pairs of blocks of the long lists are compared on signatures until candidates that share
a list are in one cluster, and in each cluster whose members are not yet linked all pairs of
blocks are confirmed side by side, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlink.llm import kernels as K
from lumenlink.llm.graph import components
from lumenlink.llm.store import keep

COORDS, PREFIX, MATCHES = 128, 12, 80
#: Lists up to SMALL are compared pair by pair; longer ones in blocks.
SMALL, BLOCK = 32, 1024
_MULT = np.random.default_rng(7).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(8).integers(1, 2**63, COORDS, dtype=np.uint64)


def _sets(column: pa.Array, shingle: int, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, offs in K.blocks(column):
        yield (i, j, *K.distinct_by_doc(*K.shingles(K.Words(buf, offs, lower), shingle)))


def _fingerprints(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sum of its members' hashes and its size."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return K.mix(sums[offs[1:]] - sums[offs[:-1]] + np.diff(offs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The min-hash of each non-empty set for each coordinate, as 64-bit words (sets x COORDS)."""
    some = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, COORDS), dtype=np.uint64)
    if len(some):
        for k in range(COORDS):
            out[some, k] = np.minimum.reduceat(values * _MULT[k] ^ _ADD[k], offs[some])
    return out


def _sign(shingle: int, lower: bool) -> Callable:
    def run(batches):
        for batch in batches:
            for i, j, values, offs in _sets(batch.column(1), shingle, lower):
                sig = signatures(values, offs)
                posted = K.mix(sig[:, :PREFIX] + np.arange(1, PREFIX + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
                rest = (K.mix(sig) & np.uint64(255)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * PREFIX, PREFIX), pa.int32()), K.signed(posted.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), K.signed(np.diff(offs)), K.signed(_fingerprints(values, offs)), lists, K.binary_rows(rest.ravel(), np.full(j - i, COORDS))],
                    names=["id", "n", "node", "keys", "sig"],
                )

    return run


def _node_sets(shingle: int, lower: bool) -> Callable:
    """Rows (node wanted, text) -> (node, its set), where the text has that set."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, values, offs in _sets(batch.column(1), shingle, lower):
                node = _fingerprints(values, offs).view(np.int64)
                rows = np.flatnonzero(node == wanted[i:j])
                if len(rows):
                    data = np.concatenate([values[offs[r] : offs[r + 1]] for r in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows]), K.binary_rows(data.view(np.uint8), 8 * np.diff(offs)[rows])], names=["node", "members"])

    return run


def _complete_groups(batches, width: int) -> Iterator[pa.Table]:
    """Rows sorted by the first ``width`` columns, regrouped so that no group is cut."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = [table.column(k).to_numpy() for k in range(width)]
        same = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            same &= k == k[-1]
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _sig_matrix(table: pa.Table) -> np.ndarray:
    col = table.column("sig").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    buf, _ = K.strings(col)
    return buf.reshape(-1, COORDS)


def _matching(sig, n, comp, i, j, num, den) -> np.ndarray:
    """Which pairs (i, j) of different components agree in enough coordinates and in size."""
    ok = (comp[i] != comp[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
    out = np.zeros(len(i), dtype=bool)
    at = np.flatnonzero(ok)
    for a in range(0, len(at), 1 << 15):
        p = at[a : a + (1 << 15)]
        out[p] = (sig[i[p]] == sig[j[p]]).sum(1) >= MATCHES
    return out


def _forest(sig, n, comp, num, den) -> tuple[np.ndarray, np.ndarray]:
    """The edges between components of a spanning forest of a block with the most matches (Prim's algorithm)."""
    g = len(sig)
    count = np.zeros((g, g), dtype=np.int16)
    for a in range(0, g, 32):
        count[a : a + 32] = (sig[a : a + 32, None, :] == sig[None, :, :]).sum(2)
    count[(den * np.minimum.outer(n, n) < num * np.maximum.outer(n, n)) | (count < MATCHES)] = -1
    count[comp[:, None] == comp[None, :]] = COORDS + 1
    near, by = np.full(g, -2), np.zeros(g, dtype=np.int64)
    out = np.zeros(g, dtype=bool)
    tree = []
    for _ in range(g):
        k = int(np.where(out, -3, near).argmax())
        out[k] = True
        if 0 <= near[k] <= COORDS:
            tree.append((by[k], k))
        closer = count[k] > near
        near, by = np.where(closer, count[k], near), np.where(closer, k, by)
    i, j = np.array(tree, dtype=np.int64).reshape(-1, 2).T
    return i, j


def _starts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the runs of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(keys[0])))


def _candidates(num: int, den: int, small: int) -> Callable:
    """Rows (key, x, y, node, n, comp, sig) sorted by key, x, y -> candidate pairs of nodes.

    All matching pairs of groups up to ``small`` rows, a spanning forest between components in larger ones.
    """

    def run(batches):
        for table in _complete_groups(batches, 3):
            key, x, y, node, n, comp = (table.column(c).to_numpy() for c in ("key", "x", "y", "node", "n", "comp"))
            sig = _sig_matrix(table)
            start, size = _starts(key, x, y)
            pairs = []
            for g in range(2, small + 1):
                s = start[size == g]
                if len(s):
                    a, b = np.triu_indices(g, 1)
                    i, j = (s[:, None] + a).ravel(), (s[:, None] + b).ravel()
                    ok = _matching(sig, n, comp, i, j, num, den)
                    pairs.append((i[ok], j[ok]))
            for s, g in zip(start[size > small], size[size > small], strict=True):
                i, j = _forest(sig[s : s + g], n[s : s + g], comp[s : s + g], num, den)
                pairs.append((i + s, j + s))
            if pairs:
                i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                got = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    return run


def _settle(num: int, den: int) -> Callable:
    """Rows (key, x, y, node, n, comp, block, sig, members) sorted by key, x, y -> links.

    Of each pair of blocks (x, y) every pair of a row of x and one of y is confirmed, but those that
    the block has joined by then.
    """

    def run(batches):
        for table in _complete_groups(batches, 3):
            key, x, y, node, n, comp, block = (table.column(c).to_numpy() for c in ("key", "x", "y", "node", "n", "comp", "block"))
            sig = _sig_matrix(table)
            members = table.column("members")
            for s, g in zip(*_starts(key, x, y), strict=True):
                left, right = np.flatnonzero(block[s : s + g] == x[s]) + s, np.flatnonzero(block[s : s + g] == y[s]) + s
                sets = {int(k): np.frombuffer(members[int(k)].as_buffer(), dtype=np.uint64) for k in range(s, s + g)}
                joined = {int(c): int(c) for c in comp[s : s + g]}

                def root(c, joined=joined):
                    while joined[c] != c:
                        joined[c] = c = joined[joined[c]]
                    return c

                links = []
                for k in left:
                    others = right[right > k] if x[s] == y[s] else right
                    ok = _matching(sig, n, comp, np.full(len(others), k), others, num, den)
                    for m in others[ok]:
                        p, q = root(int(comp[k])), root(int(comp[m]))
                        if p != q and _similar(sets[int(k)], sets[int(m)], num, den):
                            joined[max(p, q)] = min(p, q)
                            links.append((node[k], node[m]))
                if links:
                    a, b = np.array(links, dtype=np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Do two ascending sets reach the Jaccard similarity num / den?"""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or den * len(p) < num * len(q):
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return den * both >= num * (len(p) + len(q) - both)


def _confirm(num: int, den: int) -> Callable:
    """Rows (a, b, set of a, set of b) -> (a, b, linked)."""

    def run(batches):
        for batch in batches:
            left, lo = K.strings(batch.column(2))
            right, ro = K.strings(batch.column(3))
            linked = np.zeros(batch.num_rows, dtype=bool)
            for r in range(batch.num_rows):
                p, q = left[lo[r] : lo[r + 1]].tobytes(), right[ro[r] : ro[r + 1]].tobytes()
                linked[r] = _similar(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return run


PAIR = "a long, b long"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lower: bool = True, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when den * |intersection| >= num * |union| of their sets of
    ``shingle``-word shingles; component_id is the least id reachable over links, kept says
    that it is the row's own.  A text with fewer words is one shingle; null, empty and
    word-free texts have no shingle and are linked with nothing.  Equal rows are linked with
    each other; a null id is never least unless all ids of the component are null.  Only the id
    and the text are read, so further columns cannot clash.  An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = keep(rows.mapInArrow(_sign(shingle, lower), "id long, n long, node long, keys array<long>, sig binary"), "signed")
    some = signed.where("n > 0")
    # Copies are one node before anything is posted.
    nodes = keep(some.groupBy("node", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "nodes")
    posts = nodes.select("node", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    lists = keep(posts.join(shared, "key", "left_semi"), "lists")
    long = lists.groupBy("key").count().where(F.col("count") > SMALL).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    long = keep(long, "long")
    members = keep(nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "n", "id", "sig"), "members")

    def compared(posts: DataFrame, small: int) -> DataFrame:
        dealt = posts.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        return dealt.select("key", "x", "y", "node", "n", "comp", "sig").mapInArrow(_candidates(num, den, small), PAIR).distinct()

    def paired(posts: DataFrame) -> DataFrame:
        """Each row once for every pair of its block and a block of its list."""
        z = posts.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return z.withColumn("x", F.least("block", "z")).withColumn("y", F.greatest("block", "z")).drop("z")

    block = F.expr("cast(pmod(xxhash64(node, key), blocks) as int)")
    hot = keep(lists.join(long, "key").withColumn("block", block), "hot")
    brief = lists.join(long, "key", "left_anti").withColumn("block", F.lit(0))
    first = brief.unionByName(hot.drop("blocks")).withColumn("x", F.col("block")).withColumn("y", F.col("block"))
    pairs = keep(compared(first.join(members.drop("id"), "node").withColumn("comp", F.col("node")), SMALL), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    hot_lists = not long.isEmpty()
    if hot_lists:
        # Clusters of candidates, over the long lists only: no candidates of one list may be in two.
        clusters = keep(components(pairs), "clusters")
        named = keep(hot.join(clusters, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
        mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        bridges = keep(compared(paired(named.join(mixed, "key", "left_semi")).join(members.drop("id"), "node"), 1), "bridges")
        wanted = wanted.union(bridges.select("a")).union(bridges.select("b"))
        clusters = components(clusters.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(bridges)).withColumnRenamed("comp", "key")
    wanted = members.join(wanted.distinct(), "node", "left_semi").select("node", F.col("id").alias("wanted_id"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id"))).select("node", "text")
    sets = keep(texts.mapInArrow(_node_sets(shingle, lower), "node long, members binary"), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    tested = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num, den), f"{PAIR}, linked boolean")
    links = keep(tested.where("linked").select("a", "b"), "links")
    labels = keep(components(links), "labels")
    if hot_lists:
        # Clusters whose members are not yet in one component.
        inside = hot.select("node").distinct().join(clusters, "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        inside = keep(inside, "inside")
        open_ = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo < hi")
        dealt = paired(inside.join(open_.select("key", "blocks"), "key").withColumn("block", block)).join(members.drop("id"), "node").join(sets, "node")
        dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "node", "n", "comp", "block", "sig", "members")
        more = dealt.mapInArrow(_settle(num, den), PAIR)
        labels = keep(components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)), "labels")
    ids = nodes.select("node", "id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = ids.select("node", "comp").join(least, "comp").select("node", "component_id")
    out = signed.select("id", "n", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` that ``near_duplicates`` keeps: one of each component.

    Of rows that share an id one is kept, the least by a hash of the text.  Rows without an id cannot
    be told apart and are all kept if one of them is.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    names = found.where("kept").select(key.alias("kept_id")).distinct()
    out = docs.join(names, key == F.col("kept_id"), "left_semi")
    ids = found.agg(F.count(F.lit(1)), F.count_distinct(id_col), F.count(id_col)).first()
    if ids[1] < ids[2]:
        turn = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(text_col)))
        named = out.where(F.col(id_col).isNotNull()).withColumn("lumenlink_turn", turn).where("lumenlink_turn = 1").drop("lumenlink_turn")
        out = named.unionByName(out.where(F.col(id_col).isNull()))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.y AS component_id, d.doc_id = m.y AS kept
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
