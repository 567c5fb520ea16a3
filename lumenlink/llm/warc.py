"""WARC archives with a two-level capture index.

``write_archives`` writes one record for each page, its own gzip member, and returns where each
lies.  ``build_index`` sorts the captures by reversed-host URL key into shards of compressed
blocks; every shard has a sparse directory with the first key of each block.  ``lookup`` goes from
a key to a shard by the shards' first keys, to a block by binary search in the shard's directory,
to the line by binary search in the block; ``read_records`` then reads the byte ranges.

Files lie in the folder shared by driver and executors and carry the number of the task attempt, so
a task that runs again leaves the file of an earlier attempt unused instead of changing it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlink.llm.store import keep, new_path

#: Lines of one compressed index block, bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 256, 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(?:#.*)?$", re.S)


def _escape(text: str) -> str:
    """White space and controls as percent escapes, so that a URL is one word of one line."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, then port, path and query.  A null URL has the empty key."""
    if not url:
        return ""
    scheme, host, port, path, query = _URL.match(url.strip()).groups()
    host = host.lower().rstrip(".")
    key = host if host.startswith("[") or re.fullmatch(r"[\d.]+", host) else ",".join(reversed(host.split(".")))
    if port and (scheme or "http").lower() + port not in ("http80", "https443"):
        key += f":{port}"
    return _escape(f"{key}){path or '/'}{query or ''}")


def _open(uri: str, write: bool = False):
    store, path = fs.FileSystem.from_uri(uri)
    if not write:
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member.  A revisit has the HTTP head of the full payload, without it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escape(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> dict:
    """The parts of a record: kind, id, refers_to, payload (None for a revisit), payload_bytes, digest; checks the digest."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])
    out = {"kind": named["WARC-Type"], "id": page(named["WARC-Record-ID"]), "refers_to": page(named.get("WARC-Refers-To")), "payload_bytes": size, "digest": digest, "payload": None}
    if out["kind"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged payload in record {named['WARC-Record-ID']}")
        out["payload"] = payload
    return out


def _tag() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def _write_records(root: str) -> Callable:
    """Rows (page_id, url, html, refers_to) -> (key, page_id, file, at, size)."""

    def run(batches):
        sink, n, at = None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None or at >= ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        path, n, at = f"{root}/pages-{_tag()}-{n:04d}.warc.gz", n + 1, 0
                        sink = _open(path, write=True)
                    member = record(page_id, url, (html or "").encode(), "response" if refers_to is None else "revisit", refers_to)
                    sink.write(member)
                    rows.append((surt(url), page_id, path, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "at", "size"])
        finally:
            if sink is not None:
                sink.close()

    return run


RECORD = "key string, page_id long, file string, at long, size long"


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``root`` -> (key, page_id, file, at, size) of each record.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the least page_id is
    a response and the others revisit it; rows that share that least id too, and records without an
    id where none has one, are responses.  A null html is an empty payload.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(text, "UTF-8")).alias("digest"), F.octet_length(text).alias("bytes"))
    # What revisits what is settled on ids and digests; the payloads then move once, under the ids of their records.
    ids = rows.where(F.col("bytes") >= min_bytes).select("page_id", "digest", "bytes")
    first = ids.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = ids.join(first, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("first").alias("refers_to"))
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    return keep(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write_records(root), RECORD), "records")


def _write_shard(root: str) -> Callable:
    """Sorted rows of a partition -> a shard of compressed blocks and its directory; one row (first, last, shard, blocks)."""

    def run(batches):
        path, sink, at, lines, directory, last = f"{root}/index-{_tag()}", None, 0, [], [], ""

        def flush():
            nonlocal at, lines, last
            data = zlib.compress("\n".join(lines).encode(), 6)
            sink.write(data)
            directory.append([lines[0].split(" ", 1)[0], at, len(data)])
            last = lines[-1].split(" ", 1)[0]
            at, lines = at + len(data), []

        try:
            for batch in batches:
                for key, page_id, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        sink = _open(f"{path}.blocks", write=True)
                    lines.append(f"{key} " + json.dumps([page_id, file, start, size]))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
        finally:
            if sink is not None:
                sink.close()
        if directory:
            with _open(f"{path}.directory", write=True) as out:
                out.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "last": last, "shard": path, "blocks": len(directory)}])

    return run


def build_index(records: DataFrame, root: str) -> DataFrame:
    """Captures of ``write_archives`` -> the table of shards (first, last, shard, blocks).

    Equal keys are told apart by page_id and place, so that a key with very many captures spreads
    over several shards.
    """
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "at"]
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(ranged.mapInArrow(_write_shard(root), "first string, last string, shard string, blocks long"), "shards")


def _find(batches) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key) sorted -> captures of the keys in the shard: directory, block, line by binary search."""
    shard, directory, source, firsts = None, [], None, []
    block_at, lines, keys = -1, [], []
    for batch in batches:
        out = []
        for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != shard:
                if source is not None:
                    source.close()
                with _open(f"{name}.directory") as f:
                    directory = json.loads(f.read())
                shard, source, block_at, firsts = name, _open(f"{name}.blocks"), -1, [d[0].encode() for d in directory]
            wanted = key.encode()
            b = max(0, bisect_left(firsts, wanted) - 1)
            while b < len(directory) and (firsts[b] <= wanted):
                if b != block_at:
                    _, at, size = directory[b]
                    source.seek(at)
                    lines = zlib.decompress(source.read(size)).decode().split("\n")
                    block_at, keys = b, [x.split(" ", 1)[0].encode() for x in lines]
                for k in range(bisect_left(keys, wanted), bisect_right(keys, wanted)):
                    page_id, file, start, size = json.loads(lines[k].split(" ", 1)[1])
                    out.append((key, page_id, file, start, size))
                b += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "at", "size"])
    if source is not None:
        source.close()


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures (key, page_id, file, at, size) of the distinct keys in the column ``key``.

    The driver holds a row for each shard, as many as the index job had tasks; what grows with the
    captures stays in the files.
    """
    spark = shards.sparkSession
    top = sorted((r["first"].encode(), r["last"].encode(), r["shard"]) for r in shards.collect())
    firsts, lasts, names = [t[0] for t in top], [t[1] for t in top], [t[2] for t in top]
    held = spark.sparkContext.broadcast((firsts, lasts, names))

    def route(batches):
        firsts, lasts, names = held.value
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                k = key.encode()
                rows += [(names[s], key) for s in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["shard", "key"])

    routed = keys.select("key").distinct().mapInArrow(route, "shard string, key string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(_find, RECORD)


def _read(batches) -> Iterator[pa.RecordBatch]:
    """Rows (file, at, size) sorted -> the parsed records."""
    name, source = None, None
    for batch in batches:
        out = []
        for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, _open(file)
            source.seek(at)
            r = parse(source.read(size))
            out.append((r["id"], r["payload_bytes"], r["digest"], r["kind"], r["refers_to"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    with suppress(AttributeError):
        source.close()


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame) -> DataFrame:
    """Range-read the records of captures, in the order of their files; payloads are checked against their digests."""
    return captures.select("file", "at", "size").repartition("file").sortWithinPartitions("file", "at").mapInArrow(_read, READ)


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])


def url_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct keys of the URLs."""
    return urls.select(F.col(url_col)).mapInArrow(_keys, "key string").distinct()


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, index them, look all their URLs up and read every capture back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.  An empty
    table gives none.
    """
    root = new_path(spark, "warc")
    records = write_archives(pages, root, min_bytes)
    shards = build_index(records, root)
    return read_records(lookup(shards, url_keys(pages)))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(p.h, {at}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)"
_B32 = " || ".join(_LETTER.format(at=5 * k + 1, shift=shift) for k in range(8) for shift in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes, {_B32} AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
