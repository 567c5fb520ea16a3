import datetime
import hashlib

from lumenlink.llm import urls, warc


def test_surt():
    assert warc.surt("https://User@Blog.Example.com:443/a/b?q=1#x") == "com,example,blog)/a/b?q=1"
    assert warc.surt("http://example.com:8080") == "com,example:8080)/"
    assert warc.surt("http://10.0.0.1/a b\n") == "10.0.0.1)/a%20b"
    assert warc.surt(None) == warc.surt("") == ""


def test_record_round_trip():
    for payload in (b"", b"<p>\r\n\r\nWARC/1.1\r\n\r\n</p>", bytes(range(256)) * 50):
        got = warc.parse(warc.record(5, "http://a/\r\nX: y", payload, "response", None))
        assert (got["kind"], got["id"], got["payload"], got["payload_bytes"]) == ("response", 5, payload, len(payload))
        got = warc.parse(warc.record(6, None, payload, "revisit", 5))
        assert (got["kind"], got["id"], got["refers_to"], got["payload_bytes"], got["payload"]) == ("revisit", 6, 5, len(payload), None)


def test_round_trip_of_edge_cases(spark):
    rows = [(1, "http://b.example/", "same", 0), (0, "http://a.example/x", "same", 0), (2, None, None, 0), (3, "", "", 0), (4, "no url at all", "größe\r\n\r\n", 0), (5, "http://a.example/x", "z" * 300_000, 0), (7, "http://a.example/x", "same", 0)]
    rows += [(100 + k, "http://hot.example/", f"page {k % 400}", 0) for k in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file int")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    first = {}
    for p, _, h, _ in sorted(rows):
        first.setdefault(h or "", p)
    for p, _, h, _ in rows:
        body = (h or "").encode()
        want = (len(body), hashlib.sha1(body).digest(), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""])
        import base64

        assert (got[p].payload_bytes, base64.b32decode(got[p].payload_digest), got[p].record_type, got[p].refers_to) == want
    assert {r.record_type for r in warc.round_trip(spark, pages, min_bytes=1 << 20).collect()} == {"response"}
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_lookup_of_some_keys(spark):
    from lumenlink.llm.store import new_path

    pages = spark.createDataFrame([(k, f"http://h{k % 50}.example/{k // 100}", str(k)) for k in range(2000)], "page_id long, url string, html string")
    root = new_path(spark, "t")
    shards = warc.build_index(warc.write_archives(pages, root), root)
    keys = spark.createDataFrame([(warc.surt("http://h7.example/3"),), ("com,nowhere)/",), ("",), ("zz)/",)], "key string")
    got = sorted(r.page_id for r in warc.read_records(warc.lookup(shards, keys)).collect())
    assert got == [k for k in range(2000) if k % 50 == 7 and k // 100 == 3]


def test_temporal_filter(spark):
    day = lambda m, d: datetime.date(2024, m, d)
    entries = spark.createDataFrame(
        [("Example.com", "block", "add", day(2, 1)), ("example.com", "block", "remove", day(3, 1)), ("example.com", "block", "add", day(3, 1)), ("example.com", "block", "remove", day(4, 1)), ("ok.example.com", "allow", "add", day(2, 10)), ("ok.example.com", "allow", "add", day(2, 10)), (None, "block", "add", day(1, 1)), ("x.org", "block", "remove", day(1, 1)), ("1.2.3.4", "block", "add", day(1, 1))],
        "domain string, kind string, action string, day date",
    )
    caps = [(1, "http://a.example.com/", day(1, 31)), (2, "https://u@a.EXAMPLE.com:80/x", day(2, 1)), (3, "http://ok.example.com", day(2, 9)), (4, "http://www.ok.example.com", day(2, 10)), (5, "http://example.com", day(3, 1)), (6, "http://example.com", day(4, 1)), (7, None, day(2, 2)), (8, "nonsense", day(2, 2)), (9, "http://example.com", None), (10, "http://notexample.com", day(2, 2)), (11, "http://1.2.3.4/", day(2, 2)), (2, "https://u@a.EXAMPLE.com:80/x", day(2, 1))]
    out = urls.temporal_filter(spark.createDataFrame([(*c, "clash") for c in caps], "page_id long, url string, day date, domain string"), entries)
    got = sorted((r.page_id, r.n_active, r.entry, r.blocked) for r in out.collect())
    assert got == sorted([(1, 0, None, False), (2, 1, "example.com", True), (2, 1, "example.com", True), (3, 1, "example.com", True), (4, 2, "ok.example.com", False), (5, 1, "example.com", True), (6, 0, None, False), (7, 0, None, False), (8, 0, None, False), (9, 0, None, False), (10, 0, None, False), (11, 1, "1.2.3.4", True)], key=lambda r: (r[0], r[1], str(r[2])))
    assert urls.temporal_filter(spark.createDataFrame([], "page_id long, url string, day date"), entries.limit(0)).collect() == []
