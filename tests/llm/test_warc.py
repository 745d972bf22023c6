import gzip

from pyspark.sql import functions as F

from tarnloom.llm import warc
from tarnloom.llm.common import new_path
from tarnloom.llm.queries import op1_warc

BIG = "é" * 60 + "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"
PAGES = [
    (5, "http://a.b/x?y#z", BIG), (3, None, BIG), (9, "not a url\r\nX-Evil: 1", BIG), (1, "http://h", "short"), (2, "http://h/", "short"), (4, "u", None), (6, "u", ""),
    (7, "https://ü.example/ü", "\r\n\r\n" * 40), (None, "n", BIG), (8, "x", "a\u0000b" * 50), (10, "x", "<p>\n</p>" * 20000),
]


def test_query_against_brute_force(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op1_warc(spark, str(tmp_path)).collect()}
    import hashlib

    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 100 and min(same) != page_id
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", min(same)) if revisit else ("response", None))


def test_records_and_nested_captures(spark):
    path = new_path(spark, "warc-test")
    warc.write_captures(spark.createDataFrame(PAGES + PAGES[:2], "page_id long, url string, html string"), path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == len(PAGES)
    for c in captures:
        assert len(c.requests) == len(c.metadata) == 1
        assert c.requests[0].http_header.startswith("GET /") and c.requests[0].concurrent_to == [c.capture_id]
    whole = {bytes(c.answer.payload).decode() for c in captures if c.answer.type == "response"}
    assert whole == {h or "" for _, _, h in PAGES}
    assert not any("\n" in (c.answer.target_uri or "") for c in captures)


def test_parser_reads_members_and_folded_lines():
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nwarc-concurrent-to: <c>\r\nX: y\r\n z\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\nWARC-Type: response\nContent-Type: application/http; msgtype=response\nContent-Length: 9\n\nH\r\n\r\nbody\r\n\r\n"
    got = list(warc.parse(gzip.compress(one) + gzip.compress(two)))
    assert got == list(warc.parse(one + two))
    assert got[0]["concurrent_to"] == ["<b>", "<c>"] and got[0]["payload"] == b"abc" and got[1]["http_header"] == "H" and got[1]["payload"] == b"body"


def test_assembly_by_any_link(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", None), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["r1"]), ("m2", "metadata", ["r1"]), ("lost", "metadata", ["nowhere"]), (None, "request", ["r1"]), ("r2", "revisit", [])]
    out = warc.assemble(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>"))
    got = {r.capture_id: ([x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []]) for r in out.collect()}
    assert got == {"r1": (["q1"], ["m1", "m2"]), "r2": ([], [])}
    assert warc.assemble(spark.createDataFrame([], "record_id string, type string, concurrent_to array<string>")).count() == 0
    assert out.select(F.size("requests")).count() == 2
