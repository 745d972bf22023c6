"""WARC: write captures as request, response (or revisit) and metadata records, read archives, assemble transactions.

Archives are written by Spark's text writer (each capture is one string of CRLF-framed records), so they go wherever the
shared folder is. They are read as whole files, whose size the writer bounds, and parsed as a stream by Content-Length;
gzip files of one or many members are understood. Assembly joins the records through WARC-Concurrent-To.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRLF = "\r\n"
PRINCIPAL = ("response", "revisit", "resource", "conversion")
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("http_header", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def urn(*parts: Column) -> Column:
    """A record id made from the parts; nulls count as themselves."""
    h = F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where value is null. Line breaks and other control characters become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value, "".join(map(chr, range(32))), " " * 32), F.lit(CRLF)), F.lit(""))


def _record(kind: Column, record_id: Column, headers: list[Column], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), *headers, _header("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(*lines, F.lit(CRLF), block)


def write_captures(pages: DataFrame, path: str, least: int = 100, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write each row of pages as three records to gzip archives under path: the answer, its request, its metadata.

    Of rows with equal payloads of `least` bytes or more, that with the smallest id (then url; null ids last) is a response
    and the others are revisits of it, which hold the HTTP header alone. A null payload is empty. Rows that agree in id, url
    and payload are one capture: their records have the same ids.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("body")).withColumns({"digest": F.sha2("body", 256), "bytes": F.octet_length("body")})
    named = named.withColumn("own", urn(F.lit("answer"), F.col("id"), F.col("url"), F.col("digest")))
    # who revisits whom is found without the payloads, which are then dealt out once, by their record ids
    narrow = named.select("id", "url", "digest", "bytes", "own").filter(F.col("bytes") >= least)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("url").alias("url"))
    groups = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = narrow.join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("first.id")))
    again = again.select("own", urn(F.lit("answer"), F.col("first.id"), F.col("first.url"), F.col("digest")).alias("target")).distinct()
    rows = named.repartition(F.col("own")).join(again, "own", "left")
    revisit, own = F.col("target").isNotNull(), F.col("own")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common = [_header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(date))]
    first = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [*common, _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _header("WARC-Refers-To", F.col("target")),
         _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _header("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("body"))),
    )
    clean = F.translate(F.coalesce("url", F.lit("")), "".join(map(chr, range(33))), "")
    host, place = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    request = _record(F.lit("request"), urn(F.lit("request"), F.col("id"), F.col("url"), F.col("digest")), [*common, _header("WARC-Concurrent-To", own), _header("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    metadata = _record(F.lit("metadata"), urn(F.lit("metadata"), F.col("id"), F.col("url"), F.col("digest")), [*common, _header("WARC-Concurrent-To", own), _header("Content-Type", F.lit("application/warc-fields"))], _header("source-id", F.col("id").cast("string")))
    lines = rows.select(F.concat_ws(CRLF * 2, first, request, metadata).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive, gzip or plain."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:80]!r}")
        fields: dict[str, list[str]] = {}
        last: list[str] | None = None
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                last[-1] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = fields.setdefault(name.strip().lower(), [])
            last.append(value.strip())
        one = lambda n, f=fields: f.get(n, [None])[0]
        size = int(one("content-length") or 0)
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {one('warc-record-id')} is cut off")
        head, payload = None, block
        if (one("content-type") or "").replace(" ", "").startswith("application/http"):
            at = block.find(b"\r\n\r\n")
            head, payload = (block[:at].decode("latin-1"), block[at + 4 :]) if at >= 0 else (block.decode("latin-1"), b"")
        yield {
            "record_id": one("warc-record-id"), "type": one("warc-type"), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": fields.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "payload_digest": one("warc-payload-digest"), "content_type": one("content-type"), "http_header": head, "payload": payload,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path (RECORD)."""
    kind = pa.schema([(f.name, pa.list_(pa.string()) if f.name == "concurrent_to" else pa.binary() if f.name == "payload" else pa.string()) for f in RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in parse(content.as_py()):
                    rows.append(record)
                    size += len(record["payload"]) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame, hops: int = 2) -> DataFrame:
    """One nested row per capture: capture_id, answer (struct of the response or revisit), requests, metadata (arrays).

    records: record_id, type, concurrent_to and any other columns, all kept in the nested structs. A record belongs to the
    answer that its WARC-Concurrent-To names, or that names it, directly or through `hops` - 1 other records. Records that are
    repeated count once; those without an id, or that lead to no answer, are in no capture. Null concurrent_to is empty.
    """
    records = records.filter("record_id IS NOT NULL").dropDuplicates(["record_id"])
    is_answer = F.col("type").isin(*PRINCIPAL)
    edges = records.select("record_id", is_answer.alias("answers"), F.explode_outer("concurrent_to").alias("other"))
    named = edges.filter("other IS NOT NULL")
    answers = records.filter(is_answer).select(F.col("record_id").alias("capture_id"))
    out = named.filter("NOT answers").select("record_id", "other")
    back = named.filter("answers").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    direct = out.join(answers, out.other == answers.capture_id).select("record_id", "capture_id").unionByName(back)
    for _ in range(hops - 1):
        onward = out.join(direct.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id")
        direct = direct.unionByName(onward)
    # a record that leads to several answers goes to the first of them
    member = direct.groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    whole = F.struct(*[F.col(c) for c in records.columns])
    others = records.filter(~is_answer).join(member, "record_id").select("capture_id", "type", F.struct(*[F.col(c) for c in records.columns]).alias("r"))
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("r"))), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    grouped = others.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    principal = records.filter(is_answer).select(F.col("record_id").alias("capture_id"), whole.alias("answer"))
    return principal.join(grouped, "capture_id", "left")


def resolved(captures: DataFrame, refers_to: Column, key: Column, name: str) -> DataFrame:
    """captures plus, for revisits, the key of the capture that their refers_to names, as column `name`.

    Only revisits are joined with what they name, so those that name nothing don't meet in one task.
    """
    known = captures.select(F.col("capture_id").alias("target"), key.alias(name))
    named = captures.filter(refers_to.isNotNull()).select("capture_id", refers_to.alias("target")).join(known, "target").drop("target")
    return captures.join(named, "capture_id", "left")
