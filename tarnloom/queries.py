"""The registered queries over the driver's tables, and their equivalents in SQL."""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plans
from .functions import codes, keys, values
from .lineage import cut, shared_dir
from .operators import audit, bulk, lookup, similar, submit, summary, sync, tree
from .sources import dump, fixtures
from .sources.similarity import SimilarityIndex
from .sources.store import Registry, put
from .streaming import publisher

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = "".join(sql) if isinstance(sql, (tuple, list)) else sql
        return f

    return put


def p(expr: str) -> str:
    return f"('0x' || substr(sha256({expr}), 1, 2))::INT"


REC = f"""
WITH rec AS (
  SELECT doc_id AS seq, key, content_hash, size, {p('key')} AS partition_id, status, created_s, code, code IS NOT NULL AS has_code
  FROM (SELECT doc_id, 'f01551220' || sha256('doc-' || doc_id::VARCHAR) AS key, sha256(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size,
               CASE WHEN doc_id % 10 = 0 THEN 'pending' ELSE 'published' END AS status, 1704067200 + doc_id AS created_s,
               CASE WHEN doc_id % 7 <> 0 THEN '0x' || substr(md5(coalesce(text, '')), 1, 16) END AS code
        FROM documents))
"""
EV = f"""
WITH ev AS (SELECT event_id AS seq, user_id::VARCHAR || ':' || event_type AS key, sha256(props) AS content_hash, octet_length(encode(props))::BIGINT AS size, (epoch_us(ts) // 1000)::BIGINT AS created_ms FROM events),
o AS (SELECT *, CASE WHEN first_seq = seq THEN 'queued' WHEN first_hash = content_hash THEN 'duplicate' ELSE 'conflict' END AS outcome
      FROM (SELECT *, first_value(seq) OVER w AS first_seq, first_value(content_hash) OVER w AS first_hash FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq)))
"""
VEC = """
WITH vec AS (SELECT 'vec-' || vec_id::VARCHAR AS key, vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS b FROM embeddings),
vh AS (SELECT *, '0x' || lpad(lower(to_hex(b::UBIGINT)), 16, '0') AS code FROM vec)
"""
DENIED = "(SELECT DISTINCT 'f01551220' || sha256('doc-' || doc_id::VARCHAR) AS key FROM labels WHERE toxic = 1)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d)


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return submit.classify(fixtures.submissions(spark, d).select("seq", "key", "content_hash", "size", "created_at", "partition_id"))


# -- counts and summaries ----------------------------------------------------------------------------------------------


@query(REC + "SELECT partition_id, count(*)::BIGINT AS records, count(code)::BIGINT AS with_code, (max(created_s) * 1000)::BIGINT AS latest_added_ms, round(100.0 * count(code) / count(*), 1)::DOUBLE AS code_percent FROM rec GROUP BY partition_id")
def records_per_partition(spark, d):
    return summary.per_partition(docs(spark, d)).select("partition_id", "records", "with_code", F.unix_millis("latest_added_at").alias("latest_added_ms"), F.col("code_percent").cast("double").alias("code_percent"))


@query(REC + """, e AS (SELECT partition_id, count(*) AS n, count(code) AS c, max(created_s) AS t FROM rec GROUP BY partition_id)
SELECT sum(n)::BIGINT AS total, sum(c)::BIGINT AS with_code, count(*)::BIGINT AS readable, (256 - count(*))::BIGINT AS empty, round(avg(n), 4)::DOUBLE AS avg_records,
  max(n)::BIGINT AS max_records, (SELECT max(partition_id) FROM e WHERE n = (SELECT max(n) FROM e))::INT AS max_partition, min(n)::BIGINT AS min_records, (SELECT min(partition_id) FROM e WHERE n = (SELECT min(n) FROM e))::INT AS min_partition,
  round(100.0 * sum(c) / sum(n), 1)::DOUBLE AS code_percent, ((sum(n)::BIGINT // count(*)) * 256)::BIGINT AS estimate, (max(t) * 1000)::BIGINT AS latest_added_ms FROM e""")
def partition_summary(spark, d):
    out = summary.summary(docs(spark, d))
    return out.withColumn("code_percent", F.col("code_percent").cast("double"))


@query(REC + "SELECT status, count(*)::BIGINT AS records, sum(size)::BIGINT AS bytes FROM rec GROUP BY status")
def records_by_status(spark, d):
    return summary.by_status(docs(spark, d))


@query(REC + """, e AS (SELECT partition_id, count(*) AS n, bool_and(seq % 3 <> 0) AS complete FROM rec GROUP BY partition_id), q AS (SELECT r.i AS partition_id, n, coalesce(complete, true) AS complete FROM range(256) r(i) LEFT JOIN e ON e.partition_id = r.i)
SELECT count(*) FILTER (WHERE n > 0 AND complete)::BIGINT AS readable, count(*) FILTER (WHERE n IS NULL AND partition_id % 2 = 0)::BIGINT AS empty, count(*) FILTER (WHERE n > 0 AND NOT complete)::BIGINT AS "partial", count(*) FILTER (WHERE n IS NULL AND partition_id % 2 = 1)::BIGINT AS unreadable FROM q""")
def partition_classes(spark, d):
    each = docs(spark, d).groupBy("partition_id").agg(F.count("*").alias("n"), F.every(F.col("seq") % 3 != 0).alias("c"))
    reads = spark.range(256).select(F.col("id").cast("int").alias("partition_id")).join(each, "partition_id", "left")
    reads = reads.select("partition_id", F.when(F.col("n").isNull() & (F.col("partition_id") % 2 == 0), 0).otherwise(F.col("n")).alias("records"), F.coalesce("c", F.lit(True)).alias("complete"))
    return summary.partition_classes(reads)


@query("""WITH s AS (SELECT event_type AS series, (epoch_us(ts) // 1000)::BIGINT AS at_ms, count(*)::BIGINT AS n FROM events GROUP BY ALL), t AS (SELECT series, at_ms, (sum(n) OVER (PARTITION BY series ORDER BY at_ms))::BIGINT AS total FROM s),
r AS (SELECT *, list_filter(list(struct_pack(a := at_ms, t := total)) OVER (PARTITION BY series ORDER BY at_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), lambda x: x.a >= at_ms - 60000)[1] AS o FROM t)
SELECT series, at_ms, total, round(CASE WHEN at_ms - o.a >= 3000 AND total > o.t THEN (total - o.t) * 1000.0 / (at_ms - o.a) ELSE 0 END, 6)::DOUBLE AS rate FROM r""")
def ingest_rate(spark, d):
    s = fixtures.table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")).agg(F.count("*").alias("n"))
    s = s.withColumn("total", F.sum("n").over(Window.partitionBy("series").orderBy("at_ms"))).drop("n")
    return summary.ingest_rate(s).withColumn("rate", F.round("rate", 6).cast("double"))


@query("SELECT o_orderpriority AS series, o_orderkey AS name, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) <= 7 AS kept FROM orders")
def keep_n_prune(spark, d):
    files = fixtures.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("name"))
    return summary.keep_newest(files, 7, "series")


# -- keys and scalars --------------------------------------------------------------------------------------------------


@query(REC + """SELECT key, partition_id, 'partition/' || lpad(partition_id::VARCHAR, 3, '0') AS name, ('0x' || substr(sha256(key), 3, 2))::INT AS b0, ('0x' || substr(sha256(key), 5, 2))::INT AS b1,
  ('0x' || substr(sha256(key), 7, 2))::INT AS b2, ('0x' || substr(sha256(key), 65 - 2, 2))::INT AS b30, partition_id AS back FROM rec""")
def key_partition_path(spark, d):
    k = F.col("key")
    name = keys.partition_name(F.col("partition_id"))
    return docs(spark, d).select("key", "partition_id", name.alias("name"), *[keys.descent_byte(k, i).alias(f"b{i}") for i in (0, 1, 2, 30)], keys.named_partition(name).alias("back"))


@query(REC + """, k AS (SELECT seq, CASE seq % 5 WHEN 0 THEN key WHEN 1 THEN 'bbqjca' || repeat('a', 51) WHEN 2 THEN 'bbqjcc' || repeat('a', 51) WHEN 3 THEN upper(key) ELSE 'no key' END AS key, size FROM rec)
SELECT seq, regexp_matches(key, '^bbqjc[ab][a-z2-7]{51}$') AS legacy, seq % 5 IN (0, 1, 3) AS valid, CASE WHEN seq % 5 IN (0, 1, 3) THEN CASE WHEN size > 1000 THEN 'value_too_large' END ELSE 'invalid_key' END AS error FROM k""")
def key_filter(spark, d):
    n = F.col("seq") % 5
    key = F.when(n == 0, F.col("key")).when(n == 1, F.lit("bbqjca" + "a" * 51)).when(n == 2, F.lit("bbqjcc" + "a" * 51)).when(n == 3, F.upper("key")).otherwise("no key")
    rows = docs(spark, d).select("seq", key.alias("key"), F.col("value"))
    text = F.coalesce("value", F.lit(""))
    return rows.select("seq", keys.is_legacy_key(F.col("key")).alias("legacy"), keys.is_valid_key(F.col("key")).alias("valid"), submit.reject_code(F.col("key"), text, text, 1000).alias("error"))


@query("""SELECT page_id AS seq, octet_length(encode(coalesce(html, '')))::BIGINT AS size, CASE WHEN octet_length(encode(coalesce(html, ''))) > 4000 THEN 'value_too_large' END AS error,
  CASE WHEN octet_length(encode(coalesce(html, ''))) > 4000 THEN 413 END AS http FROM pages""")
def size_filter(spark, d):
    rows = _checked_pages(spark, d)
    return rows.select("seq", "size", "error", submit.http_status(F.col("error")).alias("http"))


def _checked_pages(spark, d):
    """Pages as submissions of their html, with the first rule that each breaks."""
    html = F.coalesce("html", F.lit(""))
    rows = fixtures.table(spark, d, "pages").select(F.col("page_id").alias("seq"), fixtures.key_of("page-", F.col("page_id")).alias("key"), html.alias("html"))
    return rows.select("seq", values.size(F.col("html")).alias("size"), submit.reject_code(F.col("key"), F.col("html"), F.col("html"), 4000).alias("error"))


@query("""SELECT doc_id AS seq, CASE doc_id % 8 WHEN 0 THEN '{"a":"' || lang || '","b":1}' WHEN 1 THEN '{"z": ' || doc_id || '}' WHEN 5 THEN '{"ISCC":' || doc_id || ',"iscc":"x"}'
    WHEN 6 THEN '{"Iscc":"k' || doc_id || '","x":1}' WHEN 7 THEN '{"ISCC":"K' || doc_id || '"}' END AS canonical,
  CASE doc_id % 8 WHEN 6 THEN 'k' || doc_id WHEN 7 THEN 'K' || doc_id END AS iscc, CASE doc_id % 8 WHEN 5 THEN 'x' WHEN 7 THEN 'K' || doc_id ELSE '-' END AS listed FROM documents WHERE lang IS NOT NULL""")
def canonical_values(spark, d):
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    raw = (
        F.when(n == 0, F.concat(F.lit('{"b":1,"a":"'), "lang", F.lit('"}'))).when(n == 1, F.concat(F.lit('"{\\"z\\": '), i, F.lit('}"'))).when(n == 2, "[1]").when(n == 3, "not json")
        .when(n == 4, '"text"').when(n == 5, F.concat(F.lit('{"ISCC":'), i, F.lit(',"iscc":"x"}'))).when(n == 6, F.concat(F.lit('{"x":1,"Iscc":"k'), i, F.lit('"}'))).otherwise(F.concat(F.lit('{"ISCC":"K'), i, F.lit('"}')))
    )
    rows = fixtures.table(spark, d, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").alias("seq"), raw.alias("v"))
    return rows.select("seq", values.canonical(F.col("v")).alias("canonical"), values.iscc_field(F.col("v")).alias("iscc"), values.listed_iscc(F.col("v")).alias("listed"))


@query("""SELECT doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 1700000000000 + doc_id ELSE 1704067200000 END::BIGINT AS created_ms FROM documents""")
def declared_timestamps(spark, d):
    i = F.col("doc_id").cast("string")
    v = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"timestamp":'), (F.col("doc_id") + 1700000000000).cast("string"), F.lit("}"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"timestamp":"'), i, F.lit('"}')))
    v = v.when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"timestamp":'), i, F.lit(".5}"))).otherwise("[]")
    at = values.created_at(v, F.timestamp_seconds(F.lit(fixtures.BASE_SECONDS)))
    return fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.unix_millis(at).alias("created_ms"))


@query(REC + """, b AS (SELECT key, code, ('x' || substr(code, 3))::BLOB AS x, substr(code, 3) AS h FROM rec WHERE code IS NOT NULL)
SELECT key, code, code AS back, 21::INT AS n FROM b""")
def iscc_roundtrip(spark, d):
    rows = docs(spark, d).filter("content_code IS NOT NULL")
    text = codes.encode(F.col("content_code"), 3)
    return rows.select("key", codes.shown(F.col("content_code")).alias("code"), codes.shown(codes.decode(text)).alias("back"), F.length(text).alias("n"))


@query("""SELECT doc_id AS seq, CASE doc_id % 6 WHEN 0 THEN '0x0101010070020204' WHEN 1 THEN '0xbcc8e0988e9b2fca' END AS code FROM documents""")
def iscc_decode_rejects(spark, d):
    n = F.col("doc_id") % 6
    text = F.when(n == 0, "iscc:EAAQCAIBABYAEAQE").when(n == 1, " KECXLCNDPDGLFHV6XTEOBGEOTMX4UZPF756V2P7R5CN3V67P2UHW6MY").when(n == 2, "TESTTESTTESTTEST").when(n == 3, "Iscc:EAAQCAIBABYAEAQE").when(n == 4, "EAAQCAIBABYAEAQ").otherwise("")
    code = codes.decode(text)
    return fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.when(code.isNotNull(), codes.shown(code)).alias("code"))


# -- reads -------------------------------------------------------------------------------------------------------------


def _key(spark, d, ident: int) -> str:
    return "f01551220" + hashlib.sha256(f"doc-{ident}".encode()).hexdigest()


@query(REC + "SELECT key, partition_id, content_hash, size, status, (created_s * 1000)::BIGINT AS created_ms FROM rec WHERE seq = 42")
def point_lookup(spark, d):
    return lookup.get(docs(spark, d), _key(spark, d, 42)).select("key", "partition_id", "content_hash", "size", "status", F.unix_millis("created_at").alias("created_ms"))


@query("SELECT 'f01551220' || sha256('doc--1') AS key, false AS found, 'not_found' AS status, NULL::BIGINT AS size")
def record_not_found(spark, d):
    return lookup.found(docs(spark, d), _key(spark, d, -1)).select("key", "found", "status", "size")


@query(REC + ", w AS (SELECT doc_id AS pos, 'f01551220' || sha256('doc-' || (doc_id * 3)::VARCHAR) AS key FROM documents) SELECT pos, w.key, content_hash, rec.key IS NOT NULL AS found FROM w LEFT JOIN rec ON w.key = rec.key")
def batch_lookup_positional(spark, d):
    wanted = fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), fixtures.key_of("doc-", F.col("doc_id") * 3).alias("key"))
    return lookup.get_many(wanted, docs(spark, d).select("key", "content_hash")).select("pos", "key", "content_hash", "found")


@query(REC + "SELECT key, size FROM rec ORDER BY key LIMIT 50 OFFSET 100")
def list_page(spark, d):
    return lookup.page(docs(spark, d), 100, 50).select("key", "size")


@query(REC + "SELECT key, size FROM rec WHERE partition_id = 7 ORDER BY key LIMIT 20")
def list_partition(spark, d):
    return lookup.page(docs(spark, d), 0, 20, 7).select("key", "size")


@query(REC + "SELECT partition_id, key, coalesce(code, '-') AS code FROM rec ORDER BY partition_id, key LIMIT 200")
def list_max(spark, d):
    return lookup.listing(docs(spark, d), most=200)


@query(REC + "SELECT partition_id::VARCHAR || chr(9) || key || chr(9) || coalesce(code, '-') AS line FROM rec")
def list_tsv(spark, d):
    return lookup.tsv(lookup.listing(docs(spark, d)))


@query(REC + "SELECT partition_id, count(*)::BIGINT AS records, ceil(count(*) / 3.0)::BIGINT AS pages FROM rec GROUP BY partition_id")
def page_count(spark, d):
    return lookup.pages(docs(spark, d), 3)


@query(REC + ", b AS (SELECT DISTINCT content_hash FROM rec WHERE seq % 4 <> 0) SELECT key, CASE WHEN b.content_hash IS NULL THEN 'content unavailable' END AS value_error FROM rec LEFT JOIN b USING (content_hash)")
def entry_values(spark, d):
    own = docs(spark, d)
    blobs = own.filter("seq % 4 <> 0").select(F.col("content_hash").alias("hash"), "value").dropDuplicates(["hash"])
    return lookup.with_values(own, blobs).select("key", "value_error")


# -- the write path ----------------------------------------------------------------------------------------------------


@query(EV + "SELECT seq, key, outcome, CASE WHEN outcome <> 'queued' THEN first_hash END AS existing_hash FROM o")
def submit_outcomes(spark, d):
    return outcomes(spark, d).select("seq", "key", "outcome", "existing_hash")


@query(EV + "SELECT count(*)::BIGINT AS lines_read, count(*) FILTER (WHERE outcome = 'queued')::BIGINT AS new_records, count(*) FILTER (WHERE outcome = 'duplicate')::BIGINT AS duplicates, count(*) FILTER (WHERE outcome = 'conflict')::BIGINT AS conflicts FROM o")
def submit_counters(spark, d):
    return submit.counters(outcomes(spark, d))


@query(EV + "SELECT seq, key, content_hash, first_hash AS existing_hash FROM o WHERE outcome = 'conflict'")
def conflict_rows(spark, d):
    return outcomes(spark, d).filter("outcome = 'conflict'").select("seq", "key", "content_hash", "existing_hash")


@query(EV + """, i AS (SELECT key, content_hash AS indexed FROM o WHERE outcome = 'queued' AND seq % 2 = 0)
SELECT seq, o.key, CASE WHEN indexed IS NOT NULL THEN CASE WHEN indexed = content_hash THEN 'duplicate' ELSE 'conflict' END ELSE outcome END AS outcome FROM o LEFT JOIN i ON o.key = i.key""")
def submit_against_index(spark, d):
    index = outcomes(spark, d).filter("outcome = 'queued' AND seq % 2 = 0").select("key", "content_hash")
    return submit.classify(fixtures.submissions(spark, d), index).select("seq", "key", "outcome")


@query(EV + "SELECT (100 + row_number() OVER (ORDER BY seq) - 1)::BIGINT AS queue_seq, key FROM o WHERE outcome = 'queued'")
def queue_sequence(spark, d):
    return submit.enqueue(outcomes(spark, d), 100)


@query(EV + "SELECT partition_id, key, seq, content_hash FROM (SELECT *, " + p("key") + " AS partition_id FROM o) WHERE outcome = 'queued'")
def first_write_wins_build(spark, d):
    return submit.first_writes(fixtures.submissions(spark, d)).select("partition_id", "key", "seq", "content_hash")


def _queue(spark, d):
    """Every third key of the queue has lost its record."""
    queued = submit.first_writes(fixtures.submissions(spark, d))
    return queued.select("seq", "key"), queued.filter("seq % 3 <> 0")


_Q = EV + ", q AS (SELECT seq, key, " + p("key") + " AS partition_id, content_hash FROM o WHERE outcome = 'queued')"


@query(_Q + " SELECT seq AS queue_seq, key FROM q WHERE seq % 3 <> 0 ORDER BY seq LIMIT 100")
def pending_batch(spark, d):
    return submit.pending_batch(*_queue(spark, d), 100).select("queue_seq", "key")


@query(_Q + ", b AS (SELECT * FROM q WHERE seq % 3 <> 0 ORDER BY seq LIMIT 300) SELECT partition_id, count(*)::BIGINT AS n, min(seq)::BIGINT AS first_seq, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM b GROUP BY partition_id")
def publish_group_counts(spark, d):
    batch = submit.pending_batch(*_queue(spark, d), 300)
    seqs = F.array_join(F.transform(F.array_sort(F.collect_list("queue_seq")), lambda x: x.cast("string")), ",")
    return batch.groupBy("partition_id").agg(F.count("*").alias("n"), F.min("queue_seq").alias("first_seq"), seqs.alias("seqs"))


@query(REC + ", n AS " + DENIED + " SELECT key, CASE WHEN n.key IS NULL THEN 'published' ELSE 'denylisted' END AS status, CASE WHEN n.key IS NULL THEN 1704153600000 END::BIGINT AS published_ms FROM rec LEFT JOIN n USING (key) WHERE rec.status = 'pending'")
def publish_denied(spark, d):
    pending = docs(spark, d).filter("status = 'pending'")
    done = submit.split_denied(pending, fixtures.denied(spark, d))
    return submit.finish(pending, done, F.timestamp_seconds(F.lit(1704153600))).select("key", "status", F.unix_millis("published_at").alias("published_ms"))


@query(_Q + " SELECT seq, key FROM q WHERE seq % 5 <> 0")
def drained_queue(spark, d):
    queue = submit.first_writes(fixtures.submissions(spark, d)).select("seq", "key")
    return submit.drain(queue, queue.filter("seq % 5 = 0"))


@query(_Q + " SELECT (1000 + row_number() OVER (ORDER BY key) - 1)::BIGINT AS seq, key FROM q WHERE seq % 3 <> 0 AND seq % 2 = 0")
def requeued(spark, d):
    queue, records = _queue(spark, d)
    return submit.requeue(queue.filter("seq % 2 = 0"), records, 1000)


@query(EV + ", r AS (SELECT key FROM o WHERE outcome = 'queued' AND seq % 2 = 0) SELECT count(r.key)::BIGINT AS updated, (count(*) - count(r.key))::BIGINT AS missing FROM ev LEFT JOIN r ON ev.key = r.key")
def retimestamp_counts(spark, d):
    rows = fixtures.submissions(spark, d)
    records = submit.first_writes(rows).filter("seq % 2 = 0")
    return submit.update_created_at(records, rows)[1]


@query(EV + ", r AS (SELECT key FROM o WHERE outcome = 'queued' AND seq % 2 = 0) SELECT key, max_by(created_ms, seq)::BIGINT AS created_ms FROM ev JOIN r USING (key) GROUP BY key")
def retimestamped(spark, d):
    rows = fixtures.submissions(spark, d)
    records = submit.first_writes(rows).filter("seq % 2 = 0")
    return submit.update_created_at(records, rows)[0].select("key", F.unix_millis("created_at").alias("created_ms"))


@query(REC + ", n AS " + DENIED + " SELECT key, partition_id FROM rec ANTI JOIN n USING (key)")
def denylist_exclusion(spark, d):
    return tree.without(docs(spark, d), fixtures.denied(spark, d)).select("key", "partition_id")


def nodes_sql(source: str, limit: int, depths: int = 5) -> str:
    """CTEs over `source` (key, content_hash, size, created_ms): n{d} (part, prefix, x) is each node of depth d with its hash.
    Trees deeper than `depths` levels are not written out."""
    out = f"""tk AS (SELECT key, sha256(key) AS h, key || chr(9) || content_hash || chr(9) || size || chr(9) || created_ms || chr(9) || '-' AS line FROM {source}),
tc AS (SELECT r.d AS depth, substr(h, 1, 2) AS part, substr(h, 3, 2 * r.d) AS prefix, count(*) AS n FROM tk, range({depths}) r(d) GROUP BY ALL),
tn AS (SELECT * FROM tc WHERE depth = 0 OR (SELECT u.n FROM tc u WHERE u.depth = tc.depth - 1 AND u.part = tc.part AND u.prefix = substr(tc.prefix, 1, 2 * tc.depth - 2)) > {limit}),
tl AS (SELECT depth, part, prefix, sha256('L' || chr(10) || string_agg(line, chr(10) ORDER BY key)) AS x FROM tn JOIN tk ON substr(h, 1, 2) = part AND substr(h, 3, 2 * depth) = prefix WHERE n <= {limit} GROUP BY ALL)"""
    for d in range(depths - 1, -1, -1):
        up = "" if d == depths - 1 else f" UNION ALL SELECT part, substr(prefix, 1, {2 * d}), sha256('I' || chr(10) || string_agg(substr(prefix, {2 * d + 1}, 2) || chr(9) || x, chr(10) ORDER BY prefix)) FROM n{d + 1} GROUP BY part, substr(prefix, 1, {2 * d})"
        out += f",\nn{d} AS (SELECT part, prefix, x FROM tl WHERE depth = {d}{up})"
    return out


ROOTS = " SELECT 'partition/' || lpad(('0x' || part)::INT::VARCHAR, 3, '0') AS name, x AS root FROM n0"

# -- audit and garbage -------------------------------------------------------------------------------------------------


def _sides(spark, d):
    """The trees lack every eleventh published key and hold the pending keys of every third."""
    records = docs(spark, d)
    in_tree = records.filter("(status = 'published' AND seq % 11 <> 0) OR (status = 'pending' AND seq % 3 = 0)")
    return records, audit.expected(records), in_tree


_A = REC + ", e AS (SELECT partition_id, key FROM rec WHERE status = 'published'), t AS (SELECT partition_id, key FROM rec WHERE (status = 'published' AND seq % 11 <> 0) OR (status = 'pending' AND seq % 3 = 0))"


@query(_A + " SELECT partition_id, key FROM e ANTI JOIN t USING (partition_id, key)")
def audit_missing(spark, d):
    _, e, t = _sides(spark, d)
    return audit.missing(e, t)


@query(_A + " SELECT partition_id, key FROM t ANTI JOIN e USING (partition_id, key)")
def audit_foreign(spark, d):
    _, e, t = _sides(spark, d)
    return audit.foreign(e, t)


@query(_A + """, m AS (SELECT * FROM e ANTI JOIN t USING (partition_id, key)), f AS (SELECT * FROM t ANTI JOIN e USING (partition_id, key))
SELECT (SELECT count(DISTINCT partition_id) FROM (FROM e UNION FROM t))::BIGINT AS partitions, (SELECT count(*) FROM e)::BIGINT AS expected, (SELECT count(*) FROM t)::BIGINT AS in_tree,
  (SELECT count(*) FROM m)::BIGINT AS missing, (SELECT count(*) FROM f)::BIGINT AS foreign_keys, (SELECT count(*) FROM m)::BIGINT AS requeued, false AS failed""")
def verify_report(spark, d):
    records, e, t = _sides(spark, d)
    return audit.report(e, t, audit.fix(audit.missing(e, t), records, 0))


_G = REC + """, tr AS (SELECT * FROM rec WHERE seq % 3 = 0 AND code IS NULL), src AS (SELECT key, content_hash, size, created_s * 1000 AS created_ms FROM tr),
""" + nodes_sql("src", 2) + """,
l AS (SELECT content_hash AS hash FROM rec WHERE seq % 3 = 1 UNION SELECT content_hash FROM tr UNION SELECT x FROM n0 UNION SELECT x FROM n1 UNION SELECT x FROM n2 UNION SELECT x FROM n3 UNION SELECT x FROM n4),
b AS (SELECT content_hash AS hash FROM rec UNION SELECT x FROM n0 UNION SELECT sha256(x) FROM n0)"""


def _garbage(spark, d):
    """A third of the records is indexed, of another third those without a code are in trees. There are also old nodes that
    nothing names any more."""
    records = docs(spark, d)
    in_trees = records.filter("seq % 3 = 0 AND content_code IS NULL")
    nodes, roots = bulk.build(in_trees, 2)
    live = audit.live(records.filter("seq % 3 = 1"), tree.marked(nodes, in_trees), roots=roots)
    stored = put(records.select(F.col("content_hash").alias("hash")), roots.select(F.col("root").alias("hash")).unionByName(roots.select(F.sha2("root", 256).alias("hash"))))
    return stored, live


@query(_G + " SELECT hash FROM l")
def gc_live(spark, d):
    return _garbage(spark, d)[1]


@query(_G + " SELECT hash FROM b ANTI JOIN l USING (hash)")
def gc_garbage(spark, d):
    return audit.collect_garbage(*_garbage(spark, d), snapshot=1, writing=False)


# -- similarity --------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    rows = fixtures.vector_codes(spark, d)
    return rows.select(F.col("key").alias("query_key"), F.col("content_code").alias("query_code")), rows


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("query_key", "key", F.col("distance").cast("int").alias("distance"))


_H = VEC + " SELECT q.key AS query_key, e.key, bit_count(xor(q.b, e.b))::INT AS distance FROM vec q, vec e WHERE bit_count(xor(q.b, e.b)) <= "


@query(_H + "20")
def hamming_pairs_exact(spark, d):
    q, e = _vectors(spark, d)
    return _pairs(similar.brute_force(q, e, 20))


@query(_H + "15")
def hamming_pairs_banded(spark, d):
    return _pairs(similar.hamming_join(*_vectors(spark, d), 15))


@query(_H + "12")
def hamming_pairs_planned(spark, d):
    q, e = _vectors(spark, d)
    return _pairs(plans.hamming(q, e, 12, q.count(), e.count()))


def _band(x: str, i: str, width: int = 8) -> str:
    return f"substr({x}::VARCHAR, {width} * {i} + 1, {width})"


@query(_H + "24 AND EXISTS (SELECT 1 FROM range(8) r(i) WHERE " + _band("q.b", "r.i") + " = " + _band("e.b", "r.i") + ")")
def banded_pairs_p0(spark, d):
    return _pairs(similar.hamming_join(*_vectors(spark, d), 24, probe=0))


@query(_H + "22 AND EXISTS (SELECT 1 FROM range(8) r(i) WHERE bit_count(xor(" + _band("q.b", "r.i") + "::BIT, " + _band("e.b", "r.i") + "::BIT)) <= 1)")
def probe_pairs_p1(spark, d):
    return _pairs(similar.hamming_join(*_vectors(spark, d), 22, probe=1))


@query(VEC + ", v AS (SELECT *, " + p("key") + " AS partition_id FROM vh) SELECT partition_id, key, code, bit_count(xor(b, (SELECT b FROM v WHERE vec_id = 7)))::INT AS distance FROM v WHERE bit_count(xor(b, (SELECT b FROM v WHERE vec_id = 7))) <= 16 ORDER BY distance, partition_id, key LIMIT 500")
def nns_topk(spark, d):
    rows = fixtures.with_partition(fixtures.vector_codes(spark, d))
    code = rows.filter("vec_id = 7").select("content_code").first()[0]  # a search's argument
    return similar.exact(rows, code, 30, 9999).select("partition_id", "key", codes.shown(F.col("content_code")).alias("code"), F.col("distance").cast("int").alias("distance"))


@query(VEC + ", x AS (SELECT r.i AS i, " + _band("b", "r.i") + " AS v FROM vec, range(8) r(i)) SELECT 'iscc/' || lpad(i::VARCHAR, 2, '0') || '/' || lpad(lower(to_hex(v::BIT::UTINYINT::UBIGINT)), 16, '0') AS bucket, count(*)::BIGINT AS members FROM x GROUP BY i, v")
def band_bucket_sizes(spark, d):
    return similar.bucket_sizes(similar.bands(fixtures.vector_codes(spark, d)))


@query(VEC + """, c AS (SELECT e.key, e.code, bit_count(xor(q.b, e.b))::INT AS distance FROM vh q, vh e WHERE q.vec_id = 3 AND bit_count(xor(q.b, e.b)) <= 26),
k AS (SELECT key, min(struct_pack(distance := distance, code := code)) AS m FROM c GROUP BY key)
SELECT k.key, m.distance AS distance, lang, text IS NULL AS lost FROM k LEFT JOIN documents ON doc_id = 2 * substr(k.key, 5)::BIGINT""")
def similar_fetch(spark, d):
    rows = fixtures.vector_codes(spark, d)
    query_ = rows.filter("vec_id = 3").select(F.col("key").alias("query_key"), F.col("content_code").alias("query_code"))
    best = similar.verified(similar.brute_force(query_, rows, 26), 26)
    have = fixtures.table(spark, d, "documents").select(F.concat(F.lit("vec-"), (F.col("doc_id") / 2).cast("long").cast("string")).alias("key"), "lang", "text", (F.col("doc_id") % 2 == 0).alias("even")).filter("even")
    return similar.fetched(best, have).select("key", F.col("distance").cast("int").alias("distance"), "lang", F.col("text").isNull().alias("lost"))


@query(REC + "SELECT count(*)::BIGINT AS scanned, count(code)::BIGINT AS with_content_code FROM rec")
def code_coverage(spark, d):
    return similar.coverage(docs(spark, d))


def _index(spark, d):
    """Vectors' codes, added in three versions; the last brings many again."""
    rows = fixtures.vector_codes(spark, d)
    index = SimilarityIndex(spark, workspace(spark, "bands"))
    for version, some in ((1, rows.filter("vec_id % 2 = 0")), (2, rows.filter("vec_id % 2 = 1")), (3, rows.filter("vec_id % 3 = 0"))):
        index.add(some, version)
    return index


@query(_H + "15")
def index_search(spark, d):
    return _pairs(_index(spark, d).search(_vectors(spark, d)[0], 15))


_B = ", m AS (SELECT r.i AS i, " + _band("b", "r.i") + " AS v, key, code, 2 - (vec_id + 1) % 2 AS version FROM (SELECT vec.*, code FROM vec JOIN vh USING (key)), range(8) r(i))"


@query(VEC + _B + """, s AS (SELECT 'iscc/' || lpad(i::VARCHAR, 2, '0') || '/' || lpad(lower(to_hex(v::BIT::UTINYINT::UBIGINT)), 16, '0') AS bucket, version::BIGINT AS version, count(*)::BIGINT AS members,
  sha256(string_agg(key || chr(9) || code, chr(10) ORDER BY key || chr(9) || code)) AS hash FROM m GROUP BY ALL) SELECT * FROM s""")
def index_segments(spark, d):
    return _index(spark, d).segments()


# -- trees -------------------------------------------------------------------------------------------------------------

_T = EV + """, k AS (SELECT key, sha256(key) AS h FROM o WHERE outcome = 'queued'), c AS (SELECT r.d AS depth, substr(h, 1, 2) AS part, substr(h, 3, 2 * r.d) AS prefix, count(*)::BIGINT AS n FROM k, range(5) r(d) GROUP BY ALL),
n AS (SELECT ('0x' || part)::INT AS partition_id, depth::INT AS depth, prefix, CASE WHEN n <= 2 THEN 'leaf' ELSE 'intermediate' END AS kind, n AS n_entries FROM c
      WHERE depth = 0 OR (SELECT u.n FROM c u WHERE u.depth = c.depth - 1 AND u.part = c.part AND u.prefix = substr(c.prefix, 1, 2 * c.depth - 2)) > 2)"""


def _entries(spark, d):
    return submit.first_writes(fixtures.submissions(spark, d)).withColumn("content_code", F.lit(None).cast("long"))


@query(_T + " SELECT partition_id, depth, prefix, kind, n_entries FROM n")
def tree_shape(spark, d):
    return tree.shape(_entries(spark, d), 2)


@query(_T + " SELECT depth, kind, count(*)::BIGINT AS nodes, sum(n_entries)::BIGINT AS entries FROM n GROUP BY depth, kind")
def tree_shape_by_depth(spark, d):
    return tree.shape(_entries(spark, d), 2).groupBy("depth", "kind").agg(F.count("*").alias("nodes"), F.sum("n_entries").alias("entries"))


_N = EV + ", src AS (SELECT * FROM o WHERE outcome = 'queued'{}),\n" + nodes_sql("src", 2)


@query(_N.replace("{}", "") + ROOTS)
def tree_roots(spark, d):
    return bulk.build(_entries(spark, d), 2)[1]


def _grown(spark, d, denied: str | None = None) -> DataFrame:
    """A tree of a third of the entries, then of another, then of all of them again. denied: whose keys the denylist has."""
    rows = cut(_entries(spark, d).drop("value"))  # once, not once a batch and denylist
    denylist = None if denied is None else rows.filter(denied).select("key")
    nodes = bulk.build(rows.filter("seq % 3 = 0"), 2, denylist)[0]
    for some in (rows.filter("seq % 3 = 1"), rows):
        nodes = tree.updated(nodes, tree.insert(nodes, some, 2, denylist))
    return nodes


@query(_N.replace("{}", "") + ROOTS)
def tree_insert_batch(spark, d):
    return tree.roots(_grown(spark, d))


@query(_N.replace("{}", " AND seq % 5 <> 0") + ROOTS)
def tree_insert_denied(spark, d):
    return tree.roots(_grown(spark, d, "seq % 5 = 0"))


@query(_N.replace("{}", "") + " SELECT x AS hash FROM n0 UNION SELECT x FROM n1 UNION SELECT x FROM n2 UNION SELECT x FROM n3 UNION SELECT x FROM n4 UNION SELECT content_hash FROM src")
def tree_marks(spark, d):
    rows = _entries(spark, d)
    return tree.marked(bulk.build(rows, 2)[0], rows)


# -- roots and replicas ------------------------------------------------------------------------------------------------

_R = REC + """, log AS (SELECT 'partition/' || lpad(partition_id::VARCHAR, 3, '0') AS name, content_hash AS root, seq AS version FROM rec UNION ALL SELECT 'iscc-index/root', sha256('x'), 1 UNION ALL SELECT 'partition/999', sha256('y'), 2),
latest AS (SELECT name, max_by(root, version) AS root FROM log GROUP BY name), r AS (SELECT replace(name, 'partition/', '')::INT AS partition_id, root FROM latest WHERE name LIKE 'partition/%' AND name <> 'partition/999'),
s AS (SELECT partition_id, max_by(content_hash, seq) AS synced_root, count(*)::BIGINT AS records, max(created_s) * 1000 AS ms FROM rec WHERE seq % 4 <> 0 AND partition_id % 10 <> 0 GROUP BY partition_id)"""


def _roots(spark, d):
    records = docs(spark, d)
    log = records.select(keys.partition_name(F.col("partition_id")).alias("name"), F.col("content_hash").alias("root"), F.col("seq").alias("version"))
    more = spark.sql("SELECT 'iscc-index/root' AS name, sha2('x', 256) AS root, 1L AS version UNION ALL SELECT 'partition/999', sha2('y', 256), 2L")
    synced = records.filter("seq % 4 <> 0 AND partition_id % 10 <> 0").groupBy("partition_id").agg(F.max_by("content_hash", "seq").alias("root"), F.count("*").alias("records"), F.max("created_at").alias("latest_added_at"))
    synced = synced.select("partition_id", "root", "records", F.col("latest_added_at").alias("synced_at"), "latest_added_at", F.when(F.col("partition_id") % 7 == 0, "timed out").alias("stale_error"))
    return sync.partition_roots(log.unionByName(more)), synced


@query(_R + " SELECT partition_id, root FROM r")
def partition_roots(spark, d):
    return _roots(spark, d)[0]


@query(_R + " SELECT partition_id, root, synced_root FROM r LEFT JOIN s USING (partition_id) WHERE root IS DISTINCT FROM synced_root")
def behind_partitions(spark, d):
    return sync.behind(*_roots(spark, d))


@query(_R + " SELECT partition_id FROM r ANTI JOIN s USING (partition_id)")
def pending_partitions(spark, d):
    return sync.never_synced(*_roots(spark, d))


@query(_R + " SELECT partition_id, root FROM r LEFT JOIN s USING (partition_id) WHERE partition_id < 20 OR root IS DISTINCT FROM synced_root OR (synced_root IS NOT NULL AND partition_id % 7 = 0)")
def sync_work(spark, d):
    asked = spark.range(20).select(F.col("id").cast("int").alias("partition_id"))
    return sync.work(*_roots(spark, d), requested=asked, pass_number=5)


@query(_R + """ SELECT partition_id, CASE WHEN synced_root IS NULL THEN 'pending' WHEN root = synced_root THEN 'current' ELSE 'behind' END AS state, coalesce(records, 0)::BIGINT AS records,
  strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS latest_added_at FROM r LEFT JOIN s USING (partition_id)""")
def partitions_overview(spark, d):
    return sync.overview(*_roots(spark, d))


@query(_R + " SELECT count(*)::BIGINT AS roots_known, count(*) FILTER (WHERE root IS DISTINCT FROM synced_root)::BIGINT AS behind, coalesce(sum(records), 0)::BIGINT AS records, max(ms)::BIGINT AS latest_added_ms FROM r LEFT JOIN s USING (partition_id)")
def sync_status(spark, d):
    return sync.status(*_roots(spark, d))


@query(_R + """, n AS (SELECT partition_id, root, partition_id % 3 = 0 AS good FROM r WHERE partition_id % 2 = 0)
SELECT coalesce(n.partition_id, s.partition_id) AS partition_id, CASE WHEN good THEN n.root ELSE synced_root END AS root, CASE WHEN good THEN 1 ELSE s.records END::BIGINT AS records,
  CASE WHEN good THEN NULL WHEN n.partition_id IS NOT NULL THEN 'incomplete' WHEN s.partition_id % 7 = 0 THEN 'timed out' END AS stale_error FROM s FULL JOIN n ON s.partition_id = n.partition_id""")
def refreshed_state(spark, d):
    roots, synced = _roots(spark, d)
    at = F.timestamp_seconds(F.lit(fixtures.BASE_SECONDS))
    results = roots.filter("partition_id % 2 = 0").select("partition_id", "root", F.lit(1).cast("long").alias("records"), at.alias("synced_at"), at.alias("latest_added_at"), F.when(F.col("partition_id") % 3 != 0, "incomplete").alias("error"))
    return sync.refreshed(synced, results).select("partition_id", "root", "records", "stale_error")


@query(_R + " SELECT coalesce(r.partition_id, s.partition_id) AS partition_id, coalesce(root, synced_root) AS root, CASE WHEN root <> synced_root THEN synced_root END AS fallback FROM (SELECT * FROM r WHERE partition_id % 5 <> 0) r FULL JOIN s ON r.partition_id = s.partition_id")
def restore_fallback(spark, d):
    roots, synced = _roots(spark, d)
    return sync.restored(roots.filter("partition_id % 5 <> 0"), synced)


@query(_R + " SELECT 'to_document' AS side, name, root FROM latest WHERE name LIKE 'partition/_0_' UNION ALL SELECT 'to_local', name, root FROM latest WHERE name LIKE 'partition/_1_'")
def heal_roots(spark, d):
    roots = _roots(spark, d)[0].select(keys.partition_name(F.col("partition_id")).alias("name"), "root")
    extra = spark.sql("SELECT 'partition/999' AS name, sha2('y', 256) AS root")
    document, local = roots.filter("name NOT LIKE 'partition/_0_'").unionByName(extra), roots.filter("name NOT LIKE 'partition/_1_'").unionByName(extra)
    a, b = sync.seeded(document, local)
    return a.select(F.lit("to_document").alias("side"), "name", "root").unionByName(b.select(F.lit("to_local").alias("side"), "name", "root"))


@query(_R + " SELECT name, root FROM latest WHERE name = 'partition/007'")
def named_root(spark, d):
    log = docs(spark, d).select(keys.partition_name(F.col("partition_id")).alias("name"), F.col("content_hash").alias("root"), F.col("seq").alias("version"))
    return sync.named_root(log, "partition/007")


@query(REC + "SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE status = 'pending')::BIGINT AS queue_depth FROM rec")
def health(spark, d):
    records = docs(spark, d)
    return sync.health(records, records.filter("status = 'pending'"))


@query("SELECT event_id AS seq FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def updated_since(spark, d):
    rows = fixtures.table(spark, d, "events")
    mark = rows.agg(F.min("ts")).first()[0]  # the stored watermark
    return sync.updated_since(rows, F.lit(mark + datetime.timedelta(days=1))).select(F.col("event_id").alias("seq"))


# -- sources, bulk load, streaming -------------------------------------------------------------------------------------


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/registry/{name}-{uuid.uuid4().hex[:12]}"


@query("""WITH l AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT n::BIGINT AS ordinal, event_id FROM l WHERE n > 100 AND n <= 600""")
def dump_skip_limit(spark, d):
    path = workspace(spark, "dump")
    fixtures.table(spark, d, "events").select("event_id").coalesce(1).sortWithinPartitions("event_id").select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")).alias("value")).write.option("compression", "gzip").text(path)
    return dump.lines(spark, path, 100, 500).select("ordinal", F.get_json_object("line", "$.id").cast("long").alias("event_id"))


@query(EV + ", k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev), q AS (SELECT user_id, event_type, seq FROM events JOIN ev ON event_id = seq) SELECT count(*)::BIGINT AS lines_read, 0::BIGINT AS new_records, 0::BIGINT AS duplicates, 0::BIGINT AS conflicts, count(*)::BIGINT AS invalid FROM ev")
def bulk_ingest_invalid(spark, d):
    path = workspace(spark, "dump")
    fixtures.submissions(spark, d).select(F.to_json(F.struct("key", F.col("value"))).alias("value")).write.text(path)
    return bulk.ingest(spark, path, ingested_at=F.timestamp_seconds(F.lit(0)))[2]


@query("""WITH s AS (SELECT 'f01551220' || sha256('ev-' || user_id::VARCHAR) AS key, event_id AS seq, '{"value":' || (event_id % 3)::VARCHAR || '}' AS v FROM events),
o AS (SELECT *, CASE WHEN first_value(seq) OVER w = seq THEN 'q' WHEN first_value(v) OVER w = v THEN 'd' ELSE 'c' END AS x FROM s WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT count(*)::BIGINT AS lines_read, count(*) FILTER (WHERE x = 'q')::BIGINT AS new_records, count(*) FILTER (WHERE x = 'd')::BIGINT AS duplicates, count(*) FILTER (WHERE x = 'c')::BIGINT AS conflicts, 0::BIGINT AS invalid FROM o""")
def bulk_ingest(spark, d):
    path = workspace(spark, "dump")
    rows = fixtures.table(spark, d, "events").orderBy("event_id").coalesce(1)
    rows.select(F.concat(F.lit('{"key":"'), fixtures.key_of("ev-", F.col("user_id")), F.lit('","value":{"value":'), (F.col("event_id") % 3).cast("string"), F.lit("}}")).alias("value")).write.text(path)
    return bulk.ingest(spark, path, ingested_at=F.timestamp_seconds(F.lit(0)))[2]


@query("SELECT range AS seq, 59 AS key_length, 'b' AS head, true AS valid FROM range(500)")
def generated_records(spark, d):
    return dump.generated(spark, 500).select("seq", F.length("key").alias("key_length"), F.left("key", F.lit(1)).alias("head"), keys.is_valid_key(F.col("key")).alias("valid"))


@query(REC + ", n AS " + DENIED + " SELECT DISTINCT key FROM n")
def denylist_scan(spark, d):
    path = workspace(spark, "denylist")
    denied = fixtures.denied(spark, d)
    denied.select(F.concat(F.lit("  "), "key", F.lit(" ")).alias("value")).unionByName(spark.sql("SELECT explode(array('# comment', '', '   ')) AS value")).write.text(path)
    return dump.denylist(spark, path)


_S = """WITH s AS (SELECT page_id AS seq, 'f01551220' || sha256('page-' || (page_id - (page_id % 5 = 4)::INT)::VARCHAR) AS key, '{"html":"' || sha256(coalesce(html, '')) || '","n":' || page_id::VARCHAR || '}' AS value FROM pages),
o AS (SELECT *, first_value(seq) OVER (PARTITION BY key ORDER BY seq) = seq AS own FROM s), n AS (SELECT DISTINCT 'f01551220' || sha256('page-' || doc_id::VARCHAR) AS key FROM labels WHERE toxic = 1)
"""
_P = _S + "SELECT o.key, " + p("o.key") + " AS partition_id, sha256(value) AS content_hash, CASE WHEN n.key IS NULL THEN 'published' ELSE 'denylisted' END AS status FROM o LEFT JOIN n ON o.key = n.key WHERE own"


def _submissions(spark, d):
    """Pages, every fifth under the key of the one before it; the value names the page's own content."""
    rows = fixtures.table(spark, d, "pages")
    denied = fixtures.table(spark, d, "labels").filter("toxic = 1").select(fixtures.key_of("page-", F.col("doc_id")).alias("key")).distinct()
    value = F.concat(F.lit('{"html":"'), F.sha2(F.coalesce("html", F.lit("")), 256), F.lit('","n":'), F.col("page_id").cast("string"), F.lit("}"))
    ident = F.col("page_id") - F.when(F.col("page_id") % 5 == 4, 1).otherwise(0)
    return rows.select(F.col("page_id").alias("seq"), fixtures.key_of("page-", ident).alias("key"), value.alias("value")), denied


@query(_P)
def publish_cycle(spark, d):
    rows, denied = _submissions(spark, d)
    registry, at = Registry(spark, workspace(spark, "registry")), F.timestamp_seconds(F.lit(fixtures.BASE_SECONDS))
    registry.submit(rows, 1, at)
    registry.publish(2, at, denied)
    return registry.records().select("key", "partition_id", "content_hash", "status")


@query(_P)
def publish_stream(spark, d):
    rows, denied = _submissions(spark, d)
    base, at = workspace(spark, "stream"), F.timestamp_seconds(F.lit(fixtures.BASE_SECONDS))
    rows.orderBy("seq").coalesce(1).write.json(f"{base}/landing")
    registry = Registry(spark, f"{base}/registry")
    publisher.run(registry, publisher.landed(spark, f"{base}/landing"), f"{base}/checkpoint", denied, drain=True, at=at).awaitTermination()
    return registry.records().select("key", "partition_id", "content_hash", "status")


@query(_S + """, src AS (SELECT o.key, sha256(value) AS content_hash, octet_length(encode(value))::BIGINT AS size, 1704067200000 AS created_ms FROM o ANTI JOIN n USING (key) WHERE own),
""" + nodes_sql("src", 2) + ROOTS)
def published_roots(spark, d):
    """Published in three cycles: the roots of the log are those of the trees."""
    rows, denied = _submissions(spark, d)
    registry, at = Registry(spark, workspace(spark, "registry"), limit=2), F.timestamp_seconds(F.lit(fixtures.BASE_SECONDS))
    most = rows.agg(F.max("seq")).first()[0] // 10 * 5  # an even cut: a key's two pages stay together
    registry.submit(rows.filter(F.col("seq") < most), 1, at)
    registry.publish(2, at, denied, most=20)
    registry.publish(3, at, denied)
    registry.submit(rows, 4, at)
    registry.publish(5, at, denied)
    return sync.latest_roots(registry.root_log()).select("name", "root")


@query(REC + "SELECT key, size FROM rec WHERE partition_id = 7 AND status = 'published'")
def spilled_partition(spark, d):
    path = workspace(spark, "spill")
    bulk.spilled(docs(spark, d), path)
    return spark.read.parquet(path).filter("partition_id = 7").select("key", "size")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents")
def blob_put(spark, d):
    own = docs(spark, d)
    rows = own.select(F.col("content_hash").alias("hash"), "size", "seq")
    return put(rows.filter("seq % 2 = 0"), rows).select("hash", "size")


@query("SELECT page_id % 10 AS batch, count(*) FILTER (WHERE octet_length(encode(coalesce(html, ''))) > 4000)::BIGINT AS errors, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def batch_errors(spark, d):
    return submit.batch_errors(_checked_pages(spark, d).withColumn("batch", F.col("seq") % 10))


@query(REC + "SELECT (max(created_s) * 1000)::BIGINT AS newest_ms, count(*)::BIGINT AS n FROM (SELECT * FROM rec ORDER BY key LIMIT 50 OFFSET 100)")
def page_newest(spark, d):
    return lookup.page(docs(spark, d), 100, 50).agg(F.unix_millis(F.max("created_at")).alias("newest_ms"), F.count("*").alias("n"))


@query(REC + "SELECT partition_id, count(*)::BIGINT AS n, min(key) AS first_key FROM rec WHERE status = 'published' GROUP BY partition_id")
def spilled_keys(spark, d):
    path = workspace(spark, "spill")
    bulk.spilled(docs(spark, d), path, ("key",))
    return spark.read.parquet(path).groupBy("partition_id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query(REC + "SELECT key, partition_id, CASE WHEN seq % 4 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, CASE WHEN seq % 4 = 0 THEN 'published' ELSE status END AS status FROM rec")
def bulk_overwritten(spark, d):
    own = docs(spark, d)
    incoming = own.filter("seq % 4 = 0").withColumn("content_hash", F.sha2("content_hash", 256))
    out = bulk.mark_published(own, incoming.unionByName(incoming.withColumns({"seq": F.col("seq") - 1, "content_hash": F.lit("old")})), F.current_timestamp())
    return out.select("key", "partition_id", "content_hash", "status")


_WAY = " ".join(f"LEFT JOIN n{i} ON n{i}.part = substr(h, 1, 2) AND n{i}.prefix = substr(h, 3, {2 * i})" for i in range(5))


@query(_N.replace("{}", "") + ", lost AS (SELECT DISTINCT part FROM (" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(5)) + """) WHERE x LIKE '0%')
SELECT key, content_hash, size, created_ms::BIGINT AS created_ms, substr(h, 1, 2) NOT IN (SELECT part FROM lost) AS complete FROM (SELECT *, sha256(key) AS h FROM src) """ + _WAY + " WHERE " + " AND ".join(f"coalesce(n{i}.x, '-') NOT LIKE '0%'" for i in range(5)))
def tree_scan_deadline(spark, d):
    """Nodes whose hash begins with 0 can't be read in time; they hide what is below them."""
    nodes = bulk.build(_entries(spark, d), 2)[0]
    entries, complete = tree.scanned(nodes, nodes.filter("node_hash NOT LIKE '0%'"))
    return entries.join(complete, "partition_id").select("key", "content_hash", "size", F.unix_millis("created_at").alias("created_ms"), "complete")


@query(EV + ", k AS (SELECT *, " + p("key") + """ AS partition_id FROM o WHERE outcome = 'queued'),
l AS (SELECT partition_id, sha256('L' || chr(10) || string_agg(key || chr(9) || content_hash || chr(9) || size || chr(9) || created_ms || chr(9) || '-', chr(10) ORDER BY key)) AS h FROM k GROUP BY partition_id)
SELECT partition_id, h NOT LIKE '0%' AS complete FROM l""")
def tree_completeness(spark, d):
    nodes = bulk.build(_entries(spark, d))[0]
    return sync.completeness(nodes, nodes.filter("node_hash NOT LIKE '0%'"))


@query(EV + ", k AS (SELECT *, " + p("key") + " AS partition_id FROM o WHERE outcome = 'queued') SELECT partition_id, key, content_hash FROM k")
def tree_scan(spark, d):
    rows = _entries(spark, d)
    return tree.leaf_of(rows, tree.shape(rows, 2)).select("partition_id", "key", "content_hash")


@query("SELECT r.i AS code, bit_count(r.i)::INT AS distance, (CASE WHEN r.i < 8 THEN 0 WHEN r.i < 16 THEN 1 WHEN r.i < 24 THEN 2 ELSE 3 END)::INT AS probe FROM range(32) r(i)")
def radius_probes(spark, d):
    probe = F.element_at(F.array(*[F.lit(codes.exact_probe(r, 8)) for r in range(32)]), (F.col("id") + 1).cast("int"))
    return spark.range(32).select(F.col("id").alias("code"), codes.distance(F.col("id"), F.lit(0).cast("long")).cast("int").alias("distance"), probe.alias("probe"))
