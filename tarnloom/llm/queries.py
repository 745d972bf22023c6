"""The registered queries of this package: thin, with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, line_dedup, lm_score, packing, simhash, suffix_dedup, warc
from .common import hex64, new_path, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), window=2048, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return hits.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_captures(table(spark, sf_dir, "pages"), path, least=100)
    records = warc.read_records(spark, path)
    # the digests are taken of what was read; a revisit's are those that its headers state
    full = F.col("type") != "revisit"
    stated = F.regexp_extract("http_header", r"(?i)content-length: *(\d+)", 1).cast("long")
    records = records.select(
        "record_id", "type", "concurrent_to", "refers_to",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(stated).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("digest"),
        F.when(F.col("type") == "metadata", F.col("payload").cast("string")).alias("fields"),
    )
    records = staged(records, "records")
    source = F.regexp_extract(F.get("metadata", F.lit(0))["fields"], r"(?m)^source-id: (-?\d+)", 1)
    captures = warc.assemble(records).select(
        "capture_id", F.when(source != "", source.cast("long")).alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"), F.col("answer.digest").alias("payload_digest"),
        F.col("answer.type").alias("record_type"), F.col("answer.refers_to").alias("target"),
    )
    captures = warc.resolved(staged(captures, "captures"), F.col("target"), F.col("page_id"), "refers_to")
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), good, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "loss_target", "loss_background", "lm_score")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, explode(array(0L, 1L)) AS turn").select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.conversations(chat.as_replies(rows), top=1)
    turns = chat.parsed(F.col("formatted"))
    out = out.select(F.col("tree.conv").alias("conv_id"), "formatted", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(langid.fold(F.col("doc_id")) != 0).select("text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (langid.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0, k=20)


QUERIES = {f.__name__: f for f in (op1_warc, op2_line_dedup, op3_suffix_dedup, op4_lm_scoring, op5_chat, op6_packing, op7_simhash, op8_decontamination, op9_language_id, op10_nearest_neighbours)}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 99)) AS m FROM p WHERE i + 99 <= octet_length(b)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
c AS (SELECT p.doc_id, p.i, hex(array_slice(b, p.i, p.i)) AS b,
             coalesce(p.i - max(later.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) < 100, false) AS gone
      FROM p LEFT JOIN later ON p.doc_id = later.doc_id AND p.i = later.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
s AS (SELECT doc_id, count(*)::BIGINT AS n_bytes, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, count(*) FILTER (WHERE head)::BIGINT AS n_spans,
             sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)""",
    "op8_decontamination": r"""
WITH lo AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS v),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, v), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lo),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, v), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lo),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, chr(92), chr(92) || 'b'), '### ', chr(92) || 'h## '), '</turn>', chr(92) || 's/turn>') AS x,
             replace(replace(replace(replace(role, chr(92), chr(92) || 'b'), '### ', chr(92) || 'h## '), '</turn>', chr(92) || 's/turn>'), ': ', chr(92) || 'c ') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(x) + length(r) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
