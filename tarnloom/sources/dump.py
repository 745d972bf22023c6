"""Text sources: NDJSON dumps (gzip by suffix), denylists, and a generator of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values

_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def lines(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(ordinal, line): the non-empty lines of a dump in order, from 1, after `skip` of them and `limit` at most.

    A line's ordinal is its place in its file block plus what the blocks before it hold; blocks are few, so no line moves.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = text.filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    blocks = sorted(tuple(r) for r in text.groupBy("file", "block").agg(F.min("at"), F.count("*")).collect())
    bases, total = [], 0
    for file, block, first, n in blocks:
        bases.append((file, block, total - first + 1))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "file string, block long, shift long"))
    out = text.join(base, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("ordinal"), F.col("value").alias("line"))
    out = out.filter(F.col("ordinal") > skip)
    return out if limit is None else out.filter(F.col("ordinal") <= skip + limit)


def parsed(numbered: DataFrame, line: str = "line") -> DataFrame:
    """numbered plus key, value (canonical) and error: bad_json (not an object with both fields), bad_value, or null."""
    v = values.variant(F.col(line))
    key = F.when(F.schema_of_variant(F.try_variant_get(v, "$.key", "variant")) == "STRING", F.try_variant_get(v, "$.key", "string"))
    raw = F.try_variant_get(v, "$.value", "variant")
    value = values.canonical(F.to_json(raw))
    error = F.when(key.isNull() | raw.isNull(), "bad_json").when(value.isNull(), "bad_value")
    return numbered.withColumns({"key": key, "value": value, "error": error})


def read_dump(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    return parsed(lines(spark, path, skip, limit)).withColumnRenamed("ordinal", "seq")


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """The keys of a denylist file: lines are trimmed, blanks and # comments dropped; a missing file is an empty list."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string")
    key = F.trim("value")
    return spark.read.text(path).select(key.alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#")).distinct()


def base32(hex_digits: Column, n_digits: int) -> Column:
    """Lower-case unpadded base32 of n_digits hex digits."""
    bits = F.array_join(F.transform(F.split(hex_digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    n = -(-n_digits * 4 // 5)
    padded = F.rpad(bits, n * 5, "0")
    letter = lambda i: F.substr(F.lit(_BASE32), F.conv(F.substr(padded, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), letter), "")


def cid(text: Column) -> Column:
    """The CIDv1 (base32, raw, SHA-256) of a text."""
    return F.concat(F.lit("b"), base32(F.concat(F.lit("01551220"), F.sha2(text, 256)), 72))


def generated(spark: SparkSession, n: int, prefix: str = "sandbox-record-", at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(seq, key, value): n deterministic records; their ISO timestamp is not an integer, so it is not read as declared."""
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    value = F.to_json(F.struct(F.lit("TESTTESTTESTTEST").alias("iscc"), F.concat(F.lit("https://example.org/"), name).alias("location"), F.col("id").alias("seq"), F.lit(at).alias("timestamp")))
    return spark.range(n).select(F.col("id").alias("seq"), cid(name).alias("key"), value.alias("value"))
