"""Adapters from the driver's tables to the registry's relations (RECORD, submissions, denylist, codes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, keys, values

BASE_SECONDS = 1_704_067_200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(prefix: str, ident: Column) -> Column:
    """A valid CIDv1: base16, raw, SHA-256 of prefix and id."""
    return F.concat(F.lit("f01551220"), F.sha2(F.concat(F.lit(prefix), ident.cast("string")), 256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECORD from documents: hash and size of the text, every tenth still pending."""
    text = F.coalesce("text", F.lit(""))
    at = F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id"))
    return with_partition(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("seq"), key_of("doc-", F.col("doc_id")).alias("key"), F.col("text").alias("value"), values.content_hash(text).alias("content_hash"), values.size(text).alias("size"),
            F.when(F.col("doc_id") % 10 == 0, "pending").otherwise("published").alias("status"), at.alias("created_at"), F.when(F.col("doc_id") % 7 != 0, codes.of_hex(F.substring(F.md5(text), 1, 16))).alias("content_code"),
            F.when(F.col("doc_id") % 10 != 0, at + F.expr("INTERVAL 30 SECONDS")).alias("published_at"),
        )
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("html", F.lit(""))
    return with_partition(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), key_of("page-", F.col("page_id")).alias("key"), F.col("url"), values.content_hash(text).alias("content_hash"), values.size(text).alias("size")))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a submission stream: keys repeat, with equal and with other values."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return with_partition(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), key.alias("key"), F.col("props").alias("value"), values.content_hash(F.col("props")).alias("content_hash"), values.size(F.col("props")).alias("size"), F.col("ts").cast("timestamp").alias("created_at")))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("key"), codes.of_signs(F.col("embedding")).alias("content_code"), "vec_id")


def denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(key_of("doc-", F.col("doc_id")).alias("key")).distinct()


def with_partition(df: DataFrame) -> DataFrame:
    return df.withColumn("partition_id", keys.partition_id(F.col("key")))
