"""Counts of a registry: per partition, overall, estimates, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PARTITIONS


def per_partition(records: DataFrame) -> DataFrame:
    return records.groupBy("partition_id").agg(
        F.count("*").alias("records"), F.count("content_code").alias("with_code"), F.max("created_at").alias("latest_added_at"),
        F.coalesce(F.round(100.0 * F.count("content_code") / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("code_percent"),
    )


def summary(records: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """One row: totals, how many partitions hold records, average, largest and smallest partition, and the estimate.

    Ties: the largest is the last such partition, the smallest the first. The estimate is total over partitions read,
    rounded down, times all partitions.
    """
    each = per_partition(records)
    largest = F.struct("records", "partition_id")
    out = each.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total"), F.coalesce(F.sum("with_code"), F.lit(0)).alias("with_code"), F.count("*").alias("readable"), F.round(F.avg("records"), 4).alias("avg_records"),
        F.max(largest).alias("l"), F.min(F.struct("records", "partition_id")).alias("s"), F.max("latest_added_at").alias("latest_added_at"),
    )
    return out.select(
        "total", "with_code", "readable", (F.lit(partitions) - F.col("readable")).cast("long").alias("empty"), "avg_records", F.col("l.records").alias("max_records"), F.col("l.partition_id").alias("max_partition"), F.col("s.records").alias("min_records"), F.col("s.partition_id").alias("min_partition"),
        F.coalesce(F.round(100.0 * F.col("with_code") / F.nullif("total", F.lit(0)), 1), F.lit(0.0)).alias("code_percent"), F.coalesce(F.expr(f"(total div nullif(readable, 0)) * {partitions}"), F.lit(0)).cast("long").alias("estimate"),
        F.unix_millis("latest_added_at").alias("latest_added_ms"),
    )


def partition_classes(reads: DataFrame) -> DataFrame:
    """How many partitions were read whole, empty, in part, or not at all. reads: partition_id, records (null: unreadable), complete."""
    return reads.agg(
        F.count_if(F.col("records").isNotNull() & F.col("complete") & (F.col("records") > 0)).alias("readable"), F.count_if(F.col("complete") & (F.col("records") == 0)).alias("empty"),
        F.count_if(F.col("records").isNotNull() & ~F.col("complete")).alias("partial"), F.count_if(F.col("records").isNull()).alias("unreadable"),
    )


def by_status(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


def ingest_rate(samples: DataFrame, look_back_ms: int = 60_000, most: int = 20, least_ms: int = 3000, series: str = "series") -> DataFrame:
    """samples (series, at_ms, total) plus rate a second since the oldest of the last `most` samples within the look-back; 0
    within least_ms or without growth."""
    recent = Window.partitionBy(series).orderBy("at_ms").rowsBetween(1 - most, 0)
    kept = F.filter(F.collect_list(F.struct("at_ms", "total")).over(recent), lambda s: s["at_ms"] >= F.col("at_ms") - look_back_ms)
    out = samples.withColumn("oldest", F.get(kept, F.lit(0)))
    dt, dn = F.col("at_ms") - F.col("oldest.at_ms"), F.col("total") - F.col("oldest.total")
    return out.withColumn("rate", F.when((dt >= least_ms) & (dn > 0), dn * 1000.0 / dt).otherwise(0.0)).drop("oldest")


def keep_newest(files: DataFrame, keep: int, group: str | None = None) -> DataFrame:
    """files (name, ...) plus kept: whether it is one of the `keep` last by name (of its group)."""
    by = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    return files.withColumn("kept", F.row_number().over(by.orderBy(F.desc("name"))) <= keep)
