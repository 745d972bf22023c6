"""Audits and garbage: what the index expects against what the trees hold, and what nothing reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import submit


def expected(records: DataFrame, partition: int | None = None) -> DataFrame:
    rows = records.filter("status = 'published'")
    return (rows if partition is None else rows.filter(F.col("partition_id") == partition)).select("partition_id", "key")


def missing(expected_: DataFrame, in_tree: DataFrame) -> DataFrame:
    """Published keys that no tree holds."""
    return expected_.join(in_tree.select("partition_id", "key"), ["partition_id", "key"], "left_anti")


def foreign(expected_: DataFrame, in_tree: DataFrame) -> DataFrame:
    """Keys in a tree that the index doesn't expect there."""
    return in_tree.select("partition_id", "key").join(expected_, ["partition_id", "key"], "left_anti")


def report(expected_: DataFrame, in_tree: DataFrame, requeued: DataFrame | None = None) -> DataFrame:
    """One row of counters. Both sides are counted in one pass over a union that is combined before its shuffle."""
    both = expected_.select("partition_id", "key", F.lit(1).alias("e"), F.lit(0).alias("t")).unionByName(in_tree.select("partition_id", "key", F.lit(0).alias("e"), F.lit(1).alias("t")))
    each = both.groupBy("partition_id", "key").agg(F.max("e").alias("e"), F.max("t").alias("t"))
    out = each.agg(
        F.count_distinct("partition_id").alias("partitions"), F.count_if(F.col("e") == 1).alias("expected"), F.count_if(F.col("t") == 1).alias("in_tree"),
        F.count_if((F.col("e") == 1) & (F.col("t") == 0)).alias("missing"), F.count_if((F.col("e") == 0) & (F.col("t") == 1)).alias("foreign_keys"),
    )
    if requeued is None:
        out = out.withColumn("requeued", F.lit(0).cast("long"))
    else:
        out = out.crossJoin(requeued.agg(F.count("*").alias("requeued")))  # one row each
    return out.withColumn("failed", (F.col("missing") > 0) & (F.col("requeued") < F.col("missing")))


def fix(missing_: DataFrame, records: DataFrame, next_seq: int) -> DataFrame:
    """Queue rows for the missing keys that have a record."""
    return submit.requeue(missing_, records, next_seq)


def live(records: DataFrame, tree_marks: DataFrame, band_marks: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(hash): all that the index, the trees, the band tables and the published roots name."""
    out = records.select(F.col("content_hash").alias("hash")).unionByName(tree_marks.select("hash"))
    if band_marks is not None:
        out = out.unionByName(band_marks.select("hash"))
    if roots is not None:
        out = out.unionByName(roots.select(F.col("root").alias("hash")))
    return out.filter("hash IS NOT NULL").distinct()


def garbage(blobs: DataFrame, live_: DataFrame) -> DataFrame:
    return blobs.join(live_.select("hash"), "hash", "left_anti")


def collect_garbage(blobs: DataFrame, live_: DataFrame, snapshot: int | None, writing: bool) -> DataFrame:
    """garbage(), refused while a writer is at work or without a committed snapshot: a wrong live set would delete data."""
    if writing or snapshot is None:
        raise RuntimeError("garbage is collected on a committed snapshot with no writer at work")
    return garbage(blobs, live_)
