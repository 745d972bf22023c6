"""Bulk load: dumps to records, records to trees, timestamps from a dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..lineage import cut
from ..schema import LEAF_LIMIT, PUBLISHED, QUEUED
from ..sources import dump
from . import submit, tree


def ingest(spark: SparkSession, path: str, index: DataFrame | None = None, skip: int = 0, limit: int | None = None, ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejects, counters) of a dump: new records are published at once, the first write of a key wins."""
    lines = dump.read_dump(spark, path, skip, limit)
    derived = submit.derive(lines.select("seq", "key", "value"), ingested_at)
    bad = lines.select("seq", F.col("error").alias("line_error"))
    checked = derived.join(bad, "seq").withColumn("error", F.coalesce("line_error", "error")).drop("line_error")
    rejects = checked.filter("error IS NOT NULL").select("seq", "key", "error")
    outcomes = submit.classify(checked.filter("error IS NULL").drop("error"), index)
    when = F.current_timestamp() if ingested_at is None else ingested_at
    new = outcomes.filter(F.col("outcome") == QUEUED).drop("outcome", "existing_hash").withColumns({"status": F.lit(PUBLISHED), "published_at": when})
    counts = submit.counters(outcomes).drop("lines_read").crossJoin(rejects.agg(F.count("*").alias("invalid"))).crossJoin(lines.agg(F.count("*").alias("lines_read")))
    return new, rejects, counts.select("lines_read", "new_records", "duplicates", "conflicts", "invalid")


def spilled(records: DataFrame, path: str, columns: tuple[str, ...] = ("key", "content_hash", "size", "created_at", "content_code")) -> None:
    """Published entries, a folder for each partition; rows are brought together by partition first, so that folders get few files."""
    rows = records.filter((F.col("status") == PUBLISHED) & (F.col("partition_id") < 256)).select("partition_id", *columns)
    rows.repartition("partition_id").sortWithinPartitions("partition_id", "key").write.partitionBy("partition_id").parquet(path)


def build(entries: DataFrame, limit: int = LEAF_LIMIT, denylist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of all partitions at once; the first entry of a key (by created_at, then hash) counts, denylisted keys
    don't."""
    first = cut(tree.firsts(tree.without(entries, denylist)))  # every level reads it
    nodes = tree.hashes(first, tree.shape(first, limit))
    return nodes, tree.roots(nodes)


def build_spilled(spark: SparkSession, path: str, limit: int = LEAF_LIMIT, denylist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """build() of what spilled() has written."""
    return build(spark.read.parquet(path), limit, denylist)


def mark_published(records: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """records with incoming ones as published, overwriting those of equal key; of equal incoming keys the last (by seq) counts."""
    rows = F.struct(*[F.col(c) for c in incoming.columns if c != "key"])
    last = incoming.groupBy("key").agg(F.max_by(rows, F.struct("seq", "content_hash")).alias("r")).select("key", "r.*")
    last = last.withColumns({"status": F.lit(PUBLISHED), "published_at": at}).select(*records.columns)
    return records.join(last.select("key"), "key", "left_anti").select(*records.columns).unionByName(last)


def retimestamp(records: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, counters): created_at from the dump's declared timestamps. Lines that can't be read count as lines alone."""
    declared = values.declared_at(F.col("value"))
    rows = lines.filter("error IS NULL").select("seq", "key", declared.alias("created_at"))
    out, counts = submit.update_created_at(records, rows.filter("created_at IS NOT NULL"))
    more = rows.agg(F.count_if(F.col("created_at").isNull()).alias("no_timestamp"))
    return out, lines.agg(F.count("*").alias("lines")).crossJoin(counts).crossJoin(more)


def rebuilt(spark: SparkSession, records: DataFrame, lines: DataFrame, path: str, limit: int = LEAF_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, roots, counters) after a retimestamp: published entries are spilled again to path and the trees built from there."""
    out, counts = retimestamp(records, lines)
    spilled(out, path)
    return out, build_spilled(spark, path, limit)[1], counts
