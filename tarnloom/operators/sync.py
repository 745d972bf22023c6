"""Roots, replicas and their state: which partitions are behind, what to sync, what to heal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, values
from ..schema import PARTITIONS

FULL_EVERY = 120


def latest_roots(log: DataFrame) -> DataFrame:
    """(name, root, version): the newest row of each name."""
    newest = log.groupBy("name").agg(F.max_by(F.struct("root", "version"), "version").alias("r"))
    return newest.select("name", "r.root", "r.version")


def partition_roots(log: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """(partition_id, root): names that aren't partitions, and null roots, are left out."""
    return latest_roots(log).select(keys.named_partition(F.col("name"), partitions).alias("partition_id"), "root").filter("partition_id IS NOT NULL AND root IS NOT NULL")


def named_root(log: DataFrame, name: str) -> DataFrame:
    """The root of a name: no row if there is none; an error if it is there but isn't a hash of 64 hex digits."""
    bad = F.raise_error(F.format_string("root of %s is not a hash", F.col("name")))
    return latest_roots(log).filter(F.col("name") == name).select("name", F.when(F.coalesce(F.col("root").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.col("root")).otherwise(bad).alias("root"))


def set_root(log: DataFrame, name: str, root: str, nodes: DataFrame, version: int) -> DataFrame:
    """A row for the log; refused if root isn't a node that can be read."""
    if not nodes.filter((F.col("node_hash") == root) & F.col("bytes").rlike("^[LI]\n")).limit(1).count():
        raise ValueError(f"{root} is missing or not a node")
    return log.sparkSession.createDataFrame([(name, root, version)], "name string, root string, version long")


def behind(roots: DataFrame, synced: DataFrame) -> DataFrame:
    """Partitions whose root differs from the synced one, or that were never synced."""
    have = synced.select("partition_id", F.col("root").alias("synced_root"))
    return roots.join(have, "partition_id", "left").filter(~F.col("root").eqNullSafe(F.col("synced_root"))).select("partition_id", "root", "synced_root")


def never_synced(roots: DataFrame, synced: DataFrame) -> DataFrame:
    return roots.join(synced.select("partition_id"), "partition_id", "left_anti").select("partition_id")


def work(roots: DataFrame, synced: DataFrame, requested: DataFrame | None = None, auto: bool = True, pass_number: int = 0) -> DataFrame:
    """Partitions to sync: those requested; with auto those changed, stale or unknown, and on every 120th pass all."""
    have = synced.select("partition_id", F.col("root").alias("synced_root"), F.col("stale_error").isNotNull().alias("stale"))
    out = roots.join(have, "partition_id", "left")
    asked = F.lit(False)
    if requested is not None:
        out = out.join(requested.select("partition_id", F.lit(True).alias("asked")).distinct(), "partition_id", "left")
        asked = F.coalesce("asked", F.lit(False))
    full = F.lit(pass_number % FULL_EVERY == 0)
    need = full | ~F.col("root").eqNullSafe(F.col("synced_root")) | F.coalesce("stale", F.lit(False))
    return out.filter(asked | (F.lit(auto) & need)).select("partition_id", "root")


def refreshed(synced: DataFrame, results: DataFrame) -> DataFrame:
    """The state after a pass: complete results replace a partition's, others keep the old and note the error.

    results: partition_id, root, records, synced_at, latest_added_at, error (null: complete).
    """
    new = results.select("partition_id", *[F.col(c).alias(f"new_{c}") for c in ("root", "records", "synced_at", "latest_added_at")], F.col("error"), F.lit(True).alias("tried"))
    out = synced.join(new, "partition_id", "full")
    good = F.coalesce("tried", F.lit(False)) & F.col("error").isNull()
    take = {c: F.when(good, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("root", "records", "synced_at", "latest_added_at")}
    return out.select("partition_id", *[v.alias(k) for k, v in take.items()], F.when(good, None).otherwise(F.coalesce("error", "stale_error")).alias("stale_error"))


def overview(roots: DataFrame, synced: DataFrame) -> DataFrame:
    """A row a partition: records, latest, state (current, behind, pending)."""
    have = synced.select("partition_id", F.col("root").alias("synced_root"), "records", "latest_added_at")
    state = F.when(F.col("synced_root").isNull(), "pending").when(F.col("root") == F.col("synced_root"), "current").otherwise("behind")
    return roots.join(have, "partition_id", "left").select("partition_id", state.alias("state"), F.coalesce("records", F.lit(0)).alias("records"), values.rfc3339(F.col("latest_added_at")).alias("latest_added_at"))


def status(roots: DataFrame, synced: DataFrame) -> DataFrame:
    """One row: roots known, partitions behind, records, the newest entry."""
    have = synced.select("partition_id", F.col("root").alias("synced_root"), "records", "latest_added_at")
    off = ~F.col("root").eqNullSafe(F.col("synced_root"))
    return roots.join(have, "partition_id", "left").agg(F.count("*").alias("roots_known"), F.count_if(off).alias("behind"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.unix_millis(F.max("latest_added_at")).alias("latest_added_ms"))


def health(records: DataFrame | None, queue: DataFrame | None) -> DataFrame:
    """(records, queue_depth); zeros without an index. Each side is one row."""
    if records is None or queue is None:
        from pyspark.sql import SparkSession

        return SparkSession.active().sql("SELECT 0L AS records, 0L AS queue_depth")
    return records.agg(F.count("*").alias("records")).crossJoin(queue.agg(F.count("*").alias("queue_depth")))


def restored(current: DataFrame, last_known: DataFrame) -> DataFrame:
    """(partition_id, root, fallback): the current root, and the last known one to try next if it is another."""
    known = last_known.select("partition_id", F.col("root").alias("known"))
    out = current.select("partition_id", "root").join(known, "partition_id", "full")
    return out.select("partition_id", F.coalesce("root", "known").alias("root"), F.when(F.col("root") != F.col("known"), F.col("known")).alias("fallback"))


def seeded(document: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to copy (to the document, to the local mirror): each side's missing names. What is readable is never replaced."""
    to_document = local.join(document.filter("root IS NOT NULL").select("name"), "name", "left_anti")
    to_local = document.filter("root IS NOT NULL").join(local.select("name"), "name", "left_anti")
    return to_document.select("name", "root"), to_local.select("name", "root")


def completeness(expected_nodes: DataFrame, readable: DataFrame) -> DataFrame:
    """(partition_id, complete): whether every node that a partition should have can be read."""
    lost = expected_nodes.join(readable.select("node_hash").distinct().withColumn("ok", F.lit(True)), "node_hash", "left")
    return lost.groupBy("partition_id").agg(F.every(F.col("ok").isNotNull()).alias("complete"))


def cache_size(spark, path: str) -> DataFrame:
    """(files, bytes) under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def due(depth: int, seconds: float, most: int = 1000, interval: float = 30) -> bool:
    """Whether the publisher's next cycle is due."""
    return depth >= most or (depth > 0 and seconds >= interval)


def updated_since(uploads: DataFrame, watermark: Column, at: str = "ts") -> DataFrame:
    return uploads.filter(F.col(at) > watermark)
