"""The publisher and the watcher as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lineage import cut
from ..operators import sync, tree
from ..schema import PUBLISH_SECONDS, SUBMISSION, SYNC
from ..sources.dump import exists
from ..sources.store import Registry, replace_snapshot


def landed(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """Submissions (seq, key, value) that arrive as JSON files in a folder."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", most_files).json(path)


def run(registry: Registry, submissions: DataFrame, checkpoint: str, denylist: DataFrame | None = None, drain: bool = False, at=None, seconds: int = PUBLISH_SECONDS) -> StreamingQuery:
    """Submit and publish each micro-batch; drain: work off what is there and stop.

    A batch's versions follow from its number, so that a batch run again after a failure overwrites its own attempt and the
    registry holds each submission once.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        now = F.current_timestamp() if at is None else at
        if (registry.committed() or 0) >= 2 * number + 2:  # published before the stream noted it
            return
        registry.submit(batch, 2 * number + 1, now)
        registry.publish(2 * number + 2, now, denylist)

    writer = submissions.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{seconds} seconds")).start()


def root_changes(spark: SparkSession, registry_path: str) -> DataFrame:
    """The stream of root rows (name, root, version) as they are written: what a watcher sees."""
    return spark.readStream.schema("name string, root string, version long").option("recursiveFileLookup", "false").parquet(f"{registry_path}/roots")


def watch(spark: SparkSession, registry_path: str, checkpoint: str, target: str, drain: bool = True) -> StreamingQuery:
    """Collect root changes as Parquet under target."""
    writer = root_changes(spark, registry_path).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start(target)


def synced(spark: SparkSession, state: str) -> DataFrame:
    """The follower's state (SYNC); empty before its first pass."""
    return spark.read.schema(SYNC).parquet(state) if exists(spark, state) else spark.createDataFrame([], SYNC)


def sync_pass(registry: Registry, state: str, pass_number: int, at=None, readable: DataFrame | None = None) -> int:
    """Read the partitions that need it (see sync.work) and replace the state under `state`. How many were read.

    A partition of which not all nodes can be read keeps its old state and notes the error.
    """
    spark = registry.spark
    old = cut(synced(spark, state))
    todo = cut(sync.work(sync.partition_roots(registry.root_log()), old, pass_number=pass_number))
    parts = [r.partition_id for r in todo.collect()]  # PARTITIONS at most
    if not parts:
        return 0
    entries, complete = tree.scanned(registry.nodes(partitions=parts), readable)
    found = entries.groupBy("partition_id").agg(F.count("*").alias("records"), F.max("created_at").alias("latest_added_at"))
    now = F.current_timestamp() if at is None else at
    results = todo.join(complete, "partition_id", "left").join(found, "partition_id", "left").select(
        "partition_id", "root", F.coalesce("records", F.lit(0)).cast("long").alias("records"), now.alias("synced_at"), "latest_added_at",
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete").alias("error"),
    )
    replace_snapshot(cut(sync.refreshed(old, results).select(*SYNC.names)), state)
    return len(parts)


def follow(registry: Registry, checkpoint: str, state: str, drain: bool = True, seconds: int = 15, at=None) -> StreamingQuery:
    """Sync passes as roots change: a trigger's changes make one pass, every FULL_EVERY-th pass (the first among them) is full."""

    def one(batch: DataFrame, number: int) -> None:
        sync_pass(registry, state, number, at)

    writer = root_changes(registry.spark, registry.path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{seconds} seconds")).start()
