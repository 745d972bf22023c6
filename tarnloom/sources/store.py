"""The registry as files: record changes, queue, values and roots, all append-only and versioned.

A version is written as values, then records, then tree nodes and roots; its row in `commits`, written last, makes it visible. Readers see
committed versions alone, so a batch that failed half-way leaves nothing behind, and one that is replayed writes the same.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from ..operators import lookup, submit, sync, tree
from ..schema import LEAF_LIMIT, MAX_BATCH, RECORD
from .dump import exists

_RECORDS = T.StructType([*[f for f in RECORD.fields if f.name != "value"], T.StructField("version", T.LongType())])
_BLOBS = T.StructType([T.StructField("hash", T.StringType()), T.StructField("value", T.StringType()), T.StructField("version", T.LongType())])
_ROOTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("root", T.StringType()), T.StructField("version", T.LongType())])
_NODES = T.StructType([T.StructField("partition_id", T.IntegerType()), T.StructField("depth", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("prefix", "kind", "node_hash", "bytes")], T.StructField("version", T.LongType())])
_COMMITS = T.StructType([T.StructField("version", T.LongType()), T.StructField("drained", T.LongType())])


class Registry:
    """path: a folder that all executors share.

    Records are range-partitioned and sorted by (partition_id, key), so that a lookup's constants skip row groups by their
    statistics. limit: entries of a tree's leaf. folders: also a folder for each partition id, which prunes whole files; for registries large enough that 256
    folders a version hold files of a good size.
    """

    def __init__(self, spark: SparkSession, path: str, folders: bool = False, limit: int = LEAF_LIMIT):
        self.spark, self.path, self.folders, self.limit = spark, path.rstrip("/"), folders, limit

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, version: int, partitions: bool = False) -> None:
        """A version's rows replace what an earlier attempt at the same version has written."""
        df = df.drop("version")
        if partitions:
            df = df.repartitionByRange("partition_id", "key").sortWithinPartitions("partition_id", "key")
        writer = df.write.mode("overwrite")
        (writer.partitionBy("partition_id") if partitions and self.folders else writer).parquet(f"{self.path}/{name}/version={version}")

    def committed(self) -> int | None:
        return self._read("commits", _COMMITS).agg(F.max("version")).first()[0]

    def _seen(self, name: str, schema: T.StructType, version: int | None) -> DataFrame:
        last = self.committed() if version is None else version
        return self._read(name, schema).filter(F.col("version") <= F.lit(-1 if last is None else last))

    def records(self, version: int | None = None) -> DataFrame:
        """Each key's newest row. Filters on partition_id and key reach the files."""
        return newest(self._seen("records", _RECORDS, version))

    def queue(self, version: int | None = None) -> DataFrame:
        return self.pending(version).select("seq", "key")

    def blobs(self, version: int | None = None) -> DataFrame:
        return self._seen("blobs", _BLOBS, version).select("hash", "value").dropDuplicates(["hash"])

    def root_log(self, version: int | None = None) -> DataFrame:
        return self._seen("roots", _ROOTS, version)

    def nodes(self, version: int | None = None, partitions: list[int] | None = None) -> DataFrame:
        """The newest node of each partition and prefix: the trees of what is published."""
        rows = self._seen("nodes", _NODES, version)
        rows = rows if partitions is None else rows.filter(F.col("partition_id").isin(partitions))
        last = rows.groupBy("partition_id", "prefix").agg(F.max_by(F.struct("depth", "kind", "node_hash", "bytes"), "version").alias("r"))
        return last.select("partition_id", "r.depth", "prefix", "r.kind", "r.node_hash", "r.bytes")

    def submit(self, submissions: DataFrame, version: int, ingested_at=None) -> DataFrame:
        """Validate and add (seq, key, value) rows as `version`; the outcomes, rejects included. Of the index only the batch's
        keys are joined, in the batch's partitions."""
        derived = cut(submit.derive(submissions, ingested_at))
        fine = derived.filter("error IS NULL")
        index = lookup.narrowed(self._seen("records", _RECORDS, version - 1), fine)
        valid = cut(submit.classify(fine, newest(index)))
        new = valid.filter(F.col("outcome") == "queued")
        self._write(new.select(F.col("content_hash").alias("hash"), "value").dropDuplicates(["hash"]), "blobs", version)
        self._write(new.select(*[f.name for f in _RECORDS.fields if f.name != "version"]), "records", version, True)
        self._commit(version)
        rejected = derived.filter("error IS NOT NULL").select("seq", "key", F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("existing_hash"), "error")
        return valid.select("seq", "key", "outcome", "existing_hash", "error").unionByName(rejected)

    def submit_one(self, seq: int, key: str, value: str, version: int, ingested_at=None) -> DataFrame:
        """submit() of one row."""
        return self.submit(self.spark.createDataFrame([(seq, key, value)], "seq long, key string, value string"), version, ingested_at)

    def submit_batch(self, submissions: DataFrame, version: int, ingested_at=None, most: int = MAX_BATCH) -> DataFrame:
        """submit() of a request's rows, refused beyond `most`."""
        submit.check_batch(submissions.limit(most + 1).count(), most)
        return self.submit(submissions, version, ingested_at)

    def pending(self, version: int | None = None) -> DataFrame:
        """Records that are still pending. Only versions since the last publish that left none are read."""
        drained = self._seen("commits", _COMMITS, version).agg(F.coalesce(F.max("drained"), F.lit(0))).first()[0]
        rows = self._seen("records", _RECORDS, version).filter(F.col("version") > drained)
        done = rows.filter("status <> 'pending'").select("partition_id", "key")
        return newest(rows.filter("status = 'pending'").join(done, ["partition_id", "key"], "left_anti"))

    def publish(self, version: int, at, denylist: DataFrame | None = None, most: int | None = None) -> int:
        """One publish cycle as `version`: the oldest pending rows become published or denylisted, the published ones are
        inserted into their partitions' trees, and the new roots are logged. How many rows were done."""
        pending = self.pending(version - 1)
        batch = pending if most is None else pending.orderBy("seq").limit(most)
        none = self.spark.createDataFrame([], "key string")
        done = cut(submit.split_denied(batch, none if denylist is None else denylist))
        after = submit.finish(done.drop("verdict"), done, at)
        self._write(after.select(*[f.name for f in _RECORDS.fields if f.name != "version"]), "records", version, True)
        published = done.filter("verdict = 'published'")
        touched = [r[0] for r in published.select("partition_id").distinct().collect()]  # PARTITIONS at most
        changed = cut(tree.insert(self.nodes(version - 1, touched), published, self.limit))
        self._write(changed, "nodes", version)
        self._write(tree.roots(changed), "roots", version)
        n = done.count()
        self._commit(version, version - 1 if most is None or n < most else None)
        return n

    def compact(self, version: int) -> None:
        """Write all records' newest rows as `version` and drop the rows of earlier versions, which reads then no longer pass.

        Asking for an earlier version's records is over after that.
        """
        old = [r.version for r in self._read("records", _RECORDS).select("version").distinct().collect()]  # a row a version
        self._write(cut(self.records()), "records", version, True)
        self._commit(version)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in old:
            if v < version:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/records/version={v}")
                at.getFileSystem(conf).delete(at, True)

    def _commit(self, version: int, drained: int | None = None) -> None:
        """drained: the version up to which nothing is pending any more."""
        self.spark.createDataFrame([(version, drained)], _COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")


def newest(rows: DataFrame) -> DataFrame:
    """Each key's newest row of several versions, as a record without its value."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("partition_id", "key", "version")]), "version").alias("r")
    newest_ = rows.groupBy("partition_id", "key").agg(last)
    return newest_.select("r.seq", "key", *[F.col(f"r.{f.name}") for f in RECORD.fields if f.name not in ("seq", "key", "value", "partition_id")], "partition_id")


def put(blobs: DataFrame, more: DataFrame) -> DataFrame:
    """blobs (hash, ...) and those of more whose hash is new: content-addressed, so that putting again changes nothing."""
    return blobs.unionByName(more.join(blobs.select("hash"), "hash", "left_anti")).dropDuplicates(["hash"])


def wait_for_root(log: Callable[[], DataFrame], name: str, seconds: float, pause: float = 0.2) -> str:
    """The root of a name, read again and again until it is there; TimeoutError after `seconds`."""
    end = time.monotonic() + seconds
    while not (rows := sync.named_root(log(), name).collect()):
        if time.monotonic() >= end:
            raise TimeoutError(f"no root of {name} within {seconds} s")
        time.sleep(pause)
    return rows[0].root


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Write df beside path, then rename it there: readers see the old state, for a moment none, or the new one, never a part."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path}.{mark}.new")
    at, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{mark}.new", f"{path}.{mark}.old"))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at):
        files.rename(at, old)
    if not files.rename(new, at):
        raise OSError(f"{path} can't be replaced")
    files.delete(old, True)
