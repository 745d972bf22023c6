"""Reads: one key, many keys, listings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, keys, values
from ..schema import PARTITIONS


def check_partition(partition: int, partitions: int = PARTITIONS) -> int:
    if not 0 <= partition < partitions:
        raise ValueError(f"partition {partition} is not in 0 to {partitions - 1}")
    return partition


def get(records: DataFrame, key: str, partitions: int = PARTITIONS) -> DataFrame:
    """A key's record, or no row. The partition is given beside the key, so that other partitions' files aren't opened."""
    return records.filter((F.col("partition_id") == keys.partition_of(key, partitions)) & (F.col("key") == key))


def found(records: DataFrame, key: str) -> DataFrame:
    """One row, always: key, found, and the record's columns (null, with status not_found, if there is none)."""
    one = records.sparkSession.createDataFrame([(key,)], "key string")
    out = one.join(get(records, key), "key", "left").withColumn("found", F.col("status").isNotNull())
    return out.withColumn("status", F.coalesce("status", F.lit("not_found")))


def get_many(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted (pos, key) with their records in the order of pos; a key without a record keeps its row, found = false."""
    have = records.select("key", *[c for c in records.columns if c not in (*wanted.columns, "key")], F.lit(True).alias("hit"))
    return wanted.join(have, "key", "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit").orderBy("pos")


def with_values(entries: DataFrame, blobs: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """entries plus value and value_error (set where the blob is missing)."""
    have = blobs.select(F.col("hash").alias(hash_col), F.col("value").alias("blob"), F.lit(True).alias("hit"))
    return entries.drop("value").join(have, hash_col, "left").withColumns({"value": F.col("blob"), "value_error": F.when(F.col("hit").isNull(), "content unavailable")}).drop("blob", "hit")


def page(records: DataFrame, offset: int = 0, limit: int = 50, partition: int | None = None) -> DataFrame:
    """Rows of one partition (or all) in key order; limit 0 gives none (the caller wants the count alone)."""
    rows = records if partition is None else records.filter(F.col("partition_id") == check_partition(partition))
    return rows.orderBy("key").offset(offset).limit(limit)


def page_count(printed: int, size: int) -> int:
    return -(-printed // max(1, size))


def pages(records: DataFrame, size: int) -> DataFrame:
    """(partition_id, records, pages): how many pages of `size` rows a listing of each partition has."""
    counts = records.groupBy("partition_id").agg(F.count("*").alias("records"))
    return counts.withColumn("pages", F.ceil(F.col("records") / max(1, size)).cast("long"))


def listing(records: DataFrame, partition: int | None = None, most: int | None = None) -> DataFrame:
    """(partition_id, key, code): in the order of partition and key, at most `most`; code as hex or a dash."""
    rows = records if partition is None else records.filter(F.col("partition_id") == check_partition(partition))
    out = rows.select("partition_id", "key", F.coalesce(codes.shown(F.col("content_code")), F.lit("-")).alias("code")).orderBy("partition_id", "key")
    return out if most is None else out.limit(most)


def tsv(rows: DataFrame, *more: str) -> DataFrame:
    """One tab-separated line a row."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("partition_id", "key", "code", *more)]).alias("line"))


def listing_with_iscc(records: DataFrame) -> DataFrame:
    return records.select("partition_id", "key", values.listed_iscc(F.col("value")).alias("iscc"))


#: Keys that are broadcast at most (64 bytes or so each).
MOST_KEYS = 1 << 17


def narrowed(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of index (partition_id, key, ...) whose keys are in batch (partition_id, key): the cost of a small batch
    is that of reading its partitions; nothing of the index is shuffled. Larger batches are joined by shuffle."""
    wanted = batch.select("partition_id", "key").distinct()
    parts = [r[0] for r in wanted.select("partition_id").distinct().collect()]  # PARTITIONS at most
    here = index.filter(F.col("partition_id").isin(parts))
    few = wanted.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return here.join(F.broadcast(wanted) if few else wanted, ["partition_id", "key"], "left_semi")


def json_rows(rows: DataFrame) -> DataFrame:
    """(line): each row as a JSON object, null fields left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("line"))


def warm(df: DataFrame) -> tuple[DataFrame, int]:
    """(df, kept in the executors' memory; its rows), for lists that are asked for again and again."""
    kept = df.cache()
    return kept, kept.count()


def cached_or(cached: DataFrame | None, cached_root: str | None, root: str | None, read) -> DataFrame:
    """A partition's listing from the cache while its root is the cached one, else by read()."""
    return cached if cached is not None and root is not None and cached_root == root else read()
