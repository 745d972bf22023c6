"""The write path: validation, first write wins, the queue, and the counters.

A key's first write is found by an aggregation that combines before the shuffle and joined back, so a key that a third of
all rows repeat loads no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, keys, values
from ..lineage import cut
from ..schema import CONFLICT, DENYLISTED, DUPLICATE, MAX_BATCH, MAX_VALUE_BYTES, PENDING, PUBLISHED, QUEUED

#: Error codes and the HTTP status of each (fixed values).
STATUS = {"invalid_key": 400, "invalid_value": 400, "value_too_large": 413, "unauthorized": 401, "conflict": 409, "batch_too_large": 413, "internal": 500}


def reject_code(key: Column, value: Column, canonical: Column, max_bytes: int = MAX_VALUE_BYTES, full: bool = True) -> Column:
    """The first rule a submission breaks (key, then value, then size), or null."""
    return F.when(~F.coalesce(keys.is_valid_key(key, full), F.lit(False)), "invalid_key").when(canonical.isNull(), "invalid_value").when(F.octet_length(canonical) > max_bytes, "value_too_large")


def http_status(error: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[error]


def derive(submissions: DataFrame, ingested_at: Column | None = None, algorithm: str = "sha256", max_bytes: int = MAX_VALUE_BYTES) -> DataFrame:
    """Index records of (seq, key, value) rows, plus error: null where valid."""
    # in steps: Catalyst keeps projections apart whose columns are used more than once
    known = submissions.select("seq", "key", values.canonical(F.col("value")).alias("value")).withColumn("error", reject_code(F.col("key"), F.col("value"), F.col("value"), max_bytes))
    return known.withColumn("iscc", values.iscc_field(F.col("value"))).select(
        "seq", "key", "value", values.content_hash(F.col("value"), algorithm).alias("content_hash"), values.size(F.col("value")).alias("size"), keys.partition_id(F.col("key")).alias("partition_id"),
        F.lit(PENDING).alias("status"), values.created_at(F.col("value"), ingested_at).alias("created_at"), codes.decode(F.col("iscc")).alias("content_code"), F.lit(None).cast("timestamp").alias("published_at"), "error",
    )


def classify(batch: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """batch (seq, key, content_hash, ...) plus outcome and existing_hash (of the write that came first; null if queued).

    queued: the key is new; duplicate: same hash as the first write; conflict: another hash. The index comes before the
    batch, the batch's rows in the order of seq; equal seqs of a key go by hash.
    """
    firsts = batch.groupBy("key").agg(F.min(F.struct("seq", "content_hash")).alias("first"))
    if index is not None:
        firsts = firsts.join(index.select("key", F.col("content_hash").alias("indexed")), "key", "left")
    else:
        firsts = firsts.withColumn("indexed", F.lit(None).cast("string"))
    own = F.col("indexed").isNull() & (F.col("seq") == F.col("first.seq")) & (F.col("content_hash") == F.col("first.content_hash"))
    earlier = F.coalesce("indexed", "first.content_hash")
    outcome = F.when(own, QUEUED).when(F.col("content_hash") == earlier, DUPLICATE).otherwise(CONFLICT)
    return batch.join(firsts, "key").withColumns({"outcome": outcome, "existing_hash": F.when(~own, earlier)}).drop("first", "indexed").select(*batch.columns, "outcome", "existing_hash")


def first_writes(rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The rows that win: one a key."""
    return classify(rows, index).filter(F.col("outcome") == QUEUED).drop("outcome", "existing_hash")


def numbered(rows: DataFrame, by: list[str], name: str, first: int) -> DataFrame:
    """rows with numbers from `first` in the order of `by`, in two passes: each range of the order counts its own rows, and the
    ranges' sizes (a row each) are added up."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return ranged.join(F.broadcast(before), "part").withColumn(name, (own + F.col("before") + F.lit(first - 1)).cast("long")).drop("part", "before")


def enqueue(outcomes: DataFrame, next_seq: int = 0) -> DataFrame:
    """(queue_seq, key) of queued rows: numbers from next_seq in the order of arrival."""
    queued = outcomes.filter(F.col("outcome") == QUEUED).select("seq", "key")
    return numbered(queued, ["seq", "key"], "queue_seq", next_seq).select("queue_seq", "key")


def check_batch(n: int, most: int = MAX_BATCH) -> None:
    if n > most:
        raise ValueError(f"batch_too_large: {n} rows, {most} at most")


def counters(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(F.count("*").alias("lines_read"), n(QUEUED).alias("new_records"), n(DUPLICATE).alias("duplicates"), n(CONFLICT).alias("conflicts"))


def batch_errors(checked: DataFrame, batch: str = "batch", error: str = "error") -> DataFrame:
    """(batch, errors, n): how many of a request's rows were refused."""
    return checked.groupBy(batch).agg(F.count_if(F.col(error).isNotNull()).alias("errors"), F.count("*").alias("n"))


def pending_batch(queue: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """The oldest `most` queue rows that have a record; dangling rows are passed over and don't count."""
    return queue.select(F.col("seq").alias("queue_seq"), "key").join(records.drop("seq"), "key").orderBy("queue_seq").limit(most)


def split_denied(batch: DataFrame, denylist: DataFrame) -> DataFrame:
    """batch plus verdict: published or denylisted."""
    flagged = batch.join(denylist.select("key").distinct().withColumn("denied", F.lit(True)), "key", "left")
    return flagged.withColumn("verdict", F.when(F.col("denied"), DENYLISTED).otherwise(PUBLISHED)).drop("denied")


def finish(records: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """records with done's (key, verdict) as status; published_at is set for the published alone."""
    done = done.select("key", "verdict").dropDuplicates(["key"])
    out = records.join(done, "key", "left")
    return out.withColumns({"published_at": F.when(F.col("verdict") == PUBLISHED, at).otherwise(F.col("published_at")), "status": F.coalesce("verdict", "status")}).select(*records.columns)


def drain(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without done's keys, known to the index or not."""
    return queue.join(done.select("key").distinct(), "key", "left_anti").select(*queue.columns)


def requeue(keys_: DataFrame, records: DataFrame, next_seq: int) -> DataFrame:
    """(seq, key) for the keys that have a record, from next_seq, in the order of keys."""
    known = keys_.select("key").distinct().join(records.select("key"), "key", "left_semi")
    return numbered(known, ["key"], "seq", next_seq).select("seq", "key")


def update_created_at(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the changes' created_at, counters updated and missing). changes: key, created_at; the last of a key (by seq) counts."""
    last = changes.groupBy("key").agg(F.max_by("created_at", "seq").alias("changed_at"), F.count("*").alias("n"))
    out = records.join(last.drop("n"), "key", "left").withColumn("created_at", F.coalesce("changed_at", "created_at")).select(*records.columns)
    known = records.select("key", F.lit(True).alias("known"))
    counts = last.join(known, "key", "left").agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("updated"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return out, counts
