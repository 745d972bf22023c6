"""Search and joins by Hamming distance of content codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..lineage import cut
from ..schema import BAND

MAX_RADIUS, BANDS = 16, 8
#: The serving search's limits (fixed values): default and largest distance, default and largest number of rows.
SERVE_DISTANCE, SERVE_CAP, SERVE_LIMIT, SERVE_MOST = 8, 16, 50, 500


def check_radius(radius: int) -> int:
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"the radius is 0 to {MAX_RADIUS}")
    return radius


def bands(entries: DataFrame, n: int = BANDS) -> DataFrame:
    """The band table (BAND): a row for each band of each entry with a code."""
    rows = entries.filter(F.col("content_code").isNotNull()).select("key", "content_code", F.posexplode(codes.band_values(F.col("content_code"), n)).alias("band_index", "band_value"))
    return rows.select(*BAND.names)


def bucket_sizes(band_table: DataFrame) -> DataFrame:
    return band_table.groupBy("band_index", "band_value").agg(F.count("*").alias("members")).select(codes.bucket_key(F.col("band_index"), F.col("band_value")).alias("bucket"), "members")


def probes(queries: DataFrame, probe: int, n: int = BANDS) -> DataFrame:
    """The buckets that each query (query_key, query_code) looks into: each band with every mask of at most `probe` bits."""
    width = codes.check_bands(n)
    each = queries.select("query_key", "query_code", F.posexplode(codes.band_values(F.col("query_code"), n)).alias("band_index", "own"))
    return each.withColumn("mask", F.explode(_masks(width, probe))).select("query_key", "query_code", "band_index", F.col("own").bitwiseXOR(F.col("mask")).alias("band_value"))


def _masks(width: int, probe: int) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in codes.probe_masks(width, probe)])


#: Bands of at most so many bits have large buckets, which are compared in blocks; members of a block at most, comparisons of a
#: task, pairs that it returns and bytes of its blocks at about most, and comparisons and pairs at a time.
BLOCK_WIDTH, BLOCK, TASK_WORK, TASK_ROWS, TASK_BYTES, SLAB, FLUSH = 8, 4096, 1 << 26, 1 << 20, 32 << 20, 1 << 17, 1 << 16
#: A block of more members shows so many of them, or up to twice as many, to the count of tasks (the comparison takes all), and
#: blocks that meet are cut into parts of about so much of a task's pairs.
SHOWN, PARTS = 64, 4
#: Comparisons that are worth a task while cores have fewer than so many tasks each: at a wide radius every sixth is a row.
LEAST_WORK, CORE_TASKS = 1 << 22, 4


def hamming_join(queries: DataFrame, entries: DataFrame, radius: int, n: int = BANDS, probe: int | None = None, band_table: DataFrame | None = None) -> DataFrame:
    """(query_key, key, query_code, content_code, distance) for all pairs within the radius, found by shared bands.

    An equi-join on (band, value) with the distance as its residual. Each pair is reported by its lowest shared band alone,
    so nothing needs deduplicating after the join. probe None: the smallest that misses no pair; a smaller one is the
    approximate search. Buckets of narrow bands are joined as blocks of members, which are compared without a row a candidate;
    those of wide ones hold few members and are joined row by row. band_table: entries' bands where they are at hand, as in a
    stored index.
    """
    p = codes.exact_probe(radius, n) if probe is None else probe
    left = queries.filter(F.col("query_code").isNotNull()).select("query_key", "query_code")
    right = entries.filter(F.col("content_code").isNotNull()).select("key", "content_code")
    if codes.check_bands(n) <= BLOCK_WIDTH:
        return _block_join(left, bands(right, n) if band_table is None else band_table, radius, n, p)
    return _row_join(left, right, radius, n, p, band_table)


def _row_join(left: DataFrame, right: DataFrame, radius: int, n: int, p: int, band_table: DataFrame | None) -> DataFrame:
    """Equal codes meet once a distinct code: repeats are joined back afterwards."""
    width = codes.check_bands(n)
    q = probes(left.select(F.lit("").alias("query_key"), "query_code").distinct(), p, n).drop("query_key")
    if band_table is None:
        e = bands(right.select(F.lit("").alias("key"), "content_code").distinct(), n).drop("key")
    else:
        e = band_table.select("band_index", "band_value", "content_code").distinct()
    apart = codes.distance(F.col("query_code"), F.col("content_code"))
    # Catalyst takes the size of probes from the queries before they are multiplied, so it must not choose to broadcast them
    met = q.join(e.hint("merge"), ["band_index", "band_value"]).withColumn("distance", apart).filter(F.col("distance") <= radius)
    mask = (1 << width) - 1 if width < 64 else -1
    x = F.col("query_code").bitwiseXOR(F.col("content_code"))
    near = F.array(*[F.bit_count(F.shiftrightunsigned(x, 64 - width * (i + 1)).bitwiseAND(F.lit(mask))) <= p for i in range(n)])
    first = F.array_position(near, True) - 1
    pairs = met.filter(F.col("band_index") == first).select("query_code", "content_code", "distance")
    return pairs.join(left, "query_code").join(right, "content_code").select("query_key", "key", "query_code", "content_code", "distance")


def blocks(members: DataFrame) -> DataFrame:
    """(band_index, band_value, keys, codes): members (BAND) of a bucket, BLOCK at most in a block. A bucket of any size is
    dealt to several tasks by its keys."""
    schema = T.StructType([*BAND.fields[:2], T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("codes", T.ArrayType(T.LongType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band, value = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (value[1:] != value[:-1])
            new[::BLOCK] = True
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, len(band)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, b.column(i).cast(kind)) for i, kind in ((2, pa.string()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(band[at], pa.int32()), pa.array(value[at], pa.int64()), *lists], names=schema.names)

    rows = members.select(*BAND.names).repartitionByRange("band_index", "band_value", "key").sortWithinPartitions("band_index", "band_value")
    return rows.mapInArrow(pack, schema)


def _block_join(left: DataFrame, members: DataFrame, radius: int, n: int, p: int) -> DataFrame:
    """Blocks of queries meet blocks of entries in the buckets that they look into. Blocks that meet are dealt out evenly, so a
    large bucket's comparisons are shared; keys travel in the blocks, so pairs are joined with nothing afterwards. A pair costs far
    more than a comparison, and copies make every comparison a pair, so tasks are counted and blocks are cut by both: some members
    of the blocks that meet tell about how many pairs there are. That decides how the work is dealt out, and nothing else."""
    width = codes.check_bands(n)
    q = cut(blocks(bands(left.toDF("key", "content_code"), n))).toDF("band_index", "own", "query_keys", "query_codes")
    q = q.withColumn("mask", F.explode(_masks(width, p))).withColumn("band_value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")
    e = cut(blocks(members))

    low = [(64 - width * (i + 1), (1 << width) - 1) for i in range(n)]
    schema = T.StructType([T.StructField("query_key", T.StringType()), T.StructField("key", T.StringType()), T.StructField("query_code", T.LongType()), T.StructField("content_code", T.LongType()), T.StructField("distance", T.IntegerType())])

    def within(band: int, a: np.ndarray, b: np.ndarray, space: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        """Places in a and b, and distances, of pairs within the radius that no band before this one reports."""
        step = max(1, SLAB // len(b))
        found, size = [], 0
        for at in range(0, len(a), step):
            some = a[at : at + step, None]
            x, d, near = (s[: len(some) * len(b)] for s in space)
            np.bitwise_xor(some, b[None, :], out=x.reshape(-1, len(b)))
            hit = np.flatnonzero(np.less_equal(np.bitwise_count(x, out=d), radius, out=near))
            x = x[hit]
            for shift, mask in low[:band]:
                other = np.bitwise_count((x >> np.uint64(shift)) & np.uint64(mask)) > p
                hit, x = hit[other], x[other]
            if len(hit):
                i, j = np.divmod(hit, len(b))
                found.append((i + at, j, d[hit]))
                size += len(hit)
            if size >= FLUSH:
                yield tuple(map(np.concatenate, zip(*found)))
                found, size = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = tuple(np.empty(max(SLAB, BLOCK), kind) for kind in (np.uint64, np.uint8, bool))  # once a task, not once a slab
        for batch in batches:
            for r in range(batch.num_rows):
                band = batch.column(0)[r].as_py()
                a_keys, a, b_keys, b = (batch.column(i)[r].values for i in range(1, 5))
                for i, j, d in within(band, a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), space):
                    i, j = pa.array(i), pa.array(j)
                    yield pa.RecordBatch.from_arrays([a_keys.take(i), b_keys.take(j), a.take(i), b.take(j), pa.array(d.astype(np.int32))], names=schema.names)

    def shown(df: DataFrame, keys: str, members: str, as_: str) -> DataFrame:
        long = F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + 16 + F.coalesce(F.length(k), F.lit(0)))
        some = F.filter(members, lambda _, i: i % F.greatest(F.lit(1), F.floor(F.size(members) / SHOWN)) == 0)
        return df.select("band_index", "band_value", F.size(keys).cast("double").alias(as_), long.cast("double").alias(f"{as_}_bytes"), some.alias(f"{as_}_some"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = tuple(np.empty(max(SLAB, BLOCK), kind) for kind in (np.uint64, np.uint8, bool))
        for batch in batches:
            work, share = batch.column(2).to_numpy(), np.zeros(batch.num_rows)
            for r in range(batch.num_rows):
                a, b = (batch.column(i)[r].values.to_numpy().view(np.uint64) for i in (4, 5))
                share[r] = sum(len(d) for _, _, d in within(batch.column(0)[r].as_py(), a, b, space)) / (len(a) * len(b))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(share)], names=["band_index", "band_value", "work", "bytes", "share"])

    bucket = ["band_index", "band_value"]
    met = shown(q, "query_keys", "query_codes", "q").join(shown(e, "keys", "codes", "e").hint("merge"), bucket)
    met = met.select(*bucket, (F.col("q") * F.col("e")).alias("work"), (F.col("q_bytes") + F.col("e_bytes")).alias("bytes"), "q_some", "e_some")
    met = met.mapInArrow(measure, "band_index int, band_value long, work double, bytes double, share double")
    most = F.max(F.when(F.col("work") > TASK_ROWS / PARTS, F.col("share")).otherwise(0.0))  # fewer comparisons need no cut
    load = met.groupBy(*bucket).agg(F.sum("work"), F.sum("bytes"), F.sum(F.col("work") * F.col("share")), most).collect()  # BLOCK_WIDTH: 2,048 buckets at most
    work, size, pairs = (sum(r[i] for r in load) for i in (2, 3, 4))
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(work / TASK_WORK, pairs / TASK_ROWS, size / TASK_BYTES, min(work / LEAST_WORK, CORE_TASKS * cores))) + 1

    shares = left.sparkSession.createDataFrame([(r[0], r[1], r[5]) for r in load], "band_index int, band_value long, share double")
    both = q.join(e.hint("merge"), bucket).join(F.broadcast(shares), bucket)
    parts = F.ceil(F.size("query_keys").cast("double") * F.size("keys") * F.col("share") * PARTS / TASK_ROWS)
    both = both.withColumn("long", F.ceil(F.size("query_keys") / F.greatest(F.lit(1), parts)).cast("int"))
    both = both.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("query_keys"), F.col("long"))))
    both = both.select("band_index", F.slice("query_keys", F.col("at"), F.col("long")), F.slice("query_codes", F.col("at"), F.col("long")), "keys", "codes")
    return both.repartition(tasks).mapInArrow(compare, schema)


#: Queries that brute force broadcasts at most (some 100 bytes each).
MOST_QUERIES = 1 << 17


def brute_force(queries: DataFrame, entries: DataFrame, radius: int) -> DataFrame:
    """hamming_join() without bands: for one query, or few, against all entries. Queries are sent to the entries, so beyond
    MOST_QUERIES they are refused: hamming_join() has no such limit."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; use hamming_join()")
    queries = F.broadcast(queries)
    apart = codes.distance(F.col("query_code"), F.col("content_code"))
    return entries.filter(F.col("content_code").isNotNull()).select("key", "content_code").join(queries, apart <= radius).withColumn("distance", apart)


def verified(candidates: DataFrame, radius: int) -> DataFrame:
    """One row a key: the nearest of its codes within the radius (ties: the smaller code), ordered by distance and key."""
    best = candidates.filter(F.col("distance") <= radius).groupBy("key").agg(F.min(F.struct("distance", "content_code")).alias("b"))
    return best.select("key", F.col("b.content_code").alias("content_code"), F.col("b.distance").alias("distance")).orderBy("distance", "key")


def banded(entries: DataFrame, code: int, radius: int = MAX_RADIUS, probe: int = 0, n: int = BANDS) -> DataFrame:
    """The reader's search: approximate above radius n * (probe + 1) - 1."""
    query = entries.sparkSession.createDataFrame([("q", code)], "query_key string, query_code long")
    return verified(hamming_join(query, entries, check_radius(radius), n, probe), radius)


def exact(entries: DataFrame, code: int, max_distance: int = SERVE_DISTANCE, limit: int = SERVE_LIMIT) -> DataFrame:
    """The serving search: all entries are scanned, the nearest `limit` come back by distance, partition and key."""
    d, k = min(max(max_distance, 0), SERVE_CAP), min(max(limit, 1), SERVE_MOST)
    apart = codes.distance(F.col("content_code"), F.lit(code).cast("long"))
    rows = entries.select("partition_id", "key", "content_code", apart.alias("distance")).filter(F.col("distance") <= d)
    return rows.orderBy("distance", "partition_id", "key").limit(k)


def coverage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("scanned"), F.count("content_code").alias("with_content_code"))


def nearest_per_query(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy("distance", "key")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fetched(matches: DataFrame, records: DataFrame) -> DataFrame:
    """matches with the records of their keys; a match whose record is lost keeps its row."""
    return matches.join(records.drop("content_code", "distance"), "key", "left")
