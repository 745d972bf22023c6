"""A similarity index as files: the band table, appended a version at a time and read by band, with a digest of every bucket.

Files are dealt out by band and sorted by the band's value, so that a search reads the row groups of its buckets. A member
(key, code) that is there already is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..operators import similar
from ..schema import BAND
from .dump import exists

_MEMBERS = T.StructType([*BAND.fields, T.StructField("version", T.LongType())])


class SimilarityIndex:
    """path: a folder that all executors share. bands: see plans.bands_for(); it can't change later."""

    def __init__(self, spark: SparkSession, path: str, bands: int = similar.BANDS):
        self.spark, self.path, self.bands = spark, path.rstrip("/"), bands
        codes.check_bands(bands)

    def members(self, version: int | None = None) -> DataFrame:
        """The band table (BAND) with the version that each row came in."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], _MEMBERS)
        rows = self.spark.read.schema(_MEMBERS).parquet(self.path).select(*_MEMBERS.names)
        return rows if version is None else rows.filter(F.col("version") <= version)

    def add(self, entries: DataFrame, version: int) -> None:
        """Append entries (key, content_code) as a version; what an earlier attempt at it has written is replaced."""
        new = entries.filter("content_code IS NOT NULL").select("key", "content_code").distinct()
        # any one band names all members
        known = self.members(version - 1).filter("band_index = 0").select("key", "content_code")
        rows = similar.bands(new.join(known, ["key", "content_code"], "left_anti"), self.bands)
        rows = rows.repartitionByRange("band_index", "band_value").sortWithinPartitions("band_index", "band_value")
        rows.write.mode("overwrite").partitionBy("band_index").parquet(f"{self.path}/version={version}")

    def search(self, queries: DataFrame, radius: int, probe: int | None = None) -> DataFrame:
        """similar.hamming_join() of queries (query_key, query_code) with the index: exact, unless a smaller probe is asked for."""
        table = self.members()
        entries = table.filter("band_index = 0").select("key", "content_code")
        return similar.hamming_join(queries, entries, similar.check_radius(radius), self.bands, probe, table)

    def segments(self) -> DataFrame:
        """(bucket, version, members, hash): a digest of what each version has added to each bucket, in the order of members."""
        line = F.concat_ws("\t", "key", codes.shown(F.col("content_code")))
        own = self.members().groupBy("band_index", "band_value", "version").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(line)).alias("x"))
        return own.select(codes.bucket_key(F.col("band_index"), F.col("band_value")).alias("bucket"), "version", "members", F.sha2(F.array_join("x", "\n"), 256).alias("hash"))

    def marks(self) -> DataFrame:
        """(hash): all that the index reaches: its segments, and of each bucket the list of them."""
        segments = self.segments()
        lists = segments.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("version", "hash"))).alias("x"))
        lists = lists.select(F.sha2(F.concat_ws("\n", "bucket", F.transform("x", lambda s: s["hash"])), 256).alias("hash"))
        return segments.select("hash").unionByName(lists).distinct()
