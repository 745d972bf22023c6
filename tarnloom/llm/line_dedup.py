"""Line dedup: levelled sorted runs of line hashes.

A run holds, in buckets by hash and sorted in each, (h, n): a line key's 128-bit hash and the documents it was found in. Each
batch of documents is merge-anti-joined with the runs (keys that a run already proves frequent need no more counting) and
adds its own run at level 0. When a level holds `fanout` runs they are merged into one run of the next level. What a lookup
reads is therefore at most fanout runs a level, and each key is rewritten once a level.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, add_columns, fresh, new_path, remove, staged, utf8

RUN = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.LongType())])  # what a run holds
_STRIP = WS.encode()


def line_key(line: bytes) -> bytes:
    """A line without white space at both ends, A-Z lower-cased (bytes.lower knows ASCII only)."""
    return line.strip(_STRIP).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """The runs, as bucketed and sorted tables. min_docs: documents from which a key is frequent; fanout: runs of a level
    before it is compacted; buckets: of every run, one sorted file each.

    As all runs are bucketed by h alike, merging them and anti-joining a batch with them moves no row of a run: the plans are
    sort-merge joins over the runs' own buckets, and a batch is shuffled once.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, path: str | None = None, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or new_path(spark, "line-runs")
        self.name = f"line_runs_{uuid.uuid4().hex}"
        # a shuffle's own number, so that what a shuffle has dealt out by h is a bucket of the run as it is
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        table = f"{self.name}_{self.made}"
        df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/L{level}/run-{self.made:05d}").saveAsTable(table)
        self.made += 1
        self.levels[level].append(table)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def drop(self, *tables: str) -> None:
        """Forget runs and delete their files."""
        for t in tables:
            at = self.spark.sql(f"DESCRIBE FORMATTED {t}").filter("col_name = 'Location'").first().data_type
            self.spark.sql(f"DROP TABLE {t}")
            remove(self.spark, at)

    def close(self) -> None:
        self.drop(*self.runs())
        self.levels = [[]]

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h, n) as a run, without the keys that are known to be frequent; then compact full levels."""
        self._write(self.unknown(counts), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self.merged(old), level + 1)
                self.drop(*old)

    def unknown(self, counts: DataFrame) -> DataFrame:
        """counts without the keys that a run proves frequent: one merge anti-join a run."""
        for t in self.runs():
            known = self.spark.table(t).filter(F.col("n") >= self.min_docs).select("h")
            counts = counts.join(known.hint("merge"), "h", "left_anti")
        return counts

    def merged(self, tables: list[str]) -> DataFrame:
        """(h, n) of several runs: their merge. Two runs, as in a compaction of fanout 2, are merged bucket by bucket."""
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            more = self.spark.table(t).withColumnRenamed("n", "m").hint("merge")
            out = out.join(more, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def frequent(self) -> DataFrame:
        """The hashes of all keys found in min_docs documents or more."""
        return self.merged(self.runs()).filter(F.col("n") >= self.min_docs).select("h")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with frequent lines cut out of text_col, plus n_lines (before) and n_dropped.

    Lines are what \\n separates. A line's key is the line stripped of white space with A-Z lower-cased. Keys of min_chars
    code points or more that are found in min_docs rows or more lose all their lines. A null or empty text is one empty line
    (its text becomes ""). Repeated rows count as documents each. Ids only deal the rows out to batches: what a row loses
    depends on its text, and equal texts lose the same. An empty table gives an empty result. If docs has columns named
    n_lines or n_dropped, the added ones replace them.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")

    def hashes(batch: pa.RecordBatch) -> list:
        out = []
        for text in utf8(batch.column("t")):
            keys = {line_key(x) for x in text.split(b"\n")}
            out.append([key_hash(k) for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)])
        return [out]

    batch = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(batches)).cast("int")
    source = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), batch.alias("batch"), F.col(text_col).alias("t"))
    each = add_columns(source, [T.StructField("hs", T.ArrayType(T.BinaryType()))], hashes, drop=("t",)).select("batch", "text_hash", F.explode("hs").alias("h"))
    paths: list[str] = []
    keys = staged(each, "line-keys", "batch", into=paths)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).groupBy("h").agg(F.count("*").alias("n")))
    frequent = staged(runs.frequent(), "frequent-lines", into=paths)
    runs.close()
    # keyed by the text's hash, so that copies are one: if two texts shared a hash, each would only hear of frequent lines it hasn't
    hit, row = fresh(docs, "hits"), fresh(docs, "text_hash")
    hits = keys.join(frequent, "h", "left_semi").groupBy("text_hash").agg(F.collect_set("h").alias(hit)).withColumnRenamed("text_hash", row)
    hits = staged(hits, "text-hits")
    remove(spark, *paths)
    # a merge join at any size: texts are shuffled once, in proportion to the input, and few hits are not sent to every executor
    joined = docs.withColumn(row, F.xxhash64(F.col(text_col))).join(hits.hint("merge"), row, "left").drop(row)
    made = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(fresh(docs, "kept"), T.StringType())]

    def cut(batch: pa.RecordBatch) -> list:
        n, dropped, kept = [], [], []
        for text, known in zip(utf8(batch.column(text_col)), batch.column(hit).to_pylist(), strict=True):
            lines = text.split(b"\n")
            n.append(len(lines))
            if known:
                known = set(known)
                rest = [x for x in lines if key_hash(line_key(x)) not in known]
            else:
                rest = lines
            dropped.append(len(lines) - len(rest))
            kept.append(b"\n".join(rest))
        return [n, dropped, pa.array(kept, pa.binary()).cast(pa.string())]

    out = add_columns(joined, made, cut, drop=(hit, text_col))
    return out.select(*[F.col(made[2].name).alias(text_col) if c == text_col else F.col(c) for c in docs.columns], "n_lines", "n_dropped")
