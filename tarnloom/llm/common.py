"""What the operators share: staged tables in the shared folder, and Arrow maps that keep a row's other columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import shared_dir

#: The characters that contracts call white space.
WS = " \t\n\x0b\x0c\r"


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tarnloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder. What this application leaves there goes when its driver ends; sweep() deletes
    it earlier."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        files.mkdirs(top)
    files.deleteOnExit(top)
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has staged: for long sessions, once results have been written."""
    remove(spark, own_folder(spark))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders, through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str, *partition_by: str, into: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and return it as read from there.

    This cuts the lineage and survives lost executors. into: collects the path, for remove().
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns in drop, plus the columns that fn computes for each Arrow batch.

    fn gets a whole batch and returns, for each field, a list or Arrow array as long as the batch.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + fields)
    kinds = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(fn(batch), kinds, strict=True)]
            cols = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, *made], names=[f.name for f in schema.fields])
            del batch, made, cols
        pa.default_memory_pool().release_unused()  # workers are reused, and what they hold counts against their executor

    return df.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types that operators return."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.ByteType: pa.int8(),
    }[type(kind)]


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows with about `most` bytes at most; a longer row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores in front as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hex64(c: Column) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
