"""The folder that driver and executors share, and cutting a plan's lineage there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of this machine in local mode and the warehouse
    (shared by definition) on a cluster."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "file:///tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on; executors that are lost later don't matter."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
