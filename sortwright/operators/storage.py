"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master without one
    (tests) gets a temporary folder; on a cluster that would be each machine's own
    disk, so it is an error."""
    where = spark.conf.get(SHARED, None) or spark.conf.get("spark.sortwright.sharedDir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="sortwright-")
        spark.conf.set("spark.sortwright.sharedDir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for one table, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table: lineage ends there, so a lost executor costs the reread
    of its splits, and expressions that depend on partitions are fixed."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
