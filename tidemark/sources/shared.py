"""Tables in the folder that driver and executors share, to cut a plan that is used more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only a local session may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        if where.isDefined():
            return where.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/tidemark"
    spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, read back.

    The rows survive lost executors, and later reads see the same rows.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Removes all that this application has written so; results that still read from it are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
