"""Tables in the folder that driver and executors share, for plans that loop or are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local master; any other raises, as its
    executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is unset: {master} needs a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="groundswell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system and path object, for any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cleared(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored; results that still read them are lost."""
    fs, at = file_system(spark, own_dir(spark))
    fs.delete(at, True)
