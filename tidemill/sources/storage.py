"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a local folder where it is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tidemill-shared")


def kept_path(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: computed once, and safe from lost executors."""
    path = kept_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Delete the intermediate tables of the shared folder that were written so many hours ago; returns their number.

    They may be read until the job that wrote them ends, so take more hours than any job runs.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(shared_dir(spark).rstrip("/"), "tidemill-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = (time.time() - hours * 3600) * 1000
    return sum(fs.delete(s.getPath(), True) for s in fs.globStatus(pattern) or [] if s.getModificationTime() <= before)
