"""Folders for tables that outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Where none is set, as in tests, one of our own if all of Spark runs in this process; on a
    cluster executors can't read each other's folders, so there it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return root or f"file://{tempfile.gettempdir()}/alphaspark-staged"


def work_folder(spark: SparkSession) -> str:
    """A new folder for work tables in the shared folder.  Results are lazy, so it stays until the driver's JVM ends."""
    folder = f"{checkpoint_root(spark)}/alphaspark-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
