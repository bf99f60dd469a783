"""Tables written to the folder that all executors share.

Reliable storage, not executor-local blocks: a lost executor costs a re-read, never the data.
The folder is the cluster's ``spark.checkpoint.dir``; only a local session without that setting uses
a folder under its warehouse.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Root of the scratch tables of this application."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under this application's part of the shared folder that no other table uses."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def named_path(spark: SparkSession, name: str) -> str:
    """A path under this application's part of the shared folder that is the same for the same name."""
    return f"{_application_folder(spark)}/{name}"


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/shiftlens/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no frame that reads them is needed any more.

    Stores and logs written to paths of your own are not touched.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a saved table: computed once, read back with column pruning, short lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a scratch file's address, and the path as it takes it, for Python tasks."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
