"""Versions of a table behind a pointer: how saved data is replaced as a whole.

A version is a folder of its own. The pointer is a small file whose name is a number and which holds the
version's; the largest number is current, and it is made only when its version is whole. Readers follow
it, so they see the old version or the new one and never a part. Old versions stay until they are
dropped. ``file_versions`` has versions that share files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def folder_at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_pointer(spark: SparkSession, path: str) -> str:
    """What a pointer file holds."""
    files, where = folder_at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def make_pointer(spark: SparkSession, path: str, target: str) -> None:
    """Make a pointer file that must not be there yet."""
    files, where = folder_at(spark, path)
    try:
        out = files.create(where, False)
    except Exception as error:
        if "already exist" in str(error):
            raise RuntimeError(f"{path} was written meanwhile") from error
        raise
    out.write(target.encode())
    out.close()


def pointer_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the pointers in a folder, ascending."""
    files, where = folder_at(spark, folder)
    if not files.exists(where):
        return []
    return sorted(int(n) for n in (s.getPath().getName() for s in files.listStatus(where)) if n.isdigit())


def current_path(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version; None before the first."""
    known = pointer_numbers(spark, f"{root}/_current")
    return f"{root}/{read_pointer(spark, f'{root}/_current/{known[-1]:012d}')}" if known else None


def write_snapshot(frame: DataFrame, root: str, *partition_by: str) -> str:
    """Save ``frame``, which may read the current version, as the next one and point to it; returns its folder."""
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    return publish(frame.sparkSession, root, writer.parquet)


def publish(spark: SparkSession, root: str, save: Callable[[str], object]) -> str:
    """Let ``save`` fill a new version's folder, then point to it; returns the folder.

    Of two writers that end at once one makes the next number's pointer; the other one fails and leaves
    the pointer as it is.
    """
    seen = pointer_numbers(spark, f"{root}/_current")
    version = f"version_{uuid.uuid4().hex}"
    save(f"{root}/{version}")
    number = seen[-1] + 1 if seen else 0
    make_pointer(spark, f"{root}/_current/{number:012d}", version)
    return f"{root}/{version}"


def read_snapshot(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The current version."""
    path = current_path(spark, root)
    if path is None:
        raise FileNotFoundError(f"no version at {root}")
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def drop_old_versions(spark: SparkSession, root: str) -> None:
    """Delete all versions but the current one, once nothing reads them any more."""
    for number in pointer_numbers(spark, f"{root}/_current")[:-1]:
        pointer = f"{root}/_current/{number:012d}"
        for path in (f"{root}/{read_pointer(spark, pointer)}", pointer):
            files, where = folder_at(spark, path)
            files.delete(where, True)
