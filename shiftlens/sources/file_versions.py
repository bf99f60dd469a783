"""A table as versions that share files: a delete rewrites only the files that hold deleted rows.

A version is a list of data files, kept as a small table of its own; its number is a pointer file
that is created and never overwritten, so of two writers that end at once one fails. An append adds files
to the list, a delete replaces those with hits by copies without them and keeps all others as they
are. Every version stays readable until it is dropped, and a reader sees a version or the next one, never
a part.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.plans.sizing import broadcast_if_small
from shiftlens.sources.snapshots import folder_at, make_pointer, pointer_numbers, read_pointer

_LIST = "path string, write string"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, oldest first."""
    return pointer_numbers(spark, f"{root}/_versions")


def files_of(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """The data files of a version (the newest if none is named), below ``root``."""
    return [r["path"] for r in _listed(spark, root, version).orderBy("path").collect()]


def _listed(spark: SparkSession, root: str, version: int | None) -> DataFrame:
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {'' if version is None else version} at {root}")
    named = read_pointer(spark, f"{root}/_versions/{known[-1] if version is None else version}")
    return spark.read.schema(_LIST).parquet(f"{root}/_lists/{named}")


def _write(frame: DataFrame, root: str, partition_by: tuple[str, ...]) -> tuple[str, list[str]]:
    """Save rows as new files, and list these."""
    spark, write = frame.sparkSession, uuid.uuid4().hex
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    writer.parquet(f"{root}/data/write={write}")
    files, where = folder_at(spark, f"{root}/data/write={write}")
    found, listing = [], files.listFiles(where, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getName().startswith("part-"):
            found.append(str(path).split(f"/data/write={write}/", 1)[1])
    return write, [f"data/write={write}/{p}" for p in found]


def _commit(spark: SparkSession, root: str, number: int, listed: DataFrame) -> int:
    """Save the list, then point to it by a file that must not be there yet."""
    name = uuid.uuid4().hex
    listed.coalesce(1).write.parquet(f"{root}/_lists/{name}")
    make_pointer(spark, f"{root}/_versions/{number}", name)
    return number


def _as_list(spark: SparkSession, write: str, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p, write) for p in paths], _LIST)


def append_version(frame: DataFrame, root: str, *partition_by: str) -> int:
    """Add the rows of ``frame``; the first call makes the table, with its partitions. Returns the new version's number."""
    spark, known = frame.sparkSession, versions(frame.sparkSession, root)
    write, paths = _write(frame, root, partition_by)
    listed = _as_list(spark, write, paths)
    if known:
        listed = _listed(spark, root, known[-1]).unionByName(listed)
    return _commit(spark, root, known[-1] + 1 if known else 0, listed)


def read_version(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """A version's rows; ``schema`` is that of the table, partition columns last."""
    return read_files(spark, root, schema, files_of(spark, root, version))


def read_files(spark: SparkSession, root: str, schema: str, paths: list[str]) -> DataFrame:
    """The rows of some data files of the table."""
    if not paths:
        return spark.createDataFrame([], schema)
    full = spark.read.schema(f"{schema}, write string").option("basePath", f"{root}/data").parquet(*[f"{root}/{p}" for p in paths])
    return full.drop("write")


def delete_rows(spark: SparkSession, root: str, schema: str, condition: Column, *partition_by: str) -> int:
    """A version without the rows for which ``condition`` holds; files without such rows are shared with the one before.

    Rows for which the condition is null stay. The condition is pushed into the scan that looks for the files, so
    a condition on partition columns opens only their folders. Returns the newest version's number,
    which is the old one if no row is hit.
    """
    known = versions(spark, root)
    paths = files_of(spark, root, known[-1] if known else None)
    hits = read_files(spark, root, schema, paths)
    touched = set()
    if paths:
        for row in hits.where(condition).select(F.col("_metadata.file_path").alias("f")).distinct().collect():  # files, not rows
            path = unquote(row["f"])  # a URI, while files are listed by their plain names
            touched.add(path[path.rfind("/data/write=") + 1 :])
        if not touched <= set(paths):
            raise RuntimeError(f"files of {root} that its version does not list: {sorted(touched - set(paths))[:3]}")
    if not touched:
        return known[-1]
    kept = read_files(spark, root, schema, sorted(touched)).where(~F.coalesce(condition, F.lit(False)))
    return replace_files(kept, root, sorted(touched), *partition_by)


def replace_files(frame: DataFrame, root: str, replaced: list[str], *partition_by: str) -> int:
    """A version with the rows of ``frame`` in place of the files ``replaced``; all other files are shared."""
    spark, known = frame.sparkSession, versions(frame.sparkSession, root)
    write, new = _write(frame, root, partition_by)
    gone = broadcast_if_small(spark.createDataFrame([(p,) for p in replaced], "path string"))
    old = _listed(spark, root, known[-1]).join(gone, "path", "left_anti")
    return _commit(spark, root, known[-1] + 1, old.unionByName(_as_list(spark, write, new)))


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Forget all but the ``keep`` newest versions, and delete the files that only the others have."""
    known = versions(spark, root)
    old, new = known[: len(known) - keep], known[len(known) - keep :]
    needed = {p for n in new for p in files_of(spark, root, n)}
    spare = {p for n in old for p in files_of(spark, root, n)} - needed
    for path in [f"_versions/{n}" for n in old] + sorted(spare):
        files, where = folder_at(spark, f"{root}/{path}")
        files.delete(where, True)
