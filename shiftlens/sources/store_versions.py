"""The embedding store laid out by table and hash prefix, in versions that share files.

New rows are appended to a table's folder ``hash=new``. When many small files have come together they are
dealt to folders by the first digits of their content hash, as many digits as their number asks for; a
compaction rewrites the new files only, and those that are there already stay as they are. A look-up knows
from the hashes that it asks for which folders can hold them, and opens these files alone, of which it
reads the key columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small
from shiftlens.sources import file_versions
from shiftlens.sources.store import STORE_COLUMNS, STORE_SCHEMA, missing_chunks, present_rows, store_rows

#: Rows of a folder that a compaction fills, hash digits of a folder's name at most, and new files that call for one.
FOLDER_ROWS = 100_000
MAX_DIGITS = 4
NEW_FILES = 64

_SCHEMA = f"{STORE_SCHEMA}, hash string"
_FOLDERS = ("table_name", "hash")


def _label(digits: int) -> Column:
    return F.concat(F.lit("p"), F.substring("content_hash", 1, digits)) if digits else F.lit("p")


def _folder(path: str, column: str) -> str:
    """The value of a partition column in a file's path; names with special signs are escaped there."""
    from urllib.parse import unquote

    return unquote(path.split(f"/{column}=", 1)[1].split("/", 1)[0])


def files_for(spark: SparkSession, root: str, tables: Iterable[str], prefixes: Iterable[str]) -> list[str]:
    """The files that can hold contents of these tables whose hashes begin with one of ``prefixes`` (of ``MAX_DIGITS`` digits)."""
    wanted = {"new"} | {f"p{p[:n]}" for p in prefixes for n in range(MAX_DIGITS + 1)}
    named = set(tables)
    return [f for f in file_versions.files_of(spark, root) if _folder(f, "hash") in wanted and _folder(f, "table_name") in named]


def read_store_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of a version, the newest if none is named."""
    return file_versions.read_version(spark, root, _SCHEMA, version).select(*STORE_COLUMNS)


def _candidates(chunks: DataFrame, root: str) -> DataFrame:
    """The stored rows in the folders that can hold the contents of ``chunks`` (a saved frame)."""
    spark = chunks.sparkSession
    if not file_versions.versions(spark, root):
        return spark.createDataFrame([], STORE_SCHEMA)
    keys = chunks.select("table_name", F.substring("content_hash", 1, MAX_DIGITS).alias("prefix"))
    tables = [r[0] for r in keys.select("table_name").distinct().collect()]  # tables, and 16 ** MAX_DIGITS prefixes
    prefixes = [r[0] for r in keys.select("prefix").distinct().collect()]
    return file_versions.read_files(spark, root, _SCHEMA, files_for(spark, root, tables, prefixes)).select(*STORE_COLUMNS)


def held_contents(chunks: DataFrame, root: str) -> DataFrame:
    """The keys ``table_name, content_hash`` of stored rows that can be those of ``chunks``; nothing else of the rows is read."""
    return _candidates(chunks, root).select("table_name", "content_hash")


def append_rows(rows: DataFrame, root: str) -> int:
    """Append rows in the store's layout; returns the version's number."""
    return file_versions.append_version(rows.select(*STORE_COLUMNS, F.lit("new").alias("hash")), root, *_FOLDERS)


def compact_store(spark: SparkSession, root: str, folder_rows: int = FOLDER_ROWS) -> int:
    """Deal the new rows to folders by their hash, sorted by it; contents that came twice stay once, the older one.

    The number of digits follows from the rows. A hot table is split by the digits like any other data.
    """
    new = [f for f in file_versions.files_of(spark, root) if _folder(f, "hash") == "new"]
    if not new:
        return file_versions.versions(spark, root)[-1]
    rows = file_versions.read_files(spark, root, _SCHEMA, new).select(*STORE_COLUMNS)
    most = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    digits = min(MAX_DIGITS, max(0, math.ceil(math.log(most / folder_rows, 16))))
    others = [c for c in STORE_COLUMNS if c not in ("table_name", "content_hash", "created_at", "chunk_id")]
    first = F.min(F.struct("created_at", "chunk_id", *others)).alias("r")
    once = rows.groupBy("table_name", "content_hash").agg(first).select("table_name", "content_hash", "r.*")
    dealt = once.withColumn("hash", _label(digits)).repartition("table_name", "hash").sortWithinPartitions("table_name", "hash", "content_hash")
    return file_versions.replace_files(dealt.select(*STORE_COLUMNS, "hash"), root, new, *_FOLDERS)


def refresh_version(chunks: DataFrame, root: str, embed: Callable[[DataFrame], DataFrame], created_at, new_files: int = NEW_FILES) -> DataFrame:
    """Embed and append the chunks that the store does not hold; returns its rows of the present chunks, each chunk id once.

    Nothing is embedded, and no version written, where all contents are held. Equal contents of a table are embedded once.
    """
    spark = chunks.sparkSession
    chunks = written(chunks, "present")
    missing = missing_chunks(chunks, held_contents(chunks, root))
    once = missing.groupBy("table_name", "content_hash").agg(F.min(F.struct("chunk_id", "kind", "chunk_text")).alias("c"))
    todo = written(once.select("table_name", "content_hash", "c.*"), "missing")
    if todo.limit(1).count() or not file_versions.versions(spark, root):
        append_rows(store_rows(embed(todo), created_at), root)
    if sum(_folder(f, "hash") == "new" for f in file_versions.files_of(spark, root)) > new_files:
        compact_store(spark, root)
    keys = broadcast_if_small(chunks.select("table_name", "content_hash").distinct())
    stored = _candidates(chunks, root).join(keys, ["table_name", "content_hash"], "left_semi")
    return present_rows(stored, chunks)
