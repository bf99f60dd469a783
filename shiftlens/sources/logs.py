"""The query log (Parquet) and the token log (JSON lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.times import log_time_text
from shiftlens.sources import file_versions

# The log is partitioned by a hash of the user, so the number of folders does not grow with the
# number of users and a read for one user opens one folder.
USER_BUCKETS = 64

LOG_COLUMNS = [
    "query_id", "response_id", "query_text", "response_text", "user_code", "plant_code", "created_at",
]
LOG_SCHEMA = (
    "query_id string, response_id string, query_text string, response_text string, "
    "user_code string, plant_code string, created_at timestamp_ntz, user_bucket int"
)
TOKEN_SCHEMA = "timestamp string, nlp_tokens bigint, table_tokens bigint, viz_tokens bigint, total_tokens bigint"


def user_bucket(user: Column) -> Column:
    """Partition of a user."""
    return F.pmod(F.crc32(user.cast("binary")), F.lit(USER_BUCKETS)).cast("int")


def _bucketed(rows: DataFrame) -> DataFrame:
    """Log rows by their user's bucket; a heavy user's rows are split over tasks by the rebalance."""
    by_user = F.coalesce(user_bucket(F.col("user_code")), F.lit(0)).alias("user_bucket")
    return rows.select(*LOG_COLUMNS, by_user).hint("rebalance", "user_bucket")


def append_log(rows: DataFrame, path: str) -> None:
    """Append query/response rows."""
    _bucketed(rows).write.mode("append").partitionBy("user_bucket").parquet(path)


def append_log_version(rows: DataFrame, root: str) -> int:
    """Append query/response rows to a log whose versions share files; returns the version's number."""
    return file_versions.append_version(_bucketed(rows), root, "user_bucket")


def read_log_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of such a log, the newest if none is named."""
    return file_versions.read_version(spark, root, LOG_SCHEMA, version)


def delete_user_plant(spark: SparkSession, root: str, user: str, plant: str) -> int:
    """A version without one user's rows of one plant; only the files of that user's bucket are opened or rewritten.

    Rows with a missing code never match, so they stay.
    """
    mine = F.col("user_bucket") == user_bucket(F.lit(user))
    hit = mine & (F.col("user_code") == user) & (F.col("plant_code") == plant)
    return file_versions.delete_rows(spark, root, LOG_SCHEMA, hit, "user_bucket")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole query log."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def scan_user(log: DataFrame, user: str) -> DataFrame:
    """One user's log, newest first; on a saved log only the user's folder is opened."""
    mine = F.col("user_code") == user
    if "user_bucket" in log.columns:
        mine = mine & (F.col("user_bucket") == user_bucket(F.lit(user)))
    return (
        log.where(mine)
        .select("query_id", "response_id", "query_text", "response_text", "created_at")
        .orderBy(F.desc("created_at"), "query_id")
    )


def without_user_plant(log: DataFrame, user: str, plant: str) -> DataFrame:
    """What survives a delete for one user and plant; written as the next snapshot of the log.

    Rows with a missing code never match a delete, so they stay.
    """
    hit = (F.col("user_code") == user) & (F.col("plant_code") == plant)
    return log.where(~F.coalesce(hit, F.lit(False)))


def token_rows(counts: DataFrame) -> DataFrame:
    """Token log lines from counts and a ``created_at`` time; the total is the sum of the parts."""
    parts = [F.col(c).cast("bigint").alias(c) for c in ("nlp_tokens", "table_tokens", "viz_tokens")]
    total = F.col("nlp_tokens") + F.col("table_tokens") + F.col("viz_tokens")
    return counts.select(
        log_time_text(F.col("created_at")).alias("timestamp"), *parts, total.cast("bigint").alias("total_tokens")
    )


def append_tokens(lines: DataFrame, path: str) -> None:
    """Append token log lines as JSON."""
    lines.write.mode("append").json(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token log with its fixed schema."""
    return spark.read.schema(TOKEN_SCHEMA).json(path)
