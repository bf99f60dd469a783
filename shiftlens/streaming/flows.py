"""The append-only flows as streams; each means the same as its batch operator.

Checkpoints and outputs go to the folder all executors share. ``available_now`` runs a stream over
what is there and returns; a service starts the same writer with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from shiftlens.plans.scratch import fresh_path, written
from shiftlens.plans.sizing import broadcast_if_small
from shiftlens.sources.logs import LOG_SCHEMA, TOKEN_SCHEMA
from shiftlens.sources.store import append_store, missing_chunks, store_or_empty, store_rows
from shiftlens.streaming import seen_ids

#: Tables of a batch whose folders are picked out by name.
PRUNED_TABLES = 100


def available_now(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream until its present input is worked off."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


_DAILY = "day string, n_turns bigint, total_tokens bigint, max_tokens bigint"


def token_daily_parts(lines: DataFrame) -> DataFrame:
    """Token totals of some lines by the date that they bear; parts of a day add up."""
    return lines.groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("total_tokens").alias("total_tokens"), F.max("total_tokens").alias("max_tokens")
    )


def run_token_daily(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """Daily totals of a folder of JSON lines, however late a line comes.

    Every micro-batch saves its own part of each day under its number, so a replayed batch replaces what
    it wrote before; the parts are added when they are read. No state is kept and nothing is too late.
    """
    out = fresh_path(spark, "token-daily")
    lines = spark.readStream.schema(TOKEN_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)

    def save(part: DataFrame, batch: int) -> None:
        token_daily_parts(part).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    available_now(lines.writeStream.foreachBatch(save), fresh_path(spark, "token-daily-state"))
    parts = _saved_batches(spark, out, _DAILY)
    return parts.groupBy("day").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("total_tokens").alias("total_tokens"), F.max("max_tokens").alias("max_tokens")
    )


def _saved_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches of a stream have saved under ``path``, with their number; empty before the first."""
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def log_dedup_batch(out: str, fan: int = seen_ids.FAN, bucket_ids: int = seen_ids.BUCKET_IDS) -> Callable:
    """A micro-batch step that saves only the query ids that no other batch has saved.

    The saved ids are kept apart from the rows, in buckets of which a batch opens only its own (``seen_ids``), so
    what it reads does not grow with the log. However late an id comes, its first delivery is
    kept and later ones are not; a replayed batch replaces what it wrote before. Rows without an id are kept once a batch.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark, kept = rows.sparkSession, f"{out}-ids"
        columns = [c for c in rows.columns if c != "query_id"]
        once = rows.groupBy("query_id").agg(F.min(F.struct(*columns)).alias("r")).select("query_id", "r.*").select(*rows.columns)
        once = written(once, "delivered")
        seen_ids.merge_sets(spark, kept, batch, "query_id", fan, bucket_ids)
        held = seen_ids.held_ids(once.select("query_id"), kept, batch)
        once.join(held, "query_id", "left_anti").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        new = spark.read.schema(LOG_SCHEMA).parquet(f"{out}/batch={batch}").select("query_id").where(F.col("query_id").isNotNull())
        seen_ids.save_ids(new, kept, batch, bucket_ids)

    return step


def run_log_dedup(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """Deliveries of log rows from a Parquet folder, each query id once."""
    out = fresh_path(spark, "log-dedup")
    log = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    available_now(log.writeStream.foreachBatch(log_dedup_batch(out)), fresh_path(spark, "log-dedup-state"))
    return _saved_batches(spark, out, LOG_SCHEMA).drop("batch")


def store_missing_batch(embed: Callable[[DataFrame], DataFrame], path: str, created_at) -> Callable:
    """A micro-batch step that embeds and stores only the contents the store does not hold yet.

    The look-up is inside the step, so a replayed batch adds nothing. Equal contents of one batch
    are folded first. The store is cut to the contents of the batch before anything is shuffled.
    """

    def step(chunks: DataFrame, batch: int) -> None:
        rows = chunks.groupBy("table_name", "content_hash").agg(
            F.min(F.struct("chunk_id", "kind", "chunk_text")).alias("c")
        ).select("table_name", "content_hash", "c.*")
        rows = written(rows, "arrived")
        keys = ["table_name", "content_hash"]
        tables = [r[0] for r in rows.select("table_name").distinct().limit(PRUNED_TABLES + 1).collect()]
        held = store_or_empty(chunks.sparkSession, path)
        if len(tables) <= PRUNED_TABLES:  # then only their folders are opened
            held = held.where(F.col("table_name").isin(tables))
        held = held.join(broadcast_if_small(rows.select(*keys)), keys, "left_semi")
        append_store(store_rows(embed(missing_chunks(rows, held)), created_at), path, gather=True)

    return step


def run_store_missing(
    chunk_stream: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], created_at
) -> DataFrame:
    """Store the missing chunks of a stream, and return the store."""
    spark = chunk_stream.sparkSession
    writer = chunk_stream.writeStream.foreachBatch(store_missing_batch(embed, path, created_at))
    available_now(writer, fresh_path(spark, "store-state"))
    return store_or_empty(spark, path)

