"""The embedding store: Parquet partitioned by table, one row per chunk with its vector.

Vectors and texts are native columns; JSON text appears only at the import and export edge.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.text import first_line, truncated
from shiftlens.functions.vectors import l2_norm, mean_of
from shiftlens.plans.scratch import written
from shiftlens.sources.tables import known_rows

STORE_SCHEMA = (
    "record_id string, table_name string, chunk_id bigint, kind string, chunk_text string, "
    "content_hash string, created_at timestamp_ntz, embedding array<double>"
)
STORE_COLUMNS = [c.split()[0] for c in STORE_SCHEMA.split(", ")]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store as a frame; a filter on ``table_name`` prunes partitions."""
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def store_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The store, empty when nothing has been stored yet."""
    try:
        return read_store(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return known_rows(spark, [], STORE_SCHEMA)


def store_rows(embedded: DataFrame, created_at) -> DataFrame:
    """Embedded chunks in the store's layout; the record id is ``table_chunk``.

    Chunks without a vector, whose embedding failed, are left out and so stay missing in the store.
    """
    return embedded.where(F.col("embedding").isNotNull()).withColumns(
        {
            "record_id": F.concat_ws("_", "table_name", "chunk_id"),
            "created_at": F.lit(created_at).cast("timestamp_ntz"),
        }
    ).select(*STORE_COLUMNS)


def append_store(rows: DataFrame, path: str, gather: bool = False) -> None:
    """Append to the store.

    Chunks of whole tables come in partitions of one table each and are written as they are. Where
    every partition mixes many tables, ``gather`` brings the rows of a table into few files; its
    rebalance splits a table that holds much of the data over many tasks.
    """
    gathered = rows.hint("rebalance", "table_name") if gather else rows
    gathered.write.mode("append").partitionBy("table_name").parquet(path)


def store_count(store: DataFrame) -> DataFrame:
    """Chunks per table."""
    return store.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_chunks"))


def store_complete(tables: DataFrame, store: DataFrame) -> DataFrame:
    """Whether every listed table has at least one stored chunk (one row)."""
    counts = store_count(store)
    return (
        tables.select("table_name").join(counts, "table_name", "left")
        .agg(
            F.count(F.lit(1)).alias("n_tables"),
            F.count("n_chunks").alias("n_stored"),
            F.coalesce(F.bool_and(F.coalesce(F.col("n_chunks") > 0, F.lit(False))), F.lit(False)).alias("complete"),
        )
    )


def encode_json(store: DataFrame) -> DataFrame:
    """Text and vector as JSON text, the form in which a warehouse table exchanges them."""
    # A JSON string is the one element of a JSON array without its brackets.
    text = F.to_json(F.array("chunk_text"))
    return store.select(
        "record_id",
        "table_name",
        F.substring(text, F.lit(2), F.length(text) - 2).alias("chunk_json"),
        F.to_json("embedding").alias("embedding_json"),
    )


def decode_json(records: DataFrame) -> DataFrame:
    """Text and vector from JSON text; missing text reads ``""``, a missing vector is empty."""
    text = F.from_json(F.concat(F.lit("["), F.col("chunk_json"), F.lit("]")), "array<string>")[0]
    vector = F.from_json("embedding_json", "array<double>")
    return records.select(
        "record_id",
        "table_name",
        F.coalesce(text, F.lit("")).alias("chunk_text"),
        F.coalesce(vector, F.array().cast("array<double>")).alias("embedding"),
    )


def without_tables(store: DataFrame, stale: Sequence[str]) -> DataFrame:
    """The store less the stale tables: written as a new store, it makes them be rebuilt.

    The predicate is on the partition column, so stale files are not even read.
    """
    return store.where(~F.coalesce(F.col("table_name").isin(list(stale)), F.lit(False)))


def missing_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose content the store does not hold for their table.

    Of the store only the two key columns are read.
    """
    held = store.select("table_name", "content_hash").distinct()
    return chunks.join(held, ["table_name", "content_hash"], "left_anti")


def without_stale(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The stored rows whose content is still among the present chunks of their table.

    Written as a new store, it drops what changed data has left behind.
    """
    present = chunks.select("table_name", "content_hash").distinct()
    return store.join(present, ["table_name", "content_hash"], "left_semi").select(*store.columns)


def pair_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk with the vector of its own content, never by position.

    A chunk id alone is not enough: after a change the store still holds what the chunk was before.
    """
    return chunks.join(vectors, ["table_name", "content_hash", "chunk_id"])


def refresh_store(
    chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], created_at
) -> DataFrame:
    """Embed and append the chunks the store does not hold; returns the store's rows of the present chunks.

    Nothing is embedded on a second run over the same data, and a batch that failed before is tried
    again. What changed data has left behind stays in the folder but is not returned, so a chunk id
    comes once. Equal contents of one table are one stored row, under the chunk id that came first.
    """
    spark = chunks.sparkSession
    chunks = written(chunks, "present")
    missing = missing_chunks(chunks, store_or_empty(spark, path))
    append_store(store_rows(embed(missing), created_at), path)
    return present_rows(read_store(spark, path), chunks)


def present_rows(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The stored vectors under the present chunks' ids: one row per chunk, its content and kind as they are now."""
    kept = store.groupBy("table_name", "content_hash").agg(
        F.min(F.struct("created_at", "chunk_id", "embedding")).alias("s")
    )
    now = chunks.select("table_name", "content_hash", "chunk_id", "kind", "chunk_text")
    return now.join(kept, ["table_name", "content_hash"]).select(
        F.concat_ws("_", "table_name", "chunk_id").alias("record_id"), "table_name", "chunk_id", "kind", "chunk_text",
        "content_hash", F.col("s.created_at").alias("created_at"), F.col("s.embedding").alias("embedding"),
    )


def store_metadata(store: DataFrame, schema: DataFrame) -> DataFrame:
    """Per table: creation time, chunks, vectors and the table's column list.

    ``schema`` has one row per column, so the collected list is bounded by the width of a table.
    """
    totals = store.groupBy("table_name").agg(
        F.max("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("num_chunks"),
        F.count("embedding").alias("num_embeddings"),
    )
    columns = schema.groupBy("table_name").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]),
            ", ",
        ).alias("columns")
    )
    return totals.join(columns, "table_name", "left")


def embedding_stats(store: DataFrame) -> DataFrame:
    """Chunk and vector counts, dimensions of the first vector, mean length, extreme components."""
    has_vector = F.size("embedding") > 0
    first = F.min(F.when(has_vector, F.struct("table_name", "chunk_id", F.size("embedding").alias("d"))))
    return store.agg(
        F.count(F.lit(1)).alias("num_chunks"),
        F.count("embedding").alias("num_embeddings"),
        first["d"].alias("dimensions"),
        F.round(F.avg(F.when(has_vector, l2_norm(F.col("embedding")))), 4).alias("avg_magnitude"),
        F.round(F.min(F.array_min("embedding").cast("double")), 4).alias("min_value"),
        F.round(F.max(F.array_max("embedding").cast("double")), 4).alias("max_value"),
    )


def embedding_row_means(store: DataFrame) -> DataFrame:
    """Mean component of each vector."""
    return store.select("table_name", "chunk_id", F.round(mean_of(F.col("embedding")), 6).alias("mean_value"))


def chunk_kind_counts(store: DataFrame) -> DataFrame:
    """Chunks per first line."""
    return store.groupBy(first_line(F.col("chunk_text")).alias("chunk_kind")).agg(F.count(F.lit(1)).alias("n_chunks"))


def memory_estimate(store: DataFrame) -> DataFrame:
    """Size of each table's vectors as 4-byte floats, in MB."""
    components = F.sum(F.size("embedding"))
    return store.groupBy("table_name").agg(
        F.count("embedding").alias("num_embeddings"),
        F.round(components * 4 / (1024 * 1024), 6).alias("size_mb"),
    )


def chunk_samples(store: DataFrame, n: int, length: int) -> DataFrame:
    """The first ``n`` chunks by table and id, texts cut at ``length`` characters."""
    return store.orderBy("table_name", "chunk_id").limit(n).select(
        "table_name", "chunk_id", truncated(F.col("chunk_text"), length).alias("sample_text")
    )


def vector_samples(store: DataFrame, n: int, shown: int) -> DataFrame:
    """Leading components of the first vectors, as JSON, and how many follow."""
    lead = F.transform(F.slice("embedding", 1, shown), lambda x: F.round(x.cast("double"), 6))
    return store.orderBy("table_name", "chunk_id").limit(n).select(
        "table_name",
        "chunk_id",
        F.array_join(F.transform(lead, lambda x: x.cast("decimal(18,6)").cast("string")), ", ").alias("leading_values"),
        (F.size("embedding") - shown).alias("n_more"),
    )


def table_list(spark: SparkSession, names: Mapping[str, object] | Sequence[str]) -> DataFrame:
    """The configured table names as a frame."""
    return known_rows(spark, [(n,) for n in names], "table_name string")
