"""Rows, schema and statistics of a table as text chunks.

Chunk ids run on across the three kinds: groups of rows, then the schema, then one chunk per numeric
column. Equal chunks are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.fixed import CHUNK_ROWS, DATA_HEADER, SCHEMA_HEADER, SCHEMA_LINE
from shiftlens.functions.text import content_hash, row_text
from shiftlens.operators.profiling import numeric_facts, stats_frame
from shiftlens.plans.medians import ColumnStats
from shiftlens.plans.ordering import with_row_index

TABLES_AT_ONCE = 4
CHUNK_COLUMNS = ["table_name", "chunk_id", "kind", "chunk_text", "content_hash"]


def row_texts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row's text beside its keys."""
    return df.select(*[F.col(f"`{k}`") for k in keys], row_text(df.columns).alias("row_text"))


def chunk_index(
    df: DataFrame, order_by: Sequence[str], size: int = CHUNK_ROWS, save: Sequence[str | Column] = ("*",)
) -> DataFrame:
    """Row position and the chunk it falls into: consecutive groups of ``size`` rows of a table.

    The table is a scan or saved, so copies of one row can be spread like any other rows.
    """
    indexed = with_row_index(df, order_by, save=save, spread_copies=True)
    return indexed.withColumn("chunk_id", F.expr(f"row_index div {int(size)}"))


def data_chunks(df: DataFrame, order_by: Sequence[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``size`` consecutive rows; the last may be short.

    Typed columns are shuffled and sorted, the longer text is made after it. A group never holds more
    than ``size`` rows.
    """
    indexed = chunk_index(df, order_by, size, save=[row_text(df.columns).alias("row_text")])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("row_index", "row_text"))), lambda r: r["row_text"])
    text = F.concat(F.lit(f"{DATA_HEADER}\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return indexed.groupBy("chunk_id").agg(text.alias("chunk_text")).select(
        "chunk_id", F.lit("data").alias("kind"), "chunk_text"
    )


def _chunks_before(n_rows: Column, size: int) -> Column:
    return F.ceil(n_rows / size).cast("bigint")


def schema_chunk(df: DataFrame, size: int = CHUNK_ROWS, n_rows: int | None = None) -> DataFrame:
    """One chunk naming every column and its type; its id follows the data chunks.

    The rows are counted unless their number is given.
    """
    lines = "".join(
        SCHEMA_LINE.format(column=f.name, type=f.dataType.simpleString()) + "\n" for f in df.schema.fields
    )
    counted = df.agg(F.count(F.lit(1)).alias("n")) if n_rows is None else df.sparkSession.range(1).select(F.lit(n_rows).alias("n"))
    return counted.select(
        _chunks_before(F.col("n"), size).alias("chunk_id"),
        F.lit("schema").alias("kind"),
        F.lit(f"{SCHEMA_HEADER}\n{lines}").alias("chunk_text"),
    )


def stats_chunks(df: DataFrame, size: int = CHUNK_ROWS, facts: list[ColumnStats] | None = None) -> DataFrame:
    """One chunk per numeric column with min, max, mean and median, worked out unless they are given."""
    parts = [("\nMin: ", "min_text"), (", Max: ", "max_text"), (", Mean: ", "mean_text"), (", Median: ", "median_text")]
    shown = [c for label, column in parts for c in (F.lit(label), F.col(column))]
    text = F.concat(F.lit("Stats for "), "column_name", F.lit(":"), *shown, F.lit("\n"))
    return stats_frame(df.sparkSession, numeric_facts(df) if facts is None else facts).select(
        (_chunks_before(F.col("n_rows"), size) + 1 + F.col("ordinal")).alias("chunk_id"),
        F.lit("stats").alias("kind"),
        text.alias("chunk_text"),
    )


def table_chunks(df: DataFrame, table_name: str, order_by: Sequence[str], size: int = CHUNK_ROWS) -> DataFrame:
    """All chunks of a table with the hash of their content; the statistics' scans also count its rows."""
    facts = numeric_facts(df)
    parts = [data_chunks(df, order_by, size), schema_chunk(df, size, facts[0].n_rows if facts else None)]
    if facts:
        parts.append(stats_chunks(df, size, facts))
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(table_name).alias("table_name"), "chunk_id", "kind", "chunk_text",
        content_hash(F.col("chunk_text")).alias("content_hash"),
    )


def chunk_union(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], size: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of several tables, each given with the columns that order its rows.

    The sorts and scans of the tables do not depend on each other, so a few are submitted together.
    """
    def one(name: str) -> DataFrame:
        df, order_by = tables[name]
        return table_chunks(df, name, order_by, size)

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, tables)))
