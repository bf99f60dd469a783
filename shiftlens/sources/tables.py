"""Table scans, schema capture, and small exports of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, as a frame that is part of the plan.

    Made from a list, a frame is unpickled by Python workers on every executor whenever it is read.
    """
    kinds = T.StructType.fromDDL(schema)
    names = kinds.names
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], to_arrow_schema(kinds)), kinds)


def scan_sample(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows by a key: a bounded sample that is the same on every run."""
    return df.orderBy(*order_by).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type: no booleans, strings or times."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, type, rows of the table and values present, in one scan."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col(f"c{i}").alias("n_values"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select("n_rows", F.inline(rows)).select(
        "ordinal", "column_name", "column_type", "n_rows", "n_values"
    )


def schema_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`column_profile` of several tables under a ``table_name`` column."""
    parts = [column_profile(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object; missing values are written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def from_json_records(records: DataFrame, schema: T.StructType, name: str = "record") -> DataFrame:
    """Typed rows back from :func:`json_records`, beside their JSON; the schema is given, never guessed again."""
    return records.select(name, F.from_json(name, schema).alias("r")).select(name, "r.*")


def csv_preview(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """Header and first ``n`` rows as one CSV text."""
    options = {"escape": '"', "nullValue": ""}
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options)
    position = F.struct(*[F.col(k) if isinstance(k, str) else k for k in order_by])
    top = df.orderBy(*order_by).limit(n).select(F.struct(position.alias("k"), line.alias("line")).alias("row"))
    lines = F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"])
    names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), options)
    header = F.concat(names, F.lit("\n"))
    return top.agg(F.concat(header, F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")).alias("csv_text"))
