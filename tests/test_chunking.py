"""Chunks: counts, texts and statistics."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import chunking as c
from shiftlens.operators import profiling


@pytest.mark.parametrize("n", [0, 1, 5, 6, 23])
def test_chunk_count_and_ids(spark, n):
    df = spark.createDataFrame([(i, float(i), f"t{i}", i % 2 == 0) for i in range(n)], "k int, x double, s string, b boolean")
    chunks = c.table_chunks(df, "t", ["k"]).orderBy("chunk_id").collect()
    data = math.ceil(n / 5)
    assert [r.chunk_id for r in chunks] == list(range(data + 1 + 2))
    assert [r.kind for r in chunks] == ["data"] * data + ["schema"] + ["stats"] * 2


def test_data_chunk_text(spark):
    df = spark.createDataFrame([(2, "x\ny"), (1, None), (3, "a | b")], "k int, s string")
    chunk = c.data_chunks(df, ["k"]).first()
    assert chunk.chunk_text == "Data chunk:\nk: 1 | s: None\nk: 2 | s: x\ny\nk: 3 | s: a | b\n"


def test_chunks_follow_row_order(spark):
    df = spark.range(103).select((102 - F.col("id")).alias("k")).repartition(7)
    chunks = c.data_chunks(df, ["k"]).orderBy("chunk_id").collect()
    lines = [line for r in chunks for line in r.chunk_text.split("\n")[1:-1]]
    assert lines == [f"k: {i}" for i in range(103)]
    assert [len(r.chunk_text.split("\n")) - 2 for r in chunks] == [5] * 20 + [3]


def test_schema_and_stats_text(spark):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, None), (4, 2.5, None)], "k int, x double, n bigint")
    chunks = {r.chunk_id: r.chunk_text for r in c.table_chunks(df, "t", ["k"]).collect()}
    assert chunks[1] == "Table schema:\nColumn: k, Type: int\nColumn: x, Type: double\nColumn: n, Type: bigint\n"
    assert chunks[2] == "Stats for k:\nMin: 1, Max: 4, Mean: 2.333333, Median: 2.000000\n"
    assert chunks[3] == "Stats for x:\nMin: 1.500000, Max: 2.500000, Mean: 2.000000, Median: 2.000000\n"
    assert chunks[4] == "Stats for n:\nMin: None, Max: None, Mean: None, Median: None\n"


def test_column_stats_skip_other_types(spark):
    df = spark.createDataFrame([(True, "a", 1.0), (False, "b", float("nan"))], "b boolean, s string, x double")
    rows = profiling.column_stats(df.withColumn("ts", F.current_timestamp())).collect()
    assert [(r.column_name, r.n_rows, r.n_values, r.median) for r in rows] == [("x", 2, 1, 1.0)]
    assert profiling.column_stats(df.select("b", "s")).count() == 0


def test_column_stats_on_given_table(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    stats = {r.column_name: r for r in profiling.column_stats(df).collect()}
    prices = [r[0] for r in df.select("l_extendedprice").collect()]
    assert stats["l_extendedprice"].median == statistics.median(prices)
    assert stats["l_extendedprice"].mean == pytest.approx(statistics.mean(prices))


def test_text_order_uses_one_range_shuffle(spark, folder):
    from tests.conftest import plan_of

    plan = plan_of(c.data_chunks(spark.read.parquet(f"{folder}/orders.parquet"), ["o_orderkey"]))
    # The saved row index is read with its needed columns only.
    assert "ReadSchema: struct<o_orderkey" not in plan and "row_text:string" in plan
