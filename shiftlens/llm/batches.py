"""Tables saved with small Arrow batches, so that whole texts pass through workers a few at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shiftlens.plans.scratch import written

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within this block, jobs hand at most ``rows`` rows to a Python worker at once."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def saved(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    """``df`` as a table in the shared folder, worked out in small batches."""
    with small_batches(df.sparkSession, rows):
        return written(df, label)
