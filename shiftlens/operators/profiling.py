"""Row counts, column statistics and result profiles."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.fixed import MISSING
from shiftlens.plans.medians import ColumnStats, column_facts
from shiftlens.sources.tables import column_profile, known_rows, numeric_columns

STATS_SCHEMA = (
    "ordinal int, column_name string, n_rows bigint, n_values bigint, "
    "min double, max double, mean double, median double, "
    "min_text string, max_text string, mean_text string, median_text string"
)


def count_rows(df: DataFrame) -> DataFrame:
    """The number of rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def select_numeric(df: DataFrame) -> DataFrame:
    """Only the columns of a numeric type."""
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def column_stats(df: DataFrame) -> DataFrame:
    """Min, max, mean and exact median of each numeric column, missing values skipped.

    As doubles, and as text that keeps every digit of large whole numbers and decimals. The scans run at
    once; what comes back is one row per column.
    """
    return stats_frame(df.sparkSession, numeric_facts(df))


def numeric_facts(df: DataFrame) -> list[ColumnStats]:
    """Statistics of the numeric columns, for callers that need them for more than one frame."""
    return column_facts(select_numeric(df)) if numeric_columns(df) else []


def stats_frame(spark: SparkSession, facts: list[ColumnStats]) -> DataFrame:
    """:func:`column_stats` from statistics that are known."""
    return known_rows(spark, [_stats_row(i, f) for i, f in enumerate(facts)], STATS_SCHEMA)


def _stats_row(ordinal: int, facts: ColumnStats) -> tuple:
    values = [facts.min, facts.max, facts.mean, facts.median]
    whole = isinstance(facts.min, int)
    texts = [str(v) if whole and i < 2 and v is not None else number_text(v) for i, v in enumerate(values)]
    return (ordinal, facts.name, facts.n_rows, facts.n_values, *[None if v is None else float(v) for v in values], *texts)


def number_text(value: float | Decimal | None, digits: int = 6) -> str:
    """A number with a fixed count of decimals, rounded half up; ``None`` when missing.

    Doubles too large for that are written as they are, infinite ones as ``Infinity``.
    """
    if value is None:
        return MISSING
    if isinstance(value, float) and (math.isinf(value) or math.isnan(value) or abs(value) >= 1e32):
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, repr(value).replace("nan", "NaN"))
    exact = value if isinstance(value, Decimal) else Decimal(repr(value))
    with localcontext(prec=80):
        return format(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP) + 0, "f")


def result_profile(result: DataFrame) -> DataFrame:
    """Row count and (column, type) list of a result."""
    return column_profile(result).select("ordinal", "column_name", "column_type", "n_rows")


def result_nonempty(result: DataFrame) -> DataFrame:
    """Whether a result has any row; stops at the first one."""
    return result.limit(1).agg((F.count(F.lit(1)) > 0).alias("nonempty"))


def oee(availability: str = "availability", performance: str = "performance", quality: str = "quality"):
    """Overall equipment effectiveness: the product of its three rates."""
    return F.col(availability) * F.col(performance) * F.col(quality)


def oee_rollup(shifts: DataFrame, start: str = "ShiftStartTime") -> DataFrame:
    """Mean OEE and its parts by month of the shift start, which is written out per group only."""
    monthly = shifts.groupBy(F.trunc(F.to_date(start), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_shifts"),
        F.round(F.avg("availability"), 6).alias("availability"),
        F.round(F.avg("performance"), 6).alias("performance"),
        F.round(F.avg("quality"), 6).alias("quality"),
        F.round(F.avg(oee()), 6).alias("oee"),
        F.sum(F.col("total_count").cast("decimal(18,2)")).cast("double").alias("total_count"),
    )
    return monthly.withColumn("month", F.date_format("month", "yyyy-MM"))
