"""Exact column statistics in a column's own type.

One scan takes counts, extremes and sums; the middle values are found by radix selection (``radix``), which
scans again for each digit of them, all columns at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.plans.radix import values_at_ranks


@dataclass
class ColumnStats:
    """What is known of a column; extremes and median in its own type, the mean exact for whole numbers and decimals."""

    name: str
    exact: bool
    n_rows: int
    n_values: int
    min: object
    max: object
    mean: object
    median: object = None

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.n_values - 1) // 2, self.n_values // 2


def _value(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    return F.when(~F.isnan(value), value) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else value


def _profile(df: DataFrame) -> list[ColumnStats]:
    """The first scan."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        v = _value(field)
        exact = not isinstance(field.dataType, (T.DoubleType, T.FloatType))
        scale = field.dataType.scale if isinstance(field.dataType, T.DecimalType) else 0
        total = F.sum(v.cast(f"decimal(38,{scale})")) if exact else F.avg(v.cast("double"))
        parts += [
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"), total.alias(f"m{i}"),
        ]
    row = df.agg(*parts).first()
    out = []
    for i, field in enumerate(df.schema.fields):
        exact = not isinstance(field.dataType, (T.DoubleType, T.FloatType))
        n, mean = row[f"n{i}"], row[f"m{i}"]
        if exact and mean is not None:
            mean = Decimal(mean) / n
        out.append(ColumnStats(field.name, exact, row["rows"], n, row[f"a{i}"], row[f"z{i}"], mean))
    return out


def _medians(df: DataFrame, stats: list[ColumnStats]) -> None:
    known = [s for s in stats if s.n_values]
    if not known:
        return
    found = values_at_ranks(df, {s.name: sorted(set(s.ranks)) for s in known}, {s.name: (s.min, s.max) for s in known})
    for s in known:
        first, last = found[s.name][0], found[s.name][-1]
        s.median = (Decimal(first) + Decimal(last)) / 2 if s.exact else (first + last) / 2


def column_facts(df: DataFrame) -> list[ColumnStats]:
    """Statistics of the columns of ``df``, all of which must be numeric; nulls and NaN are missing values."""
    with localcontext(prec=80):
        stats = _profile(df)
        _medians(df, stats)
    return stats
