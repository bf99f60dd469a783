"""Token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(lines: DataFrame) -> DataFrame:
    """Lines and tokens per day, from the token log."""
    return lines.groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("nlp_tokens").alias("nlp_tokens"),
        F.sum("table_tokens").alias("table_tokens"),
        F.sum("viz_tokens").alias("viz_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("total_tokens"), 6).alias("mean_tokens"),
        F.max("total_tokens").alias("max_tokens"),
    )
