"""What became of each response, and result previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.fixed import NO_RESULTS
from shiftlens.functions.text import extract_sql, final_response, has_sql


def outcome(response: Column, n_rows: Column, store_ready: Column) -> Column:
    """``fallback`` without a complete store, else by SQL fence and result rows."""
    return (
        F.when(~F.coalesce(store_ready, F.lit(False)), "fallback")
        .when(has_sql(response) & (F.coalesce(n_rows, F.lit(0)) > 0), "sql_rows")
        .when(has_sql(response), "sql_empty")
        .otherwise("text")
    )


def response_outcomes(responses: DataFrame) -> DataFrame:
    """Responses per outcome."""
    kind = outcome(F.col("response"), F.col("n_rows"), F.col("store_ready"))
    return responses.groupBy(kind.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_responses"), F.count(extract_sql(F.col("response"))).alias("n_sql")
    )


def logged_text(
    response: Column, n_rows: Column, store_ready: Column, summary: Column, debug: bool | Column = False
) -> Column:
    """The text that is shown and logged for a response, by its outcome.

    A result is announced by its summary, an empty one by a fixed line; any other response is its
    own text.
    """
    kind = outcome(response, n_rows, store_ready)
    return (
        F.when(kind == "sql_rows", final_response(summary, extract_sql(response), debug))
        .when(kind == "sql_empty", NO_RESULTS)
        .otherwise(response)
    )


def result_preview(df: DataFrame, order_by: Sequence[str], head: int, tail: int) -> DataFrame:
    """The first ``head`` and the last ``tail`` rows of a result, tagged; no row comes twice.

    Two bounded top-n reads, and the tail without what the head has; ``order_by`` must be a total order.
    """
    first = df.orderBy(*order_by).limit(head)
    last = df.orderBy(*[F.desc(c) for c in order_by]).limit(tail)
    shown = first.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(order_by)])
    same = [last[c].eqNullSafe(shown[f"__{i}"]) for i, c in enumerate(order_by)]
    rest = last.join(shown, same, "left_anti")
    return first.select(F.lit("head").alias("part"), "*").unionByName(rest.select(F.lit("tail").alias("part"), "*"))
