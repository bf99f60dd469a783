"""The question history: messages, dates, previews and the response of each question."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.text import content_hash, text_preview
from shiftlens.functions.times import created_or, date_text, iso_text, relative_date
from shiftlens.plans.ordering import with_rank_in_group

MESSAGE_COLUMNS = ["role", "content", "id", "created_at"]


def user_messages(log: DataFrame) -> DataFrame:
    """The questions of a log as chat messages."""
    return log.select(
        F.lit("user").alias("role"),
        F.col("query_text").alias("content"),
        F.col("query_id").alias("id"),
        iso_text(F.col("created_at")).alias("created_at"),
    )


def log_to_messages(log: DataFrame) -> DataFrame:
    """Question and response of each log row in one flat row."""
    return log.select(
        F.lit("user").alias("role"),
        F.col("query_id").alias("id"),
        F.col("query_text").alias("content"),
        "response_id",
        F.col("response_text").alias("text_response"),
        iso_text(F.col("created_at")).alias("created_at"),
    )


def messages_union(*parts: DataFrame) -> DataFrame:
    """Message lists one after the other; a part without a column has null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_role(messages: DataFrame, role: str = "user") -> DataFrame:
    """Messages of one role."""
    return messages.where(F.col("role") == role)


def with_created_default(messages: DataFrame, now: dt.datetime) -> DataFrame:
    """Messages with a creation time, ``now`` where it was missing."""
    return messages.withColumn("created_at", created_or(F.col("created_at"), now))


def history_dates(log: DataFrame) -> DataFrame:
    """The distinct dates, newest first."""
    days = log.select(F.to_date("created_at").alias("date")).distinct().orderBy(F.desc("date"))
    return days.select(date_text(F.col("date")).alias("date"))


def history_ranked(log: DataFrame) -> DataFrame:
    """Questions with their date and their place among their user's of that date, newest first."""
    rows = log.select("query_id", "user_code", "query_text", "created_at", date_text(F.col("created_at")).alias("date"))
    return with_rank_in_group(rows, ["user_code", "date"], [F.desc("created_at"), F.col("query_id")], "place")


def first_responses(responses: DataFrame) -> DataFrame:
    """One response per query id: the first of a list that is read newest first.

    An aggregate, so repeats of one id are folded before the shuffle.
    """
    newest = F.struct("created_at", "response_id", "text_response")
    return responses.groupBy("query_id").agg(F.max(newest).alias("r")).select(
        "query_id", "r.response_id", "r.text_response"
    )


def history_with_response(history: DataFrame, responses: DataFrame) -> DataFrame:
    """Each history item with its first response; items without one are dropped."""
    return history.join(first_responses(responses), "query_id")


def history_panel(log: DataFrame, responses: DataFrame, today: dt.date, n_words: int) -> DataFrame:
    """What each user's history panel lists: label, preview and place of the questions that have a response.

    The texts are cut to ``n_words`` before they are ranked, so only previews are shuffled. A question's place is among
    those of its user and date.
    """
    rows = log.select(
        "query_id",
        "user_code",
        relative_date(F.col("created_at"), today).alias("label"),
        text_preview(F.col("query_text"), n_words).alias("preview"),
        "created_at",
    )
    answered = history_with_response(rows, responses).select(*rows.columns)
    ranked = with_rank_in_group(answered, ["user_code", "label"], [F.desc("created_at"), F.col("query_id")], "place")
    return ranked.drop("created_at")


def query_dedup(log: DataFrame) -> DataFrame:
    """Repeated questions folded under the hash of their text: the key of a result cache."""
    return log.groupBy(content_hash(F.col("query_text")).alias("query_hash")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.min("query_id").alias("first_query_id")
    )
