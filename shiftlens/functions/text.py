"""Text column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftlens.functions.fixed import (
    CELL, CELL_SEPARATOR, DETAILS, ELLIPSIS, FENCE, MISSING, SQL_FENCE, UNICODE_CLASSES, WHITESPACE,
)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def row_text(columns: Sequence[str]) -> Column:
    """``col: value | col: value``; a missing value reads ``None``."""
    cells = [
        F.concat(F.lit(CELL.format(column=c)), F.coalesce(_quoted(c).cast("string"), F.lit(MISSING)))
        for c in columns
    ]
    return F.concat_ws(CELL_SEPARATOR, *cells)


def words(text: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{UNICODE_CLASSES}{WHITESPACE}+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(words(text))


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"{UNICODE_CLASSES}^{WHITESPACE}+|{WHITESPACE}+$", "")


def has_sql(text: Column) -> Column:
    """Whether a response holds a SQL fence."""
    return F.coalesce(F.contains(text, F.lit(SQL_FENCE)), F.lit(False))


def extract_sql(text: Column) -> Column:
    """The SQL after the first fence, up to the next fence or the end; null without a fence."""
    start = F.locate(SQL_FENCE, text) + len(SQL_FENCE)
    rest = F.substr(text, start)
    return F.when(has_sql(text), stripped(F.substring_index(rest, FENCE, 1)))


def text_preview(text: Column, n_words: int) -> Column:
    """The first words, with an ellipsis when there are more."""
    w = words(text)
    return F.concat(
        F.array_join(F.slice(w, 1, n_words), " "), F.when(F.size(w) > n_words, F.lit(ELLIPSIS)).otherwise(F.lit(""))
    )


def truncated(text: Column, length: int) -> Column:
    """The first ``length`` characters, with an ellipsis when there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(ELLIPSIS))).otherwise(text)


def first_line(text: Column) -> Column:
    """The whole first line; a text without line breaks is one line."""
    return F.substring_index(text, "\n", 1)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text in hex: the key under which equal texts are one."""
    return F.sha2(text, 256)


def prefixed_id(prefix: str, *keys: Column) -> Column:
    """A repeatable id such as ``q-<hash>``: the same keys give the same id on any retry."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256))


def final_response(summary: Column, sql: Column, debug: bool | Column = False) -> Column:
    """Summary and the heading of the details, after the SQL itself in debug mode."""
    shown = F.lit(debug) if isinstance(debug, bool) else debug
    prefix = F.concat(F.lit(f"SQL Query:\n{SQL_FENCE}\n"), sql, F.lit(f"\n{FENCE}\n"))
    return F.concat(F.when(shown, prefix).otherwise(F.lit("")), summary, F.lit(DETAILS))
