"""Filters, lookups and basic records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from docmill.fixed_values import EMPTY_DOCUMENT, RECORD_PREVIEW_CHARS


def find(df: DataFrame, match: Mapping[str, object]) -> DataFrame:
    """Rows whose fields (dotted for nested ones) equal the given values; an
    empty match returns all rows."""
    for field, value in match.items():
        df = df.filter(F.col(field).eqNullSafe(F.lit(value)))
    return df


def by_id(df: DataFrame, doc_id: object) -> DataFrame:
    """Point lookup; no row if absent. The equality reaches the Parquet scan."""
    return df.filter(F.col("doc_id") == F.lit(doc_id))


def basic_records(texts: DataFrame) -> DataFrame:
    """``(pos, text)`` to ``(pos, original, length, summary, error)``.

    An empty text gives an error record in its place instead of failing.
    """
    text = F.col("text")
    empty = F.coalesce(text, F.lit("")) == ""
    summary = F.when(
        F.length(text) > RECORD_PREVIEW_CHARS,
        F.concat(F.substring(text, 1, RECORD_PREVIEW_CHARS), F.lit("...")),
    ).otherwise(text)
    return texts.select(
        "pos",
        F.when(~empty, text).alias("original"),
        F.when(~empty, F.length(text)).alias("length"),
        F.when(~empty, summary).alias("summary"),
        F.when(empty, EMPTY_DOCUMENT).alias("error"),
    )
