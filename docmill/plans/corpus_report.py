"""The corpus summary as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmill.fixed_values import UNKNOWN_TYPE
from docmill.functions.text import round_half_even_2
from docmill.operators.corpus import TOTALS, clause_frequency


def _key_sums(key: str, value: str) -> Column:
    """Aggregate: sum of ``value`` per ``key`` as a map. Only for few, small rows."""
    entries = F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, value)))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e[key])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(
        F.filter(entries, lambda e: e[key] == k), F.lit(0).cast("bigint"),
        lambda total, e: total + e[value],
    )))


def by_kind(analyses: DataFrame) -> DataFrame:
    """Documents folded into one row per file type and score: under a thousand rows."""
    return analyses.groupBy(
        F.coalesce("analytics.file_type", F.lit(UNKNOWN_TYPE)).alias("kind"),
        F.coalesce("analytics.legality_score", F.lit(0)).alias("score"),
    ).agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.coalesce(f"analytics.{t}", F.lit(0))).alias(t) for t in TOTALS],
    )


def fold(parts: DataFrame) -> DataFrame:
    """The report from few rows: ``kind, score, docs`` and the totals, or ``clause, n``."""
    documents = F.coalesce(F.sum("docs"), F.lit(0))
    points = F.sum(F.col("score") * F.col("docs"))
    mean = round_half_even_2(F.try_divide(points.cast("double"), documents.cast("double")))
    return parts.agg(
        documents.alias("total_documents"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOTALS],
        F.coalesce(mean, F.lit(0.0)).alias("average_legality_score"),
        _key_sums("kind", "docs").alias("file_types"),
        _key_sums("score", "docs").alias("score_counts"),
        _key_sums("clause", "n").alias("clause_frequency"),
    )


def corpus_report(analyses: DataFrame) -> DataFrame:
    """Totals, mean score, ``file_types`` and ``clause_frequency`` maps, and
    ``score_counts``, the scores as a map from score to number of documents.

    The documents are folded into one row per (file type, score), under a
    thousand rows, and the clause counts into one per clause; only those meet
    in the last step.
    """
    return fold(by_kind(analyses).unionByName(clause_frequency(analyses), allowMissingColumns=True))
