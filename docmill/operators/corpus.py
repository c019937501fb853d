"""Corpus-level aggregates over stored analysis records.

All of them read single fields of ``analytics``; page texts are never scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.fixed_values import UNKNOWN_TYPE
from docmill.functions.text import round_half_even_2

TOTALS = (
    "total_pages", "total_names", "total_emails", "total_phones", "total_signers",
    "total_clauses",
)


def _score():
    return F.coalesce("analytics.legality_score", F.lit(0))


def totals(analyses: DataFrame) -> DataFrame:
    """One row: document count, sums (a missing value counts 0) and mean score."""
    return analyses.agg(
        F.count(F.lit(1)).alias("total_documents"),
        *[F.coalesce(F.sum(F.coalesce(f"analytics.{t}", F.lit(0))), F.lit(0)).alias(t)
          for t in TOTALS],
        F.coalesce(round_half_even_2(F.avg(_score())), F.lit(0.0)).alias("average_legality_score"),
    )


def scores(analyses: DataFrame) -> DataFrame:
    """Every document's score, lowest first, as a distributed table."""
    return analyses.select(_score().alias("legality_score")).orderBy("legality_score")


def score_counts(analyses: DataFrame) -> DataFrame:
    """``(legality_score, n)``: all scores, in at most 101 rows."""
    return analyses.groupBy(_score().alias("legality_score")).agg(F.count(F.lit(1)).alias("n"))


def file_types(analyses: DataFrame) -> DataFrame:
    """``(file_type, n)``; a missing type is ``unknown``."""
    kind = F.coalesce("analytics.file_type", F.lit(UNKNOWN_TYPE))
    return analyses.groupBy(kind.alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def clause_frequency(analyses: DataFrame) -> DataFrame:
    """``(clause, n)``: sums of the per-document counts, zeros kept."""
    # explode would add a filter on the map, computing one not yet stored twice
    return (
        analyses.select(F.explode_outer("analytics.clause_summary").alias("clause", "n"))
        .filter(F.col("clause").isNotNull())
        .groupBy("clause")
        .agg(F.sum("n").alias("n"))
    )
