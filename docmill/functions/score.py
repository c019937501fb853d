"""Scores, chart values and prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmill.fixed_values import (
    ANSWER_LABEL, CHART_LABELS, QUESTION_LABEL, SUMMARIZE_PROMPT, VERDICT_CHARS, VERDICT_PROMPT,
)
from docmill.functions.text import preview


def legality_score(names: Column, clauses: Column, emails: Column, phones: Column) -> Column:
    """Rule-based score, 0-100, from distinct names, clause occurrences and
    distinct e-mails and phones."""
    by_names = F.least(F.lit(40), names * 2)
    by_clauses = F.least(F.lit(30), clauses * 4)
    by_contacts = F.least(F.lit(30), (emails + phones) * 2)
    return F.least(F.lit(100), by_names + by_clauses + by_contacts).cast("int")


def combined_confidence(ai_confidence: Column, score: Column) -> Column:
    return F.coalesce(ai_confidence, score)


def chart_data(ai_confidence: Column, score: Column) -> Column:
    combined = combined_confidence(ai_confidence, score)
    return F.struct(
        F.array(*[F.lit(label) for label in CHART_LABELS]).alias("labels"),
        F.array(score, combined).alias("values"),
        combined.alias("combined_confidence"),
    )


def verdict_prompt(text: Column) -> Column:
    return F.concat(F.lit(VERDICT_PROMPT), preview(text, VERDICT_CHARS))


def question_prompt(text: Column, question: Column) -> Column:
    """Ask the question if there is one, else ask for a summary."""
    asked = F.concat(text, F.lit(QUESTION_LABEL), question, F.lit(ANSWER_LABEL))
    return F.when(F.coalesce(question, F.lit("")) != "", asked).otherwise(
        F.concat(F.lit(SUMMARIZE_PROMPT), text)
    )
