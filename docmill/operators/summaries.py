"""Summaries computed within one row, chunking, and the model hook around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmill.fixed_values import (
    CHUNK_ABOVE, CHUNK_CHARS, DOCUMENT_NOT_FOUND, HEURISTIC_BONUS, HEURISTIC_SENTENCES,
    NO_DOCUMENT_OR_TEXT, NOTHING_TO_ANSWER, NOTHING_TO_SUMMARIZE, SUMMARY_KEYWORDS,
)
from docmill.functions.text import is_blank, join_in_order, sentences, split_space
from docmill.operators.annotate import annotate
from docmill.session import broadcast_if_small


def heuristic_summary(
    text: Column, k: int = HEURISTIC_SENTENCES, keywords: Sequence[str] = SUMMARY_KEYWORDS,
    listed: Column | None = None,
) -> Column:
    """The ``k`` best sentences, best first: word count, plus a bonus for each
    keyword the sentence contains as a substring. Ties go by position. ``listed``
    gives the sentences if not the fixed rule shall (see ``boundaries.sentences``)."""
    def scored(sentence: Column, pos: Column) -> Column:
        score = F.size(split_space(sentence))
        lowered = F.lower(sentence)
        for kw in keywords:
            score = score + F.when(F.contains(lowered, F.lit(kw)), HEURISTIC_BONUS).otherwise(0)
        return F.struct((-score).alias("order"), pos.alias("pos"), sentence.alias("s"))

    best = F.slice(F.array_sort(F.transform(sentences(text) if listed is None else listed, scored)), 1, k)
    return F.array_join(F.transform(best, lambda x: x["s"]), " ")


def chunks(text: Column) -> Column:
    """The whole text if short, else pieces without overlap."""
    last = F.floor((F.length(text) - 1) / CHUNK_CHARS).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substr(text, i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)),
    )
    return F.when(F.length(text) <= CHUNK_ABOVE, F.array(text)).otherwise(pieces)


def model_summary(docs: DataFrame, factory: Callable) -> DataFrame:
    """``(doc_id, model_summary)``: summarise each chunk, join by a space.

    Null if the model failed on any chunk, so that callers can fall back.
    """
    pieces = docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    answered = annotate(pieces, factory, ["chunk"], "s string")
    return answered.groupBy("doc_id").agg(
        F.when(
            F.count("error") == 0, join_in_order(F.col("pos"), F.col("s"), " ")
        ).alias("model_summary")
    )


def summarize(docs: DataFrame, factory: Callable | None = None) -> DataFrame:
    """``(doc_id, summary)``: the model's summary, or the heuristic one if there
    is no model or it failed."""
    fallback = heuristic_summary(F.col("text"))
    if factory is None:
        return docs.select("doc_id", fallback.alias("summary"))
    return docs.join(model_summary(docs, factory), "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("model_summary"), fallback).alias("summary")
    )


def guarded_summary(docs: DataFrame, factory: Callable) -> DataFrame:
    """``docs`` with ``summary``; blank text gives a fixed warning instead."""
    blank = F.col("text").isNull() | is_blank(F.col("text"))
    asked = docs.withColumn("_asked", F.when(~blank, F.col("text")))
    out = annotate(asked, factory, ["_asked"], "summary string", skip_null=True)
    return out.withColumn(
        "summary", F.when(blank, NOTHING_TO_SUMMARIZE).otherwise(F.col("summary"))
    ).drop("_asked")


def guarded_answer(questions: DataFrame, factory: Callable) -> DataFrame:
    """``(.., text, question)`` with ``answer``; a missing text or question gives
    a fixed warning instead."""
    missing = (F.coalesce("text", F.lit("")) == "") | (F.coalesce("question", F.lit("")) == "")
    asked = questions.withColumns({
        "_text": F.when(~missing, F.col("text")),
        "_question": F.when(~missing, F.col("question")),
    })
    out = annotate(asked, factory, ["_text", "_question"], "answer string", skip_null=True)
    return out.withColumn(
        "answer", F.when(missing, NOTHING_TO_ANSWER).otherwise(F.col("answer"))
    ).drop("_text", "_question")


def requested_summaries(requests: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of stored documents or of given texts, and the rejected requests.

    ``requests (request_id, doc_id, text)``: a ``doc_id`` wins over a text. Each
    requested document is summarised once, however often it is asked for. The ids
    are broadcast if few, so that only those documents leave the store's scan.
    """
    wanted = F.coalesce("doc_id", F.lit("")) != ""
    ids = broadcast_if_small(requests.filter(wanted).select("doc_id").distinct(), 1_000_000)
    stored = documents.join(ids, "doc_id", "left_semi").select(
        "doc_id",
        F.lit(True).alias("found"),
        heuristic_summary(F.coalesce("text", F.lit(""))).alias("stored_summary"),
    )
    answered = requests.join(stored, "doc_id", "left")
    given = F.coalesce("text", F.lit("")) != ""
    error = (
        F.when(wanted & F.col("found").isNull(), DOCUMENT_NOT_FOUND)
        .when(~wanted & ~given, NO_DOCUMENT_OR_TEXT)
    )
    judged = answered.select(
        "request_id",
        F.when(wanted, F.col("stored_summary"))
        .otherwise(heuristic_summary(F.col("text"))).alias("summary"),
        error.alias("error"),
    )
    return (
        judged.filter(F.col("error").isNull()).drop("error"),
        judged.filter(F.col("error").isNotNull()).drop("summary"),
    )
