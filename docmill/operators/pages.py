"""Pages of documents.

Two shapes are used: one row per document with ``pages array<string>``, which
needs no shuffle, and the long table ``(doc_id, page, text)``, page from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmill.fixed_values import CLAUSE_KEYWORDS, PAGE_TAGS
from docmill.functions import extract
from docmill.functions.text import is_blank, join_in_order, no_strings, strip


def paragraphs(text: Column) -> Column:
    """Non-blank lines; each counts as a page."""
    return F.filter(F.split(text, "\n"), lambda line: ~is_blank(line))


def explode_pages(docs: DataFrame) -> DataFrame:
    """``(doc_id, pages)`` to the long table."""
    return docs.select("doc_id", F.posexplode("pages").alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("page"), "text"
    )


def assemble(pages: DataFrame) -> DataFrame:
    """The long table to ``(doc_id, total_pages, text)``, pages joined by newline."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_pages"),
        join_in_order(F.col("page"), F.col("text"), "\n").alias("text"),
    )


def fill_from_ocr(pages: DataFrame, ocr_texts: DataFrame) -> DataFrame:
    """Blank pages take their OCR text; ``needs_ocr`` marks those still blank.

    Only the blank pages are joined, so no page text is shuffled. The page number
    is part of the key: a document with very many pages spreads over all tasks.
    """
    blank = is_blank(F.coalesce("text", F.lit("")))
    with_text = pages.filter(~blank).select("doc_id", "page", "text", F.lit(False).alias("needs_ocr"))
    filled = pages.filter(blank).join(ocr_texts, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.coalesce("ocr_text", "text").alias("text")
    ).withColumn("needs_ocr", is_blank(F.coalesce("text", F.lit(""))))
    return with_text.unionByName(filled)


def page_result(
    page: Column, text: Column, names: Column | None = None, organizations: Column | None = None,
    keywords: Sequence[str] = CLAUSE_KEYWORDS,
) -> Column:
    """Everything extracted from one page. Repeated values stay repeated."""
    return F.struct(
        page.cast("int").alias("page"),
        (no_strings() if names is None else F.coalesce(names, no_strings())).alias("names"),
        (no_strings() if organizations is None else F.coalesce(organizations, no_strings()))
        .alias("organizations"),
        extract.emails(text).alias("emails"),
        extract.phones(text).alias("phones"),
        extract.clauses_present(text, keywords).alias("clauses_found"),
        extract.signers(text).alias("signers"),
        text.alias("text"),
    )


def page_tags(pages: DataFrame) -> DataFrame:
    """Stripped page text with the tags whose word the text contains."""
    lowered = F.lower("text")
    tags = F.array_compact(F.array(
        *[F.when(F.contains(lowered, F.lit(word)), F.lit(tag)) for word, tag in PAGE_TAGS]
    ))
    return pages.withColumns({"text": strip(F.col("text")), "entities": tags})
