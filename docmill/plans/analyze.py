"""Analyse documents: from page texts to stored analysis records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmill.fixed_values import CLAUSE_KEYWORDS, VERDICT_CHARS
from docmill.functions import extract, files, score
from docmill.functions.text import no_strings
from docmill.functions.verdict import parse_verdict
from docmill.operators import lexical, pages as pages_op
from docmill.schemas import ANALYSIS


def document_entities(text: Column, keywords: Sequence[str] = CLAUSE_KEYWORDS) -> dict[str, Column]:
    """Distinct values and clause counts of a whole text.

    Computed on the joined text, not from the pages: a match may cross a page
    break, and then no page holds it.
    """
    return {
        "emails": extract.distinct_sorted(extract.emails(text)),
        "phones": extract.distinct_sorted(extract.phones(text)),
        "dates": extract.distinct_sorted(extract.dates(text)),
        "signers": extract.distinct_sorted(extract.signers(text)),
        "clause_summary": extract.clause_counts(text, keywords),
    }


def rule_scores(docs: DataFrame, keywords: Sequence[str] = CLAUSE_KEYWORDS) -> DataFrame:
    """``(doc_id, text[, names, file_type, total_pages])`` to rows with the counts
    and the score, as far as they need no word counting. One scan, no shuffle."""
    names = F.size("names") if "names" in docs.columns else F.lit(0)
    kept = [c for c in ("filename", "file_type", "total_pages") if c in docs.columns]
    found = docs.select(
        "doc_id", *kept, names.alias("total_names"),
        *[c.alias(n) for n, c in document_entities(F.col("text"), keywords).items()],
    )
    counted = found.select(
        "doc_id", *kept, "total_names", "clause_summary",
        F.size("emails").alias("total_emails"),
        F.size("phones").alias("total_phones"),
        F.size("signers").alias("total_signers"),
        extract.total_clauses(F.col("clause_summary")).alias("total_clauses"),
    )
    return counted.withColumn("legality_score", score.legality_score(
        F.col("total_names"), F.col("total_clauses"), F.col("total_emails"), F.col("total_phones")
    ))


def analyze(
    docs: DataFrame,
    replies: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] = lexical.STOP_WORDS,
    keywords: Sequence[str] = CLAUSE_KEYWORDS,
    longest: bool = True,
) -> DataFrame:
    """``(doc_id, filename, pages array<string>)`` to analysis records.

    ``replies (doc_id, raw)`` are the model's verdicts and ``gazetteer (surface,
    label)`` supplies names and organisations, as mentions that don't overlap unless
    ``longest`` is off. With dictionaries that are small or none, all but the replies
    is computed in one scan of ``docs``, row by row; larger ones are joined on ``doc_id``.
    """
    text = F.array_join("pages", "\n", "")
    joined = docs.select("doc_id", "filename", "pages", text.alias("text"))
    joined = lexical.with_words(joined, stop_words, lemmas)
    if gazetteer is None:
        joined = joined.withColumn("names", no_strings())
        page_names = page_orgs = None
    else:
        known = lexical.dictionary(gazetteer)
        joined = lexical.with_names(joined, known, longest)
        if known.trie is not None:
            joined = joined.withColumn("page_entities", lexical.page_lists(F.col("pages"), known, longest))
        else:
            joined = joined.join(_page_entities(docs, known, longest), "doc_id", "left")

        def page_names(i):
            return F.get("page_entities", i)["names"]

        def page_orgs(i):
            return F.get("page_entities", i)["organizations"]

    if replies is None:
        joined = joined.withColumn("raw", F.lit(None).cast("string"))
    else:
        joined = joined.join(replies.select("doc_id", "raw"), "doc_id", "left")

    results = F.transform("pages", lambda text, i: pages_op.page_result(
        i + 1, text,
        None if page_names is None else page_names(i),
        None if page_orgs is None else page_orgs(i),
        keywords,
    ))
    found = joined.select(
        "doc_id", "filename", results.alias("results"), "keyword_frequency", "summary", "names",
        F.size("pages").alias("total_pages"),
        parse_verdict(F.col("raw")).alias("verdict"),
        *[c.alias(n) for n, c in document_entities(F.col("text"), keywords).items()],
    )
    counted = found.withColumns({
        "total_names": F.size("names"),
        "total_emails": F.size("emails"),
        "total_phones": F.size("phones"),
        "total_signers": F.size("signers"),
        "total_clauses": extract.total_clauses(F.col("clause_summary")),
        "file_type": files.file_type(F.col("filename")),
    }).withColumn("legality_score", score.legality_score(
        F.col("total_names"), F.col("total_clauses"), F.col("total_emails"), F.col("total_phones")
    ))
    analytics = F.struct(
        "clause_summary",
        F.coalesce(
            "keyword_frequency", F.expr("cast(array() as array<struct<rank:int,lemma:string,n:bigint>>)")
        ).alias("keyword_frequency"),
        "summary", "legality_score", "total_names", "total_emails", "total_phones",
        "total_signers", "total_clauses", "file_type", "total_pages",
        F.col("verdict.marker").alias("verified_marker"),
        F.col("verdict.ai_confidence").alias("ai_confidence"),
        F.substring(F.coalesce("verdict.raw", F.lit("")), 1, VERDICT_CHARS).alias("openai_raw"),
        score.chart_data(F.col("verdict.ai_confidence"), F.col("legality_score"))
        .alias("chart_data"),
    )
    return counted.select("doc_id", "filename", "results", analytics.alias("analytics")).to(ANALYSIS)


def _page_entities(docs: DataFrame, known: lexical.Dictionary, longest: bool) -> DataFrame:
    """``(doc_id, page_entities array<struct<names, organizations>>)``, one entry
    per page in page order, so that page ``i`` finds its own by position."""
    pages = pages_op.explode_pages(docs).select(
        F.struct("doc_id", "page").alias("doc_id"), "text"
    )
    found_in = lexical.longest_mentions if longest else lexical.gazetteer_entities
    lists = lexical.entity_lists(found_in(pages, known), distinct=False)
    found = lists.select("doc_id.doc_id", "doc_id.page", F.struct("names", "organizations").alias("e"))
    numbers = docs.select("doc_id", F.explode(F.transform("pages", lambda _, i: i + 1)).alias("page"))
    return numbers.join(found, ["doc_id", "page"], "left").groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page", "e"))), lambda x: x["e"]
        ).alias("page_entities")
    )
