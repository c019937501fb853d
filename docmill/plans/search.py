"""Search a document store with a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.fixed_values import SEARCH_K
from docmill.operators.search import embed_queries, expand_hits, top_similar
from docmill.sources.store import ids_and_vectors


def search_documents(documents: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """``queries (query_id, query[, k])`` against a store; hits with previews.

    Returns ``query_id, rank, doc_id, score, filename, text_preview``.
    """
    wanted = F.coalesce("k", F.lit(k)) if "k" in queries.columns else F.lit(k)
    max_hits = queries.agg(F.sum(wanted)).first()[0] or 0
    hits = top_similar(ids_and_vectors(documents), embed_queries(queries), k)
    return expand_hits(hits, documents, max_hits).select(
        "query_id", "rank", "doc_id", "score", "filename", "text_preview"
    )
