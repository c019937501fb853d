"""Search: by substring and by vector similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from docmill.fixed_values import HIT_PREVIEW_CHARS, SEARCH_K
from docmill.functions.text import preview
from docmill.functions.vectors import cosine, embed
from docmill.session import work_dir

BROADCAST_HITS = 500_000


def _positive(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def contains_search(docs: DataFrame, query: str, k: int = SEARCH_K) -> DataFrame:
    """First ``k`` documents, by ``doc_id``, whose text contains the query in any
    case. An empty query finds nothing."""
    if not query:
        return docs.select("doc_id", "text").limit(0)
    found = F.contains(F.lower("text"), F.lower(F.lit(query)))
    return docs.filter(found).orderBy("doc_id").limit(_positive(k)).select("doc_id", "text")


def score_against(corpus: DataFrame, vector: Sequence[float]) -> DataFrame:
    """``(doc_id, score)`` of every vector of the query's length."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.filter(F.size("vector") == len(vector)).select(
        "doc_id", cosine(F.col("vector").cast("array<double>"), query).alias("score")
    )


def similar_to(corpus: DataFrame, vector: Sequence[float], k: int = SEARCH_K) -> DataFrame:
    """Top ``k`` of ``corpus (doc_id, vector)`` for one query vector.

    Planned as ``TakeOrderedAndProject``: each task keeps ``k`` rows. Ties go by
    ``doc_id``.
    """
    return score_against(corpus, vector).orderBy(F.desc("score"), "doc_id").limit(_positive(k))


def embed_queries(queries: DataFrame) -> DataFrame:
    """``(query_id, query[, k])`` with its ``vector``; empty queries drop out."""
    return queries.filter(F.coalesce("query", F.lit("")) != "").withColumn(
        "vector", embed(F.col("query"))
    )


def top_similar(
    corpus: DataFrame, queries: DataFrame, k: int = SEARCH_K, block_bytes: int = 32 << 20
) -> DataFrame:
    """Exact top ``k`` of the corpus for every row of a query table.

    ``corpus (doc_id, vector)``, ``queries (query_id, vector[, k])``; a null or
    missing ``k`` takes the default. Returns ``(query_id, rank, doc_id, score)``.

    The corpus is neither shuffled nor paired with the queries row by row. Each
    task multiplies Arrow batches of vectors with a block of query vectors and
    keeps the ``k`` best per query, so at most ``k`` rows per query and task
    reach the shuffle. A block holds about ``block_bytes`` of query vectors; a
    larger query table is handled exactly, one corpus scan per block, each block's
    hits being written to the work folder before the next block is read.
    """
    _positive(k)
    wanted = F.coalesce("k", F.lit(k)) if "k" in queries.columns else F.lit(k)
    asked = queries.select(
        "query_id", F.col("vector").cast("array<double>").alias("vector"),
        wanted.cast("int").alias("k"),
    ).filter((F.size("vector") > 0) & (F.col("k") > 0))
    size = asked.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))

    id_type = corpus.schema["doc_id"].dataType
    query_type = queries.schema["query_id"].dataType
    partial = T.StructType([
        T.StructField("query_id", query_type),
        T.StructField("doc_id", id_type),
        T.StructField("score", T.DoubleType()),
        T.StructField("k", T.IntegerType()),
    ])
    # empty vectors match no query and need no filter; one would be pushed below
    # the embedding and compute it twice
    vectors = corpus.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def hits_of(block: Broadcast) -> DataFrame:
        return (
            vectors.mapInArrow(_block_scan(block), partial)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= F.col("k"))
            .select("query_id", "rank", "doc_id", "score")
        )

    if n_blocks == 1:
        return hits_of(_share_block(asked))
    spark = corpus.sparkSession
    folder = work_dir(spark, "hits")
    for number in range(n_blocks):
        block = _share_block(asked.filter(block_of == number))
        hits_of(block).write.mode("append").parquet(folder)
        block.destroy()
    return spark.read.parquet(folder)


def _share_block(block: DataFrame) -> Broadcast:
    """Broadcast one block of queries: ids, ``k`` and vectors grouped by length.
    Its size is bounded by the block size."""
    table = block.toArrow()
    by_length: dict[int, list[int]] = {}
    vectors = table.column("vector").to_pylist()
    for row, vector in enumerate(vectors):
        by_length.setdefault(len(vector), []).append(row)
    groups = {
        length: (rows, np.array([vectors[r] for r in rows]))
        for length, rows in by_length.items()
    }
    return block.sparkSession.sparkContext.broadcast(
        (table.column("query_id").combine_chunks(), table.column("k").to_pylist(), groups)
    )


def _block_scan(block: Broadcast):
    """The per-task function that scans vectors for one block of queries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, ks, groups = block.value
        best: list[list] = [[] for _ in ks]
        floor = np.full(len(ks), -np.inf)
        id_field = None
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            id_field = batch.schema.field(0).type
            offsets = column.offsets.to_numpy()
            lengths = np.diff(offsets)
            values = column.values.to_numpy(zero_copy_only=False)
            for length, (rows, queries) in groups.items():
                at = np.flatnonzero(lengths == length)
                if not at.size:
                    continue
                docs = values[(offsets[at][:, None] + np.arange(length))]
                doc_norms = np.sqrt(np.einsum("nd,nd->n", docs, docs))
                # tiles of queries keep the score matrix small
                for start in range(0, len(rows), 128):
                    tile_rows = np.array(rows[start:start + 128])
                    tile = queries[start:start + 128]
                    # einsum, not BLAS: equal vectors must get equal scores
                    # wherever they stand in the batch
                    dots = np.einsum("qd,nd->qn", tile, docs)
                    norms = np.outer(np.sqrt(np.einsum("qd,qd->q", tile, tile)), doc_norms)
                    scores = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
                    improving = scores.max(axis=1) >= floor[tile_rows]
                    for j in np.flatnonzero(improving):
                        row, k = tile_rows[j], ks[tile_rows[j]]
                        line = scores[j]
                        candidates = np.flatnonzero(line >= floor[row])
                        if candidates.size > k:
                            kth = np.partition(line[candidates], -k)[-k]
                            ties = candidates[line[candidates] == kth]
                            # copies of one vector may fill the batch: the
                            # smallest ids of them are all that can rank
                            first = pc.select_k_unstable(
                                ids.take(pa.array(at[ties])), k, [("", "ascending")]
                            ).to_numpy()
                            above = candidates[line[candidates] > kth]
                            candidates = np.concatenate([above, ties[first]])
                        found = ids.take(pa.array(at[candidates])).to_pylist()
                        merged = sorted(
                            best[row] + list(zip((-line[candidates]).tolist(), found))
                        )[:k]
                        best[row] = merged
                        if len(merged) == k:
                            floor[row] = -merged[-1][0]
        found = [
            (row, doc_id, -negated, ks[row])
            for row, hits in enumerate(best) for negated, doc_id in hits
        ]
        if found:
            row, doc_id, score, k = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(row)), pa.array(doc_id, id_field),
                 pa.array(score, pa.float64()), pa.array(k, pa.int32())],
                names=["query_id", "doc_id", "score", "k"],
            )

    return scan


def expand_hits(hits: DataFrame, documents: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Hits with the file name and a text preview of their documents.

    The store is first cut to the documents that were hit, then joined. Where
    ``max_hits`` proves the hits few (queries times ``k``), their ids are
    broadcast and the store is not shuffled; else only ids, names and previews
    are. A hit whose document is gone keeps a null file name and an empty preview.
    """
    ids = hits.select("doc_id").distinct()
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        ids = F.broadcast(ids)
    previews = documents.select(
        "doc_id", "filename", preview(F.col("text"), HIT_PREVIEW_CHARS).alias("text_preview")
    )
    return hits.join(previews.join(ids, "doc_id", "left_semi"), "doc_id", "left").withColumn(
        "text_preview", F.coalesce("text_preview", F.lit(""))
    )
