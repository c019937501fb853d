import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators.search import (
    contains_search, embed_queries, expand_hits, similar_to, top_similar,
)
from docmill.plans.search import search_documents
from docmill.functions.vectors import embed_or_empty


def ranked(vectors, query, k):
    """Brute force over a dict id -> vector."""
    def score(v):
        v, q = np.array(v), np.array(query)
        size = np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())
        return (v * q).sum() / size if size else 0.0
    same = [(i, score(v)) for i, v in vectors.items() if len(v) == len(query)]
    return [i for i, _ in sorted(same, key=lambda x: (-round(x[1], 12), x[0]))[:k]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    vectors = {f"d{i:04d}": rng.normal(size=6).round(3).tolist() for i in range(900)}
    copy = vectors["d0005"]
    vectors |= {f"c{i:04d}": copy for i in range(450)}  # a third of the corpus is one vector
    vectors |= {"empty": [], "zero": [0.0] * 6, "short": [1.0, 2.0]}
    df = spark.createDataFrame(list(vectors.items()), "doc_id string, vector array<double>")
    return df.repartition(5), vectors


@pytest.mark.parametrize("block_bytes", [32 << 20, 200])
def test_top_similar_equals_brute_force(spark, corpus, block_bytes):
    df, vectors = corpus
    rng = np.random.default_rng(4)
    queries = {i: rng.normal(size=6).tolist() for i in range(8)}
    queries |= {8: vectors["d0005"], 9: [0.0] * 6, 10: [2.0, 1.0], 11: [1.0, 2.0, 3.0], 12: []}
    table = spark.createDataFrame(list(queries.items()), "query_id int, vector array<double>")
    got = {}
    for r in top_similar(df, table, k=7, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
        assert r["rank"] == len(got[r.query_id])
    expected = {q: ranked(vectors, v, 7) for q, v in queries.items() if v}
    assert got == {q: hits for q, hits in expected.items() if hits}
    assert got[8][0] == "c0000"


def test_one_query_equals_the_batch(corpus):
    df, vectors = corpus
    hits = [r.doc_id for r in similar_to(df, vectors["d0007"], k=9).collect()]
    assert hits == ranked(vectors, vectors["d0007"], 9)


def test_k_per_query_and_negative_k(spark, corpus):
    df, vectors = corpus
    table = spark.createDataFrame(
        [(1, vectors["d0001"], 2), (2, vectors["d0002"], None), (3, vectors["d0003"], 0)],
        "query_id int, vector array<double>, k int")
    counts = {r.query_id: r["count"] for r in top_similar(df, table).groupBy("query_id").count().collect()}
    assert counts == {1: 2, 2: 5}
    with pytest.raises(ValueError):
        top_similar(df, table, k=-1)


def test_search_end_to_end(spark):
    docs = spark.createDataFrame(
        [("a", "f1", "alpha " * 100), ("b", "f2", "beta"), ("c", None, "")],
        "doc_id string, filename string, text string",
    ).withColumn("vector", embed_or_empty(F.col("text")))
    queries = spark.createDataFrame([(1, "beta", None), (2, "", None)], "query_id int, query string, k int")
    rows = search_documents(docs, queries).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["b", "a"] and rows[0].score == pytest.approx(1.0)
    assert rows[1].text_preview == ("alpha " * 100)[:400]
    assert embed_queries(queries).count() == 1


def test_missing_document_keeps_its_hit(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "gone")], "query_id int, rank int, doc_id string")
    docs = spark.createDataFrame([("a", "f", None)], "doc_id string, filename string, text string")
    rows = {r.doc_id: (r.filename, r.text_preview) for r in expand_hits(hits, docs).collect()}
    assert rows == {"a": ("f", ""), "gone": (None, "")}


def test_contains_search(spark):
    docs = spark.createDataFrame([(3, "The LAW"), (1, "law"), (2, "x"), (4, "lawyer")], "doc_id int, text string")
    assert [r.doc_id for r in contains_search(docs, "Law", 2).collect()] == [1, 3]
    assert contains_search(docs, "").count() == 0
    with pytest.raises(ValueError):
        contains_search(docs, "law", -1)
