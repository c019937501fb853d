"""Trigram posting lists against a plain scan."""

import random

import pytest

from docmill.sources import substring_index
from docmill.sources.substring_index import candidates, search


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(k, "".join(rng.choices("abcAB é😀\n", k=rng.randrange(30)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "x"), (903, "xy"), (904, "İstanbul STRASSE"), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index"))
    substring_index.build(df, path)
    return df, path, {d: t for d, t in rows if d is not None and t is not None}


SOUGHT = ["a", "B", "ab", "xy", "x", "y", "ABC", "abca", "é😀", "cab ", "zzz", "", None, "stras", "x\0", "aaaa", "\n", "i\u0307"]


@pytest.mark.parametrize("k, rarest", [(3, 4), (1000, 1)])
def test_hits_are_those_of_a_scan(spark, corpus, k, rarest):
    df, path, texts = corpus
    queries = spark.createDataFrame(list(enumerate(SOUGHT)) + [(None, "a")], "query_id long, query string")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in search(df, path, queries, k, rarest).collect())
    want = []
    for n, q in enumerate(SOUGHT):
        hits = sorted(d for d, t in texts.items() if q and q.lower() in t.lower())[:k]
        want += [(n, rank, d) for rank, d in enumerate(hits, 1)]
    assert got == sorted(want)


def test_postings_are_intersected(spark, corpus):
    df, path, texts = corpus
    queries = spark.createDataFrame([(1, "abc"), (2, "abcabc")], "query_id long, query string")
    found = {(r.query_id, r.doc_id) for r in candidates(spark, path, queries).collect()}
    assert {d for q, d in found if q == 1} == {d for d, t in texts.items() if "abc" in t.lower()}
    assert {d for q, d in found if q == 2} == {d for d, t in texts.items() if all(g in t.lower() for g in ("abc", "bca", "cab"))}


def test_a_lookup_tells_the_scan_its_trigrams(spark, corpus):
    df, path, _ = corpus
    plan = candidates(spark, path, spark.createDataFrame([(1, "abca")], "query_id long, query string"))
    assert "In(gram, [" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        search(df, path, spark.createDataFrame([(1, "a")], "query_id long, query string"), -1)


def test_tasks_gather_posting_lists_before_the_shuffle(spark, tmp_path):
    docs = spark.range(0, 3000, numPartitions=3).selectExpr("id as doc_id", "'one and the same text' as text")
    substring_index.build(docs, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/postings")
    entries = rows.selectExpr("gram", "explode(docs) as doc_id")
    assert entries.count() == entries.distinct().count() == 3000 * len("one and the same text")
    assert rows.count() <= entries.count() / 100 and rows.selectExpr("max(size(docs))").first()[0] <= substring_index.PIECE
