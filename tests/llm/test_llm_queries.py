"""The registered queries on the given tables, and the pipeline."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm.op2_mix import mix
from docmill.llm.queries import ORACLES, QUERIES
from docmill.llm.stages import mix_sources
from tests.llm import cases
from tests.llm.cases import DOCS, documents
from tools.check import connect, normal


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    import __spark_entry__ as contract

    assert contract.queries()[name] is QUERIES[name] and contract.oracle_sql()[name] == ORACLES[name]
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    want = normal([c[0] for c in cursor.description], cursor.fetchall())
    assert want[1] and normal(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_operator_has_one_query():
    import __spark_entry__ as contract

    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", ["op4_licenses", "op6_exact_dedup"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_jaccard_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op5_jaccard_join"](spark, sf).collect()), key=repr)
    assert got == cases.jaccard_groups([tuple(r) for r in docs], 3, 90)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for (name, stage), least in zip(corpus_pipeline.STAGES, (0.85, 1.0, 0.9, 0.3, 1.0)):
        after = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.dtypes == docs.dtypes
        docs = corpus_pipeline.store(after, "test-stage")
        assert docs.count() >= least * before, name
        before = docs.count()
    assert docs.where("not exact").count() == 0


def test_stages_on_hostile_documents(spark, sf):
    for rows in (DOCS, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.store(stage(spark, docs, sf), "test-stage")
            assert after.dtypes == docs.dtypes, name
            assert after.where(" or ".join(f"`{c}` <> 'clash'" for c in cases.CLASHES)).count() == 0, name
            assert after.where("n_chars <> length(text)").count() == 0
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_mixing_rows_with_null_and_repeated_ids(spark, sf):
    rows = [(None, f"text {k} " * (1 + k % 3), "en", "a") for k in range(30)] + [(None, "same words", "en", "a")] * 20 \
        + [(7, "one " * k, "en", "b") for k in range(1, 9)] + [(7, "one", None, None)] * 4 + [(8, "", "en", "b"), (9, None, "en", "c")]
    docs = documents(spark, rows)
    taken = Counter()
    for r in mix(docs.select("doc_id", "source", "text").withColumn("whole", F.struct("doc_id", "text")), carry="whole").collect():
        if r.taken:
            taken[r.doc_id, r.whole.text] += -(-r.taken // r.size)
    got = Counter((r.doc_id, r.text) for r in mix_sources(spark, docs, sf).collect())
    assert got and got == taken


def test_mixing_repeats_documents(spark, sf):
    docs = documents(spark, [(k, "one two three", "en", s) for k, s in enumerate("aaaabbbbcccc")]) \
        .select("doc_id", "text", "lang", "source", "n_chars")
    counts = {r.source: r["count"] for r in mix_sources(spark, docs, sf).groupBy("source").count().collect()}
    assert counts == {"a": 8, "b": 3, "c": 2}
