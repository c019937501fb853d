"""Every registered query against its SQL, and the shapes of the plans."""

import re

import pytest

import __spark_entry__ as contract
from tools.check import compare, connect
from docmill.operators import lexical
from workload import ORACLES, QUERIES
from workload.extraction import lemma_table
from workload.registry import documents


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, sf, name):
    assert compare(spark, duck, name, sf) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)
    assert contract.entry(spark).count() == 200


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not re.match(r"io(4|8|9|1[023])|ag1_maintained|pf[23]_(store|index)", n)])
def test_no_query_pairs_rows_without_a_key(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_top_k_and_pushdown(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["vs2_cosine_top"](spark, sf))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["pf3_contains_search"](spark, sf))
    assert "EqualTo(doc_id,7)" in plan_of(QUERIES["pf2_by_id"](spark, sf))
    assert "EqualNullSafe(lang,en)" in plan_of(QUERIES["pf1_find"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(QUERIES["io1_file_type"](spark, sf))
    assert "WindowGroupLimit" in plan_of(QUERIES["pf3_index_search"](spark, sf))


@pytest.mark.parametrize("name", ["tk1_top_keywords", "tk1_top_keywords_lemmas", "ag7_token_counts", "tx2_lemmatize", "tx3_keyword_tokens", "sm1_frequency_summary",
                                  "ex8_gazetteer_entities", "ex8_longest_mentions", "ex9_page_mentions", "sc1_legality_score"])
def test_words_are_counted_inside_rows(spark, sf, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf))


def test_plans_on_many_files(spark, sf, tmp_path):
    """The plan of a query doesn't depend on how small its input is."""
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(6).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("ex1_emails", "tk1_top_keywords", "sm1_frequency_summary"):
        def shape(folder):
            return re.findall(r"\b(?:Exchange|SortMergeJoin|BroadcastHashJoin|Window|Generate)\b", plan_of(QUERIES[name](spark, folder)))
        assert shape(str(tmp_path)) == shape(sf), name


def test_word_operators_share_one_text_shuffle(spark, sf, monkeypatch):
    """With lemmas too many to be broadcast."""
    monkeypatch.setattr(lexical, "is_small", lambda d: False)
    df = lexical.frequency_summary(documents(spark, sf), lemmas=lemma_table(spark, sf))
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    # the explicit one of (doc_id, text); the others carry words and places
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\), REPARTITION", re.sub(r"ReusedExchange.*", "", final))) == 1
