import pytest
from pyspark.sql import functions as F

from docmill import schemas
from docmill.fixed_values import CLAUSE_KEYWORDS
from docmill.functions import files as file_functions
from docmill.operators import corpus, pages, records, summaries
from docmill.operators.annotate import annotate
from docmill.plans.analyze import analyze
from docmill.plans.corpus_report import corpus_report


def test_file_names(spark):
    df = spark.createDataFrame([(n,) for n in ("pdf", "a.b.PDF", "nodot", "x.tiff", "", "a.", None)], "n string")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "n", file_functions.file_type(F.col("n")), file_functions.route(F.col("n"))).collect()}
    assert got == {"pdf": ("pdf", "text"), "a.b.PDF": ("pdf", "pdf"), "nodot": ("unknown", "text"),
                   "x.tiff": ("unknown", "image"), "": ("unknown", "text"), "a.": ("unknown", "text"),
                   None: ("unknown", "text")}


def test_bulk_records_keep_their_place(spark):
    texts = spark.createDataFrame([(0, "abc"), (1, ""), (2, "x" * 101)], "pos int, text string")
    rows = records.basic_records(texts).orderBy("pos").collect()
    assert (rows[0].original, rows[0].length, rows[0].summary, rows[0].error) == ("abc", 3, "abc", None)
    assert (rows[1].original, rows[1].error) == (None, "Empty document")
    assert rows[2].summary == "x" * 100 + "..."


def test_find_matches_nested_fields_and_nulls(spark):
    df = spark.sql("select * from values (1, named_struct('t', 'pdf')), (2, named_struct('t', null)) as x(id, a)")
    assert [r.id for r in records.find(df, {"a.t": "pdf"}).collect()] == [1]
    assert [r.id for r in records.find(df, {"a.t": None}).collect()] == [2]
    assert records.find(df, {}).count() == 2


def test_ocr_fills_blank_pages_only(spark):
    p = spark.createDataFrame([("d", 1, "x"), ("d", 2, " \n"), ("d", 3, "")], "doc_id string, page int, text string")
    o = spark.createDataFrame([("d", 1, "no"), ("d", 2, "ocr")], "doc_id string, page int, ocr_text string")
    got = {r.page: (r.text, r.needs_ocr) for r in pages.fill_from_ocr(p, o).collect()}
    assert got == {1: ("x", False), 2: ("ocr", False), 3: ("", True)}


def test_page_tags(spark):
    p = spark.createDataFrame([(" The CONTRACT date\n",), ("rename",), ("",)], "text string")
    assert [(r.text, r.entities) for r in pages.page_tags(p).collect()] == [
        ("The CONTRACT date", ["Date", "Contract"]), ("rename", ["Name"]), ("", [])]


def test_annotator_isolates_failures_and_loads_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def factory():
        loads.add(1)
        def model(rows):
            if any(x == "bad" for x, _ in rows):
                raise ValueError("bad row")
            return [f"{x}{y}" for x, y in rows]
        return model

    df = spark.createDataFrame([("a", "1"), ("bad", "2"), (None, None), ("c", "3")], "x string, y string").coalesce(1)
    rows = annotate(df, factory, ["x", "y"], "v string", skip_null=True).collect()
    assert [(r.v, r.error) for r in rows] == [
        ("a1", None), (None, "ValueError: bad row"), (None, None), ("c3", None)]
    assert loads.value == 1


def test_annotator_demands_one_value_per_row(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string").coalesce(1)
    rows = annotate(df, lambda: lambda rows: ["only"], ["x"], "v string").collect()
    assert [r.v for r in rows] == ["only", "only"]  # row by row, each call gives one


def test_annotator_keeps_types_and_survives_a_model_that_cannot_load(spark):
    df = spark.createDataFrame([(5, "old"), (None, "old")], "x int, error string").coalesce(1)
    rows = annotate(df, lambda: lambda rows: [repr(x) for x, in rows], ["x"], "v string").collect()
    assert [(r.x, r.v, r.error) for r in rows] == [(5, "5", None), (None, "None", None)]

    def broken():
        raise OSError("no weights")

    rows = annotate(df, broken, ["x"], "v string", skip_null=True, error="failure").collect()
    assert [(r.v, r.failure, r.error) for r in rows] == [(None, "OSError: no weights", "old"), (None, None, "old")]


def test_summary_falls_back_when_the_model_fails_on_a_chunk(spark):
    text = "First one here. " * 100
    df = spark.createDataFrame([(1, text), (2, "Fine text.")], "doc_id int, text string")

    def factory():
        def model(rows):
            if any(len(t) > 800 for (t,) in rows):
                raise RuntimeError
            return ["S" for _ in rows]
        return model

    got = {r.doc_id: r.summary for r in summaries.summarize(df, factory).collect()}
    assert got == {1: " ".join(["First one here."] * 5), 2: "S"}


def test_requested_summaries(spark):
    docs = spark.createDataFrame([("a", "Stored text."), ("n", None)], "doc_id string, text string")
    reqs = spark.createDataFrame(
        [(1, "a", "given"), (2, None, "Given text."), (3, "zz", "given"), (4, "", ""), (5, "a", None), (6, "n", None)],
        "request_id int, doc_id string, text string")
    done, rejected = summaries.requested_summaries(reqs, docs)
    assert {(r.request_id, r.summary) for r in done.collect()} == {
        (1, "Stored text."), (2, "Given text."), (5, "Stored text."), (6, "")}
    assert {(r.request_id, r.error) for r in rejected.collect()} == {
        (3, "Document not found"), (4, "Provide doc_id or text parameter")}


@pytest.fixture(scope="module")
def analyses(spark):
    docs = spark.createDataFrame(
        [("1", "a.pdf", ["Ann Bell signed. Payment due", "payment. Mail x@y.org"]),
         ("2", "b.docx", [" "]), ("3", "c.PDF", ["agreement call 123456789", "123456789 x@y.org x@y.org"])],
        "doc_id string, filename string, pages array<string>")
    replies = spark.createDataFrame([("1", '{"status":"LEGAL","confidence":88}')], "doc_id string, raw string")
    people = spark.createDataFrame([("Ann Bell", "PERSON"), ("Mail", "ORG")], "surface string, label string")
    return analyze(docs, replies=replies, gazetteer=people)


def test_analysis_record(analyses):
    assert analyses.schema.simpleString() == schemas.ANALYSIS.simpleString()
    one, two, three = analyses.orderBy("doc_id").collect()
    a = one.analytics
    assert (a.total_names, a.total_clauses, a.total_emails, a.total_phones) == (1, 2, 1, 0)
    assert a.legality_score == 2 + 8 + 2 and a.ai_confidence == 88
    assert a.chart_data.combined_confidence == 88 and a.total_pages == 2
    assert one.results[0].names == ["Ann Bell"] and one.results[1].organizations == ["Mail"]
    assert one.results[1].page == 2 and one.results[0].clauses_found == ["payment"]
    assert [k.lemma for k in a.keyword_frequency][:1] == ["payment"]
    assert two.analytics.summary == "No summary available." and two.analytics.keyword_frequency == []
    assert two.analytics.legality_score == 0 and two.analytics.ai_confidence is None
    # the phone runs across the page break; the pages hold their own
    assert three.analytics.total_phones == 1
    assert three.results[0].phones == ["123456789"] and three.results[1].emails == ["x@y.org"] * 2
    assert three.analytics.file_type == "pdf"


def test_corpus_report(spark, analyses):
    r = corpus_report(analyses).first()
    scores = sorted(x.analytics.legality_score for x in analyses.collect())
    assert r.total_documents == 3 and r.file_types == {"pdf": 2, "docx": 1}
    assert sorted(s for s, n in r.score_counts.items() for _ in range(n)) == scores
    assert r.average_legality_score == round(sum(scores) / 3, 2)
    assert set(r.clause_frequency) == set(CLAUSE_KEYWORDS) and r.clause_frequency["payment"] == 2
    assert [x.legality_score for x in corpus.scores(analyses).collect()] == scores


def test_empty_corpus(spark, analyses):
    r = corpus_report(analyses.filter("false")).first()
    assert (r.total_documents, r.total_pages, r.average_legality_score, r.file_types) == (0, 0, 0.0, {})
    assert corpus.totals(analyses.filter("false")).first().average_legality_score == 0.0
