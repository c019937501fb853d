"""Queries: whole analyses and corpus-level aggregates."""

from pyspark.sql import functions as F

from docmill.fixed_values import ACCEPTED_TYPES, CLAUSE_KEYWORDS
from docmill.functions import files as file_functions
from docmill.operators import corpus, pages as pages_op
from docmill.plans.analyze import analyze, rule_scores
from docmill.plans.corpus_report import corpus_report
from docmill.session import work_dir
from docmill.sources import summary
from workload.extraction import (
    ENTITIES, GAZETTEER, MENTIONS, NAMES, TOTAL_CLAUSES, VERDICTS, COUNTS, gazetteer, _counts_sql, _present_sql,
)
from workload.registry import (
    DOCS, ORACLES, FILENAME, TEXT, REPLY, documents, query, sql_emails, sql_list, sql_not_blank, sql_phones, sql_signers,
)
from workload.summaries import FREQUENCY_SUMMARY

_EXT = "lower(regexp_extract(filename, '[^.]*$'))"
_TYPE = f"CASE WHEN {_EXT} IN ({sql_list(ACCEPTED_TYPES)}) THEN {_EXT} ELSE 'unknown' END"

# analyses without names, summaries and keywords: what one scan gives
ANALYSES = f"""{DOCS}, c AS (SELECT doc_id, {_TYPE} AS file_type,
 len(list_filter(string_split(text, chr(10)), lambda p: {sql_not_blank('p')})) AS total_pages, 0 AS total_names,
 len(list_distinct({sql_emails('text')})) AS total_emails, len(list_distinct({sql_phones('text')})) AS total_phones,
 len(list_distinct({sql_signers('text')})) AS total_signers, {TOTAL_CLAUSES} AS total_clauses FROM d),
s AS (SELECT *, least(100, least(40, 2 * total_names) + least(30, 4 * total_clauses)
 + least(30, 2 * (total_emails + total_phones))) AS legality_score FROM c)"""


def analyses(spark, sf_dir):
    """Stored records, with some fields missing as in old ones."""
    docs = documents(spark, sf_dir).withColumns({
        "file_type": file_functions.file_type(F.col("filename")),
        "total_pages": F.size(pages_op.paragraphs(F.col("text"))),
    })
    scored = rule_scores(docs).withColumns({
        "total_names": F.lit(None).cast("int"),
        "file_type": F.nullif(F.col("file_type"), F.lit("unknown")),
    })
    fields = [c for c in scored.columns if c not in ("doc_id", "filename")]
    return scored.select("doc_id", "filename", F.struct(*fields).alias("analytics"))


TOTALS = "count(*) AS total_documents, " + ", ".join(f"cast(sum({t}) AS bigint) AS {t}" for t in corpus.TOTALS)
# printf rounds the exact binary value, ties to even
MEAN = "cast(printf('%.2f', sum(legality_score) / count(*)) AS double) AS average_legality_score"


@query("ag1_totals", f"WITH {ANALYSES} SELECT {TOTALS} FROM s")
def totals(spark, sf_dir):
    return corpus.totals(analyses(spark, sf_dir)).drop("average_legality_score")


@query("ag2_scores", f"WITH {ANALYSES} SELECT cast(legality_score AS bigint) AS legality_score FROM s")
def scores(spark, sf_dir):
    return corpus.scores(analyses(spark, sf_dir)).select(F.col("legality_score").cast("bigint"))


@query("ag2_score_counts", f"WITH {ANALYSES} SELECT cast(legality_score AS bigint) AS legality_score, count(*) AS n FROM s GROUP BY legality_score")
def score_counts(spark, sf_dir):
    return corpus.score_counts(analyses(spark, sf_dir)).withColumn(
        "legality_score", F.col("legality_score").cast("bigint"))


@query("ag3_mean_score", f"WITH {ANALYSES} SELECT {MEAN} FROM s")
def mean_score(spark, sf_dir):
    return corpus.totals(analyses(spark, sf_dir)).select("average_legality_score")


@query("ag4_file_types", f"WITH {ANALYSES} SELECT file_type, count(*) AS n FROM s GROUP BY file_type")
def file_types(spark, sf_dir):
    return corpus.file_types(analyses(spark, sf_dir))


@query("ag5_clause_frequency", f"WITH {DOCS}, k AS ({_counts_sql('d', CLAUSE_KEYWORDS)}) SELECT clause, cast(sum(n) AS bigint) AS n FROM k GROUP BY clause")
def clause_frequency(spark, sf_dir):
    return corpus.clause_frequency(analyses(spark, sf_dir))


def _map_text(column):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), "|")


def _map_sql(source, key):
    return f"(SELECT string_agg({key} || '=' || cast(n AS string), '|' ORDER BY {key}) FROM {source})"


@query("corpus_report", f"""WITH {ANALYSES}, k AS ({_counts_sql('d', CLAUSE_KEYWORDS)}),
cf AS (SELECT clause, cast(sum(n) AS bigint) AS n FROM k GROUP BY clause),
ft AS (SELECT file_type, count(*) AS n FROM s GROUP BY file_type),
sc AS (SELECT cast(legality_score AS int) AS score, count(*) AS n FROM s GROUP BY legality_score)
SELECT {TOTALS}, {MEAN}, {_map_sql('ft', 'file_type')} AS file_types,
 (SELECT string_agg(cast(score AS string) || '=' || cast(n AS string), '|' ORDER BY score) FROM sc) AS score_counts,
 {_map_sql('cf', 'clause')} AS clause_frequency FROM s""")
def report(spark, sf_dir):
    return _report_text(corpus_report(analyses(spark, sf_dir)))


def _report_text(r):
    return r.select(
        "total_documents", *corpus.TOTALS, "average_legality_score",
        *[_map_text(F.col(c)).alias(c) for c in ("file_types", "score_counts", "clause_frequency")])


@query("ag1_maintained_report", ORACLES["corpus_report"])
def maintained_report(spark, sf_dir):
    """The same report from changes: outdated records first, which two later batches
    replace, one of them repeated, with a compaction between. The records are analysed
    once and stored, as the batches would come from a store of analyses."""
    root = work_dir(spark, "ag1")
    analyses(spark, sf_dir).select("doc_id", "analytics").write.parquet(f"{root}/analyses")
    true = spark.read.parquet(f"{root}/analyses")
    outdated = true.withColumn("analytics", F.col("analytics").withField("total_emails", F.lit(9)).withField("file_type", F.lit("old"))
                               .withField("legality_score", F.col("doc_id").cast("int") % 101))
    third = F.col("doc_id") % 3 == 0
    summary.commit(outdated, root, 0)
    summary.commit(true.filter(~third), root, 1)
    summary.compact(spark, root)
    summary.commit(outdated.filter(third), root, 2)
    summary.commit(true.filter(third), root, 2)
    return _report_text(summary.report(spark, root))


# The whole upload job, on lines as pages.
JOINED = f"""d0 AS (SELECT doc_id, {TEXT} AS t, {FILENAME} AS filename, {REPLY} AS raw FROM documents),
d AS (SELECT doc_id, filename, raw, list_filter(string_split(t, chr(10)), lambda p: {sql_not_blank('p')}) AS pages,
 array_to_string(list_filter(string_split(t, chr(10)), lambda p: {sql_not_blank('p')}), chr(10)) AS text FROM d0)"""


@query("analyze_documents", f"""WITH RECURSIVE {JOINED}, {GAZETTEER}, {ENTITIES}, {MENTIONS}, {NAMES.replace("FROM e ", "FROM m ")}, {VERDICTS}, {FREQUENCY_SUMMARY}, {COUNTS},
kw AS (SELECT doc_id, lemma, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM n),
ka AS (SELECT doc_id, string_agg(lemma || '=' || cast(n AS string), '|' ORDER BY rank) AS keywords FROM kw WHERE rank <= 10 GROUP BY doc_id),
pp AS (SELECT doc_id, unnest(pages) AS text FROM d),
pc AS (SELECT doc_id, sum(len({sql_emails('text')})) AS page_emails, sum(len(string_split({_present_sql('text')}, '|')) - CASE WHEN {_present_sql('text')} = '' THEN 1 ELSE 0 END) AS page_clauses FROM pp GROUP BY doc_id),
c AS (SELECT d.doc_id, filename, {_TYPE} AS file_type, len(pages) AS total_pages, coalesce(total_names, 0) AS total_names,
 len(list_distinct({sql_emails('text')})) AS total_emails, len(list_distinct({sql_phones('text')})) AS total_phones,
 len(list_distinct({sql_signers('text')})) AS total_signers, {TOTAL_CLAUSES} AS total_clauses FROM d LEFT JOIN nm USING (doc_id)),
s AS (SELECT *, least(100, least(40, 2 * total_names) + least(30, 4 * total_clauses)
 + least(30, 2 * (total_emails + total_phones))) AS legality_score FROM c)
SELECT cast(s.doc_id AS string) AS doc_id, filename, file_type, total_pages, total_names, total_emails, total_phones, total_signers,
 total_clauses, legality_score, summary, coalesce(keywords, '') AS keywords, marker AS verified_marker, ai_confidence, raw AS openai_raw,
 coalesce(ai_confidence, legality_score) AS combined_confidence, cast(page_emails AS bigint) AS page_emails, cast(page_clauses AS bigint) AS page_clauses
FROM s JOIN fs ON s.doc_id = fs.doc_id LEFT JOIN ka ON s.doc_id = ka.doc_id JOIN v ON s.doc_id = v.doc_id JOIN pc ON s.doc_id = pc.doc_id""")
def analyzed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    records = analyze(
        docs.select("doc_id", "filename", pages_op.paragraphs(F.col("text")).alias("pages")),
        replies=docs.select("doc_id", "raw"),
        gazetteer=gazetteer(spark, sf_dir),
    )
    a = F.col("analytics")
    numbers = ("total_pages", "total_names", "total_emails", "total_phones", "total_signers",
               "total_clauses", "legality_score", "ai_confidence")
    return records.select(
        "doc_id", "filename", "analytics.file_type", "analytics.summary",
        *[a[n].cast("bigint").alias(n) for n in numbers],
        F.array_join(F.transform("analytics.keyword_frequency", lambda k: F.concat_ws(
            "=", k["lemma"], k["n"].cast("string"))), "|").alias("keywords"),
        "analytics.verified_marker", "analytics.openai_raw",
        a["chart_data"]["combined_confidence"].cast("bigint").alias("combined_confidence"),
        F.aggregate("results", F.lit(0), lambda n, r: n + F.size(r["emails"]))
        .cast("bigint").alias("page_emails"),
        F.aggregate("results", F.lit(0), lambda n, r: n + F.size(r["clauses_found"]))
        .cast("bigint").alias("page_clauses"),
    )
