"""Queries: vectors and search."""

from pyspark.sql import functions as F

from docmill.functions.vectors import embed, embed_or_empty
from docmill.operators.records import basic_records, by_id, find
from docmill.operators.search import (
    contains_search, embed_queries, expand_hits, score_against, similar_to, top_similar,
)
from docmill.functions.text import preview
from docmill.operators.pages import page_tags
from docmill.plans.search import search_documents
from docmill.session import work_dir
from docmill.sources import substring_index
from workload.registry import DOCS, documents, query, sql_strip, table

_SUM = "list_sum(list_transform(string_split({0}, ''), lambda c: unicode(c)))"


def _embed_sql(source, name):
    return f"""{name}s AS (SELECT *, length(text) AS n, coalesce({_SUM.format('text')}, 0) AS total FROM {source}),
{name} AS (SELECT *, cast(n AS double) AS v0, cast(total % 1000 AS double) AS v1, cast((total // (n + 1)) % 100 AS double) AS v2 FROM {name}s)"""


@query("vs1_embedding", f"WITH {DOCS}, {_embed_sql('d', 'x')} SELECT doc_id, v0, v1, v2 FROM x")
def embedding(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", embed(F.col("text")).alias("v")).select(
        "doc_id", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


_COS = ("coalesce(list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0}))"
        " * sqrt(list_dot_product({1}, {1})), 0), 0)")
EMB = "em AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings)"


@query("vs2_cosine_all", f"""WITH {EMB}, q AS (SELECT v AS qv FROM em WHERE doc_id = 0)
SELECT doc_id, round({_COS.format('v', 'qv')}, 6) AS score FROM em, q""")
def cosine_all(spark, sf_dir):
    """One stored vector as the query, scored against every document."""
    docs = _vectors(spark, sf_dir)
    vector = by_id(docs, 0).first()["vector"]
    return score_against(docs, vector).withColumn("score", F.round("score", 6))


@query("vs2_cosine_top", f"""WITH {EMB}, q AS (SELECT v AS qv FROM em WHERE doc_id = 0)
SELECT doc_id, round({_COS.format('v', 'qv')}, 6) AS score FROM em, q ORDER BY {_COS.format('v', 'qv')} DESC, doc_id LIMIT 25""")
def cosine_top(spark, sf_dir):
    docs = _vectors(spark, sf_dir)
    vector = by_id(docs, 0).first()["vector"]
    return similar_to(docs, vector, k=25).withColumn("score", F.round("score", 6))


CORPUS_QUERIES = f"""{DOCS}, {_embed_sql('d', 'x')}, b AS (SELECT item_id, text FROM benchmark), {_embed_sql('b', 'y')}"""
_COS3 = """coalesce((x.v0*y.v0 + x.v1*y.v1 + x.v2*y.v2) / nullif(sqrt(y.v0*y.v0 + y.v1*y.v1 + y.v2*y.v2)
 * sqrt(x.v0*x.v0 + x.v1*x.v1 + x.v2*x.v2), 0), 0)"""


def _hits_sql(k, condition="true"):
    return f"""h AS (SELECT y.item_id AS query_id, x.doc_id, {_COS3} AS score FROM x, y WHERE {condition}),
hk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score
 FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"""


def _text_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(spark, sf_dir, k=5, vector=None):
    docs = documents(spark, sf_dir)
    vector = embed_or_empty(F.col("text")) if vector is None else vector
    return top_similar(
        docs.select("doc_id", vector.alias("vector")), embed_queries(_text_queries(spark, sf_dir)), k)


def _out(hits):
    return hits.withColumns({"rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)})


@query("vs3_batch_search", f"WITH {CORPUS_QUERIES}, {_hits_sql(5)} SELECT * FROM hk")
def batch_search(spark, sf_dir):
    return _out(_hits(spark, sf_dir))


@query("vs4_dimension_mismatch", f"WITH {CORPUS_QUERIES}, {_hits_sql(5, 'x.doc_id % 3 <> 0')} SELECT * FROM hk")
def dimension_mismatch(spark, sf_dir):
    """A third of the store holds vectors of another length: they are no hits."""
    v = embed(F.col("text"))
    return _out(_hits(spark, sf_dir, vector=F.when(F.col("doc_id") % 3 == 0, F.slice(v, 1, 2)).otherwise(v)))


@query("vs5_empty_documents", f"WITH {CORPUS_QUERIES}, {_hits_sql(5, 'x.doc_id % 4 <> 1')} SELECT * FROM hk")
def empty_documents(spark, sf_dir):
    """A store with empty texts: only those documents drop out."""
    text = F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("text"))
    return _out(_hits(spark, sf_dir, vector=embed_or_empty(text)))


def _store(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "filename", "text", embed_or_empty(F.col("text")).alias("vector"))


@query("vs6_search", f"""WITH {CORPUS_QUERIES}, {_hits_sql(5)} SELECT query_id, rank, hk.doc_id, score, filename,
 substring(text, 1, 400) AS text_preview FROM hk JOIN d ON hk.doc_id = d.doc_id""")
def search(spark, sf_dir):
    return _out(search_documents(_store(spark, sf_dir), _text_queries(spark, sf_dir)))


@query("jn1_expand_hits", f"""WITH {CORPUS_QUERIES}, {_hits_sql(8)}, kept AS (SELECT * FROM d WHERE doc_id % 4 <> 0)
SELECT query_id, rank, hk.doc_id, score, filename, coalesce(substring(text, 1, 400), '') AS text_preview
FROM hk LEFT JOIN kept ON hk.doc_id = kept.doc_id""")
def expanded_hits(spark, sf_dir):
    """Hits whose documents are partly gone from the store."""
    kept = _store(spark, sf_dir).filter(F.col("doc_id") % 4 != 0)
    max_hits = 8 * _text_queries(spark, sf_dir).count()
    return _out(expand_hits(_hits(spark, sf_dir, k=8), kept, max_hits))


@query("tk4_top_by_label", f"""WITH {EMB}, u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM em),
a AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS qv FROM a GROUP BY label),
h AS (SELECT c.label AS query_id, doc_id, {_COS.format('v', 'qv')} AS score FROM em, c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score
FROM h QUALIFY rank <= 10""")
def top_by_label(spark, sf_dir):
    """The ten vectors nearest to the mean vector of each label."""
    docs = _vectors(spark, sf_dir)
    means = (
        docs.select("label", F.posexplode("vector").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("vector"))
        .select(F.col("label").alias("query_id"), "vector")
    )
    return _out(top_similar(docs.select("doc_id", "vector"), means, k=10))


# --- Filters and records -----------------------------------------------------

@query("pf1_find", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def found(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), {"lang": "en", "source": "src1"}).select(
        "doc_id", "lang", "source", "n_chars")


@query("pf2_by_id", "SELECT doc_id, text FROM documents WHERE doc_id = 7")
def one_document(spark, sf_dir):
    return by_id(table(spark, sf_dir, "documents"), 7).select("doc_id", "text")


@query("pf3_contains_search", "SELECT doc_id, text FROM documents WHERE contains(lower(text), 'of the') ORDER BY doc_id LIMIT 5")
def substring_search(spark, sf_dir):
    return contains_search(table(spark, sf_dir, "documents"), "OF the")


_SOUGHT = """SELECT item_id AS query_id, substring(text, cast(1 + item_id % 30 as int), cast(3 + item_id % 12 as int)) AS query FROM benchmark
 UNION ALL SELECT -1, 'É' UNION ALL SELECT -2, 'Of' UNION ALL SELECT -3, 'qq一q' UNION ALL SELECT -4, ''"""


@query("pf3_index_search", f"""WITH q AS ({_SOUGHT}), h AS (SELECT query_id, doc_id, text,
 row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q JOIN documents ON query <> '' AND contains(lower(text), lower(query)))
SELECT query_id, rank, doc_id, text FROM h WHERE rank <= 5""")
def index_search(spark, sf_dir):
    """A table of substrings against trigram posting lists of all documents."""
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark, "pf3")
    substring_index.build(docs.select("doc_id", "text"), path)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return substring_index.search(docs, path, spark.sql(_SOUGHT)).withColumn("rank", F.col("rank").cast("bigint"))


@query("tk5_first_matches", "SELECT doc_id, text FROM documents WHERE contains(lower(text), 'é') ORDER BY doc_id LIMIT 100")
def first_matches(spark, sf_dir):
    return contains_search(table(spark, sf_dir, "documents"), "É", k=100)


@query("pf4_page_tags", f"""SELECT page_id, {sql_strip('html')} AS text, array_to_string(list_filter([
 CASE WHEN contains(lower(html), 'date') THEN 'Date' END, CASE WHEN contains(lower(html), 'name') THEN 'Name' END,
 CASE WHEN contains(lower(html), 'contract') THEN 'Contract' END], lambda x: x IS NOT NULL), '|') AS entities
 FROM (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN ' CONTRACT ' WHEN 1 THEN chr(10) || ' Update the name' ELSE '' END AS html FROM pages)""")
def tagged_pages(spark, sf_dir):
    suffix = "html || case page_id % 5 when 0 then ' CONTRACT ' when 1 then chr(10) || ' Update the name' else '' end"
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(suffix).alias("text"))
    return page_tags(pages).withColumn("entities", F.array_join("entities", "|"))


@query("pf5_previews", f"""WITH {DOCS} SELECT doc_id, substring(text, 1, 400) AS hit, substring(text, 1, 500) AS upload,
 substring(text, 1, 2000) AS verdict FROM d""")
def previews(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[
        preview(F.col("text"), n).alias(name) for name, n in (("hit", 400), ("upload", 500), ("verdict", 2000))])


_RECORD = """length(text) AS length, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS summary"""


@query("pf6_basic_records", f"SELECT conv_id, turn, text AS original, {_RECORD} FROM conversations WHERE text <> ''")
def records(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").withColumn("pos", F.struct("conv_id", "turn"))
    return basic_records(texts).filter(F.col("error").isNull()).select(
        "pos.conv_id", "pos.turn", "original", F.col("length").cast("bigint").alias("length"), "summary")


@query("pf7_bulk_records", f"""SELECT doc_id AS pos, nullif(text, '') AS original, CASE WHEN text <> '' THEN length(text) END AS length,
 CASE WHEN text = '' THEN NULL WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS summary,
 CASE WHEN text = '' THEN 'Empty document' END AS error
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '' ELSE text END AS text FROM documents)""")
def bulk_records(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.expr("case when doc_id % 3 = 1 then '' else text end").alias("text"))
    return basic_records(texts).withColumn("length", F.col("length").cast("bigint"))
