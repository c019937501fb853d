"""Queries: files, pages, stores and the incremental job.

Queries on stores write to a new folder under the shared work folder, read it
back and return what a reader sees.
"""

import functools

from pyspark.sql import DataFrame, functions as F

from docmill.fixed_values import ACCEPTED_TYPES, IMAGE_TYPES, NO_FILE, NO_TEXT, UNSUPPORTED_TYPE
from docmill.functions import files as file_functions
from docmill.functions.text import preview
from docmill.operators import pages as pages_op
from docmill.session import work_dir
from docmill.sources import files, store
from docmill.streaming.ingest import arriving_files, ingest, named_records, newest_files
from workload.extraction import PAGES, _page_table
from workload.registry import DOCS, FILENAME, documents, query, sql_list, sql_not_blank, sql_strip, table

NAMES = f"""fn AS (SELECT 'd' || cast(doc_id AS string) AS id, {FILENAME} AS filename FROM documents
 UNION ALL SELECT 'p' || cast(page_id AS string), url || CASE page_id % 3 WHEN 0 THEN '.GIF' WHEN 1 THEN '.PDF' ELSE '' END FROM pages)"""


def _names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.expr("'d' || cast(doc_id as string)").alias("id"), F.expr(FILENAME).alias("filename"))
    urls = table(spark, sf_dir, "pages").select(
        F.expr("'p' || cast(page_id as string)").alias("id"),
        F.expr("url || case page_id % 3 when 0 then '.GIF' when 1 then '.PDF' else '' end").alias("filename"))
    return docs.unionByName(urls)


_EXT = "lower(regexp_extract(filename, '[^.]*$'))"


@query("io1_file_type", f"""WITH {NAMES} SELECT id, filename, CASE WHEN {_EXT} IN ({sql_list(ACCEPTED_TYPES)})
 THEN {_EXT} ELSE 'unknown' END AS file_type FROM fn""")
def file_type(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("file_type", file_functions.file_type(F.col("filename")))


@query("io2_route", f"""WITH {NAMES}, r AS (SELECT id, CASE filename WHEN '' THEN 'uploaded_file' ELSE filename END AS filename FROM fn)
SELECT id, filename, CASE WHEN NOT contains(filename, '.') THEN 'text' WHEN {_EXT} = 'pdf' THEN 'pdf'
 WHEN {_EXT} IN ({sql_list(IMAGE_TYPES)}) THEN 'image' ELSE 'text' END AS route FROM r""")
def route(spark, sf_dir):
    return _names(spark, sf_dir).select(
        "id", file_functions.filename_or_default(F.col("filename")).alias("filename"),
        file_functions.route(F.col("filename")).alias("route"))


def _page_files(spark, sf_dir):
    """Web pages as files: Latin-1 bytes for odd pages that allow it, else UTF-8."""
    content = F.when(
        (F.col("page_id") % 2 == 1) & ~F.col("html").rlike(r"[^\x{00}-\x{FF}]"),
        F.encode("html", "ISO-8859-1"),
    ).otherwise(F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("filename"), content.alias("content"))


@query("io3_decode_text", "SELECT page_id, html AS text FROM pages")
def decode_text(spark, sf_dir):
    return _page_files(spark, sf_dir).select(
        "page_id", file_functions.decode_text(F.col("content")).alias("text"))


def _written(pages, *folders):
    """Pages as files ``.../page_id=<id>.txt``, of a thousand in a folder, with a line end."""
    return pages.select(
        F.concat(*folders, F.expr("concat('lot=', page_id div 1000, '/page_id=', page_id, '.txt')")).alias("path"),
        F.encode(F.concat(F.coalesce("html", F.lit("")), F.lit("\n")), "UTF-8").alias("content"))


@query("io4_scan_files", f"""SELECT page_id, strlen(html) + 1 AS length, {sql_strip('html')} AS text,
 CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'unknown' END AS file_type, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'text' END AS route,
 CASE WHEN page_id % 2 = 1 THEN '{UNSUPPORTED_TYPE}' END AS error FROM pages""")
def scan_files(spark, sf_dir):
    """Files written from the pages, found again, decoded, and judged by their names."""
    folder = work_dir(spark, "io4")
    files.write(_written(table(spark, sf_dir, "pages")), folder)
    page = F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint")
    found = files.scan(spark, folder, recursive=True).select(
        page.alias("page_id"), "length", file_functions.decode_text(F.col("content")).alias("text"),
        F.when(page % 2 == 0, F.concat(page, F.lit(".pdf"))).otherwise(F.concat(page, F.lit(".txt"))).alias("filename"))
    kept, rejected = files.split_rejects(found.withColumn("pages", F.array("text")))
    judged = kept.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)
    return judged.select(
        "page_id", "length", file_functions.combine_texts(F.col("text"), F.expr("cast(array() as array<string>)")).alias("text"),
        file_functions.file_type(F.col("filename")).alias("file_type"), file_functions.route(F.col("filename")).alias("route"), "error")


@query("io5_pages", f"WITH {PAGES} SELECT doc_id, page, text FROM p")
def pages(spark, sf_dir):
    return _page_table(spark, sf_dir).withColumn("page", F.col("page").cast("bigint"))


@query("io6_fill_from_ocr", f"""WITH {PAGES}, o AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN ' ' || chr(9) ELSE text END AS text,
 CASE WHEN (doc_id + page) % 2 = 0 THEN 'ocr ' || text END AS ocr_text FROM p),
f AS (SELECT doc_id, page, CASE WHEN {sql_not_blank('text')} THEN text ELSE coalesce(ocr_text, text) END AS text FROM o)
SELECT doc_id, page, text, NOT {sql_not_blank('text')} AS needs_ocr FROM f""")
def fill_from_ocr(spark, sf_dir):
    p = _page_table(spark, sf_dir)
    pages = p.withColumn("text", F.expr("case when (doc_id + page) % 3 = 0 then ' ' || chr(9) else text end"))
    ocr = p.filter("(doc_id + page) % 2 = 0").select(
        "doc_id", "page", F.concat(F.lit("ocr "), "text").alias("ocr_text"))
    return pages_op.fill_from_ocr(pages, ocr).withColumn("page", F.col("page").cast("bigint"))


@query("io7_combine_texts", f"""WITH {DOCS} SELECT doc_id, {sql_strip('''concat_ws(chr(10), CASE WHEN doc_id % 3 <> 0 THEN text END,
 filename || ' ', CASE WHEN doc_id % 2 = 0 THEN chr(9) || text END)''')} AS combined_text FROM d WHERE filename <> ''
 UNION ALL SELECT doc_id, {sql_strip('''concat_ws(chr(10), CASE WHEN doc_id % 3 <> 0 THEN text END,
 CASE WHEN doc_id % 2 = 0 THEN chr(9) || text END)''')} FROM d WHERE filename = ''""")
def combine_texts(spark, sf_dir):
    name = F.when(F.col("filename") != "", F.concat("filename", F.lit(" "))).otherwise("")
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\t"), "text")).otherwise("")
    first = F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("")
    return documents(spark, sf_dir).select(
        "doc_id", file_functions.combine_texts(first, F.array(name, second)).alias("combined_text"))


UPSERTED = """SELECT cast(doc_id AS string) AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'third' WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS filename,
 CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text || ' v9' ELSE text END AS text FROM documents
 UNION ALL SELECT sha256('anonymous' || chr(1) || text), 'anonymous', text FROM (SELECT DISTINCT text FROM documents)"""


_TOTAL = "list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))"
#: Every value of the stored vector; an empty text has none.
SQL_VECTOR = f"""CASE WHEN text = '' THEN '' ELSE concat_ws(',', cast(length(text) AS double),
 cast({_TOTAL} % 1000 AS double), cast(({_TOTAL} // (length(text) + 1)) % 100 AS double)) END AS vector"""


def _vector():
    return F.array_join(F.transform("vector", lambda v: v.cast("string")), ",").alias("vector")


@query("io8_upsert", f"""SELECT doc_id, filename, text, {SQL_VECTOR}, filename AS source_filename FROM ({UPSERTED})""")
def upsert(spark, sf_dir):
    """Three batches and a compaction: every third document is replaced by the
    newest of several versions (all of them also under one hot id's rows), every
    fifth by an empty text, and all texts arrive again without an id."""
    root = work_dir(spark, "io8")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    is_third = F.col("doc_id").cast("bigint") % 3 == 0
    is_fifth = F.col("doc_id").cast("bigint") % 5 == 0
    versions = docs.filter(is_third).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("version"), "text"
    ).select("doc_id", F.concat("text", F.lit(" v"), "version").alias("text"),
             F.col("version").cast("bigint").alias("version"), F.lit("second").alias("filename"))
    store.upsert(files.to_records(docs.withColumn("filename", F.lit("first"))), root, 0)
    store.upsert(files.to_records(versions), root, 1)
    store.compact(spark, root)
    empty = docs.filter(is_fifth).select("doc_id", F.lit("").alias("text"), F.lit("third").alias("filename"))
    unnamed = docs.select(F.lit("").alias("doc_id"), "text", F.lit("anonymous").alias("filename"))
    store.upsert(files.to_records(empty.unionByName(unnamed)), root, 2)
    store.upsert(files.to_records(empty.unionByName(unnamed)), root, 2)  # a repeated batch
    return store.read(spark, root).select(
        "doc_id", "filename", "text", _vector(), F.col("metadata")["source_filename"].alias("source_filename"))


@query("pf2_store_lookup", """SELECT cast(doc_id AS string) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END AS text
 FROM documents WHERE doc_id IN (0, 1, 3, 12, 77)""")
def store_lookup(spark, sf_dir):
    """Single ids in a compacted store with a later commit; one of them is absent."""
    root = work_dir(spark, "pf2")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("f").alias("filename"), "text")
    store.upsert(files.to_records(docs), root, 0)
    store.compact(spark, root)
    newer = docs.filter(F.col("doc_id").cast("bigint") % 3 == 0).withColumn("text", F.concat(F.lit("new "), "text"))
    store.upsert(files.to_records(newer), root, 1)
    found = [store.lookup(spark, root, i).select("doc_id", "text") for i in ("0", "1", "3", "12", "77", "absent")]
    return functools.reduce(DataFrame.unionByName, found)


_INGESTED = f"i AS (SELECT DISTINCT url AS filename, {sql_strip('html')} AS text FROM pages)"
INGESTED = (f"WITH {_INGESTED} SELECT sha256(filename || chr(1) || text) AS doc_id, filename, "
            "substring(text, 1, 500) AS text_preview, length(text) AS n FROM i")


def _ingested(documents):
    return documents.select(
        "doc_id", "filename", preview(F.col("text"), 500).alias("text_preview"),
        F.length("text").cast("bigint").alias("n"))


def _text_named(rows):
    """Page URLs may end like image or PDF names; as text files they decode here."""
    return rows.withColumn("extracted_text", file_functions.decode_text(F.col("content"))).withColumn(
        "combined_text", file_functions.combine_texts(
            F.col("extracted_text"), F.expr("cast(array() as array<string>)")))


@query("io9_ingest", INGESTED)
def ingest_batch(spark, sf_dir):
    root = work_dir(spark, "io9")
    store.upsert(files.to_records(_text_named(_page_files(spark, sf_dir))), root, 0)
    return _ingested(store.read(spark, root))


@query("io9_ingest_stream", INGESTED)
def ingest_stream(spark, sf_dir):
    root = work_dir(spark, "io9s")
    # a pattern, as the table may be a file or a folder of files
    pages = spark.readStream.schema("page_id bigint, url string, html string").parquet(f"{sf_dir}/pages.parque[t]")
    rows = pages.select(F.col("url").alias("filename"), F.encode("html", "UTF-8").alias("content"))
    ingest(rows, root, f"{root}/checkpoint",
           lambda batch: files.to_records(_text_named(batch))).awaitTermination()
    return _ingested(store.read(spark, root))


@query("io9_ingest_files", f"""SELECT 'page' || cast(page_id AS string) || '.txt' AS filename,
 {sql_strip("CASE WHEN page_id % 3 = 2 THEN 'new ' || html ELSE html END")} AS text FROM pages""")
def ingest_files(spark, sf_dir):
    """Real files in two waves, the stream restarted between: of every third page the
    older version comes late, of every third the same file again, of the rest a newer one."""
    root = work_dir(spark, "io9f")
    folder, kind = f"{root}/in", F.col("page_id") % 3
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    waves = (
        pages.select("page_id", F.when(kind == 0, 2).otherwise(1).alias("version"), "html"),
        pages.select("page_id", F.when(kind == 2, 3).otherwise(1).alias("version"), F.concat(
            F.when(kind == 0, "old ").when(kind == 2, "new ").otherwise(""), "html").alias("html")),
    )
    for number, wave in enumerate(waves):
        files.write(_written(wave, F.lit(f"wave={number}/version="), F.col("version"), F.lit("/")), folder)
        stream = arriving_files(
            spark, folder, name=lambda p: F.concat(F.lit("page"), F.regexp_extract(p, "page_id=([0-9]+)", 1), F.lit(".txt")),
            version=lambda p: F.regexp_extract(p, "version=([0-9]+)", 1))
        ingest(newest_files(stream), f"{root}/store", f"{root}/checkpoint", named_records).awaitTermination()
    return store.read(spark, f"{root}/store").select("filename", "text")


@query("io9_upload_reply", f"""SELECT url AS filename, substring({sql_strip('html')}, 1, 500) AS text_preview,
 CASE WHEN lower(regexp_extract(url, '[^.]*$')) IN ({sql_list(('pdf', *IMAGE_TYPES))}) THEN 0 ELSE 1 END AS decoded,
 0 AS ocr_texts_count FROM (SELECT url, CASE WHEN lower(regexp_extract(url, '[^.]*$')) IN ({sql_list(('pdf', *IMAGE_TYPES))}) THEN '' ELSE html END AS html FROM pages)""")
def upload_reply(spark, sf_dir):
    rows = files.read_texts(_page_files(spark, sf_dir), empty_files=True)
    is_text = file_functions.route(F.col("filename")) == "text"
    return rows.select(
        "filename", preview(F.col("combined_text"), 500).alias("text_preview"),
        is_text.cast("bigint").alias("decoded"),
        F.size("ocr_texts").cast("bigint").alias("ocr_texts_count"))


def _minimal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("summary"), F.col("source").alias("file_path"))


@query("io10_append", """SELECT 'doc ' || cast(doc_id AS string) AS title, text AS content, cast(NULL AS string) AS summary, source AS file_path
 FROM documents, (VALUES (1), (2)) t(i)""")
def append(spark, sf_dir):
    """The same rows inserted twice are two records each."""
    path = work_dir(spark, "io10")
    store.append(_minimal(spark, sf_dir), path)
    store.append(_minimal(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("io11_duplicate_ids", "SELECT doc_id, count(*) AS n FROM labels_twice GROUP BY doc_id HAVING count(*) > 1".replace(
    "labels_twice", "(SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT 1 FROM documents)"))
def duplicate_ids(spark, sf_dir):
    """Documents, labels and one id as often as there are documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    hot = docs.select(F.lit(1).cast("bigint").alias("doc_id"))
    return store.duplicate_ids(docs.unionByName(labels).unionByName(hot))


@query("io12_history", "SELECT doc_id, lang, text FROM documents")
def history(spark, sf_dir):
    path = work_dir(spark, "io12")
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("_id"), "doc_id", "lang", "text")
    store.append(rows, path)
    return store.history(spark, path)


@query("io13_ids_and_vectors", f"""SELECT doc_id, {SQL_VECTOR} FROM (SELECT cast(doc_id AS string) AS doc_id,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents)""")
def ids_and_vectors(spark, sf_dir):
    root = work_dir(spark, "io13")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("f").alias("filename"),
        F.expr("case when doc_id % 5 = 0 then '' else text end").alias("text"))
    store.upsert(files.to_records(docs), root, 0)
    return store.ids_and_vectors(store.read(spark, root)).select("doc_id", _vector())


@query("io14_rejects", f"""SELECT * FROM (SELECT doc_id, filename, CASE WHEN filename = '' THEN '{NO_FILE}'
 WHEN {_EXT} NOT IN ({sql_list(ACCEPTED_TYPES)}) THEN '{UNSUPPORTED_TYPE}'
 WHEN doc_id % 4 = 0 THEN '{NO_TEXT}' END AS error FROM (SELECT doc_id, {FILENAME} AS filename FROM documents)) WHERE error IS NOT NULL
 UNION ALL SELECT doc_id, filename, 'kept' FROM (SELECT doc_id, {FILENAME} AS filename FROM documents)
 WHERE {_EXT} IN ({sql_list(ACCEPTED_TYPES)}) AND doc_id % 4 <> 0""")
def rejects(spark, sf_dir):
    pages = F.expr("case doc_id % 4 when 0 then array('', '') when 1 then array('', ' ') else array(text) end")
    uploads = documents(spark, sf_dir).select("doc_id", "filename", pages.alias("pages"))
    kept, rejected = files.split_rejects(uploads)
    return rejected.select("doc_id", "filename", "error").unionByName(
        kept.select("doc_id", "filename", F.lit("kept").alias("error")))


@query("ag10_assemble_pages", f"""WITH {PAGES} SELECT doc_id, count(*) AS total_pages, string_agg(text, chr(10) ORDER BY page) AS text
 FROM p GROUP BY doc_id""")
def assemble_pages(spark, sf_dir):
    return pages_op.assemble(_page_table(spark, sf_dir)).withColumn(
        "total_pages", F.col("total_pages").cast("bigint"))
