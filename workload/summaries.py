"""Queries: summaries, chunks and the model hook."""

from pyspark.sql import functions as F

from docmill.fixed_values import (
    DOCUMENT_NOT_FOUND, NO_DOCUMENT_OR_TEXT, NOTHING_TO_ANSWER, NOTHING_TO_SUMMARIZE,
    SUMMARY_KEYWORDS,
)
from docmill.functions.text import split_space
from docmill.operators import boundaries, lexical, summaries
from docmill.operators.annotate import annotate
from workload.registry import (
    DOCS, NOT_WS, WORDS, documents, query, sql_list, sql_not_blank, sql_sentences, table,
)

SENTENCES = f"""sl AS (SELECT doc_id, {sql_sentences('text')} AS l FROM d),
sn AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM sl)"""

FREQUENCY_SUMMARY = f"""{SENTENCES},
sw AS (SELECT doc_id, pos, lower(unnest(regexp_extract_all(s, '{WORDS}'))) AS word FROM sn),
st AS (SELECT * FROM sw WHERE word NOT IN ({sql_list(lexical.STOP_WORDS)})),
sf AS (SELECT doc_id, word, count(*) AS n FROM st GROUP BY doc_id, word),
ss AS (SELECT doc_id, pos, sum(n) AS score FROM st JOIN sf USING (doc_id, word) GROUP BY doc_id, pos),
se AS (SELECT doc_id, s, min(pos) AS pos FROM sn WHERE length(s) > 20 GROUP BY doc_id, s),
sr AS (SELECT se.doc_id, s, row_number() OVER (PARTITION BY se.doc_id ORDER BY coalesce(score, 0) DESC, se.pos) AS rank
 FROM se LEFT JOIN ss ON se.doc_id = ss.doc_id AND se.pos = ss.pos),
sa AS (SELECT doc_id, string_agg(s, ' ' ORDER BY rank) AS summary FROM sr WHERE rank <= 3 GROUP BY doc_id),
fs AS (SELECT d.doc_id, coalesce(summary, 'No summary available.') AS summary FROM d LEFT JOIN sa ON d.doc_id = sa.doc_id)"""


@query("sm1_frequency_summary", f"WITH {DOCS}, {FREQUENCY_SUMMARY} SELECT doc_id, summary FROM fs")
def frequency_summary(spark, sf_dir):
    return lexical.frequency_summary(documents(spark, sf_dir))


# texts that hold abbreviations before small letters, digits and names
_SHORT = "text || ' Art. 5 binds Acme Inc. and others. See Art. ' || cast(doc_id as string) || ' of Dr. Bell! It ends. Now.'"
_TOKENS = f"""t AS (SELECT doc_id, regexp_extract_all(text, '{NOT_WS}+') AS t FROM (SELECT doc_id, {_SHORT} AS text FROM documents)),
p AS (SELECT doc_id, i, t[i] AS token, t[i + 1] AS after FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)),
w AS (SELECT *, lower(regexp_replace(token, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')) AS word,
 regexp_matches(token, '[\\p{{L}}\\p{{N}}_]\\.$') AS dot, regexp_matches(coalesce(after, ''), '^[\\p{{Ll}}\\p{{Nd}}]') AS goes FROM p),
c AS (SELECT word, count(*) FILTER (dot) AS n_dot, count(*) FILTER (NOT dot) AS n_plain, count(*) FILTER (dot AND goes) AS n_on
 FROM w WHERE word <> '' GROUP BY word)"""


def _short_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_SHORT).alias("text"))


@query("sm1_abbreviation_counts", f"WITH {_TOKENS} SELECT word, n_dot, n_plain, n_on FROM c")
def abbreviation_counts(spark, sf_dir):
    return boundaries.abbreviation_counts(_short_texts(spark, sf_dir))


@query("sm1_learnt_sentences", f"""WITH {_TOKENS},
a AS (SELECT word FROM c WHERE n_dot >= 5 AND length(word) <= 8 AND n_dot >= 0.9 * (n_dot + n_plain) AND n_on >= 0.3 * n_dot),
e AS (SELECT doc_id, i, token, coalesce(sum(CASE WHEN regexp_matches(token, '[.!?]$') AND NOT (dot AND word IN (SELECT word FROM a)) THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w)
SELECT doc_id, pos::BIGINT AS pos, string_agg(token, ' ' ORDER BY i) AS sentence FROM e GROUP BY doc_id, pos""")
def learnt_sentences(spark, sf_dir):
    docs = _short_texts(spark, sf_dir)
    known = boundaries.known_words(boundaries.abbreviations(boundaries.abbreviation_counts(docs)))
    listed = docs.select("doc_id", F.posexplode(boundaries.sentences(F.col("text"), known)).alias("pos", "s"))
    return listed.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(split_space(F.col("s")), " ").alias("sentence"))


@query("tk2_summary_sentence", f"""WITH {DOCS}, {FREQUENCY_SUMMARY} SELECT d.doc_id, coalesce(s, 'No summary available.') AS summary
 FROM d LEFT JOIN (SELECT * FROM sr WHERE rank = 1) x ON d.doc_id = x.doc_id""")
def summary_sentence(spark, sf_dir):
    """The single best sentence."""
    return lexical.frequency_summary(documents(spark, sf_dir), k=1)


def heuristic_sql(k, source="d", keywords=SUMMARY_KEYWORDS):
    bonus = " + ".join(f"CASE WHEN contains(lower(s), '{kw}') THEN 50 ELSE 0 END" for kw in keywords)
    return f"""hl AS (SELECT doc_id, {sql_sentences('text')} AS l FROM {source}),
hn AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM hl),
hr AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(s, '{NOT_WS}+')) + {bonus} DESC, pos) AS rank FROM hn),
hs AS (SELECT doc_id, string_agg(s, ' ' ORDER BY rank) AS summary FROM hr WHERE rank <= {k} GROUP BY doc_id)"""


@query("sm2_heuristic_summary", f"WITH {DOCS}, {heuristic_sql(5)} SELECT doc_id, summary FROM hs")
def heuristic_summary(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", summaries.heuristic_summary(F.col("text")).alias("summary"))


@query("tk3_heuristic_top_two",
       f"WITH {DOCS}, {heuristic_sql(2, keywords=('the', 'eau', 'payment'))} SELECT doc_id, summary FROM hs")
def heuristic_top_two(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", summaries.heuristic_summary(
        F.col("text"), k=2, keywords=("the", "eau", "payment")).alias("summary"))


# --- The model hook: a stand-in model ----------------------------------------

def sql_digest(x: str) -> str:
    return f"'<' || length({x}) || ' ' || md5({x}) || '>'"


def stand_in(answer):
    """A model factory. Its functions are nested, so that they travel to the
    workers by value and need no installed package there."""
    def factory():
        return lambda rows: [answer(*row) for row in rows]
    return factory


def failing():
    def answer(text):
        import hashlib
        if "Termination" in text:
            raise ValueError("refused")
        return f"<{len(text)} {hashlib.md5(text.encode()).hexdigest()}>"
    return stand_in(answer)


def digesting():
    def answer(text):
        import hashlib
        return f"<{len(text)} {hashlib.md5(text.encode()).hexdigest()}>"
    return stand_in(answer)


def unloadable():
    def factory():
        raise OSError("no weights")
    return factory


whole_digest = digesting()
failing_on_termination = failing()
answer_length = stand_in(lambda text, question: f"{len(text)} of {question}")


CHUNKS = """cc AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, cast(ceil(length(text) / 900.0) AS int)) END) AS i FROM d),
ch AS (SELECT doc_id, i, CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, i * 900 + 1, 900) END AS chunk FROM cc)"""


@query("sm3_chunks", f"WITH {DOCS}, {CHUNKS} SELECT doc_id, cast(i AS bigint) AS pos, chunk FROM ch")
def chunks(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(summaries.chunks(F.col("text"))).alias("pos", "chunk")
    ).withColumn("pos", F.col("pos").cast("bigint"))


MODEL = f"""{CHUNKS}, ms AS (SELECT doc_id, string_agg({sql_digest('chunk')}, ' ' ORDER BY i) AS summary,
 max(CASE WHEN contains(chunk, 'Termination') THEN 1 ELSE 0 END) AS failed FROM ch GROUP BY doc_id)"""


@query("sm3_model_summary", f"WITH {DOCS}, {MODEL} SELECT doc_id, summary AS model_summary FROM ms")
def model_summary(spark, sf_dir):
    return summaries.model_summary(documents(spark, sf_dir), whole_digest)


@query("sm4_summary_with_fallback", f"""WITH {DOCS}, {MODEL}, {heuristic_sql(5)}
SELECT ms.doc_id, CASE failed WHEN 1 THEN hs.summary ELSE ms.summary END AS summary FROM ms JOIN hs ON ms.doc_id = hs.doc_id""")
def summary_with_fallback(spark, sf_dir):
    return summaries.summarize(documents(spark, sf_dir), failing_on_termination)


@query("sm4_model_that_cannot_load", f"WITH {DOCS}, {heuristic_sql(5)} SELECT doc_id, summary FROM hs")
def summary_without_model(spark, sf_dir):
    return summaries.summarize(documents(spark, sf_dir), unloadable())


SPARSE = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '  ' ELSE text END"


@query("sm5_guarded_summary", f"""SELECT doc_id, CASE WHEN {sql_not_blank(SPARSE)} THEN {sql_digest(SPARSE)}
 ELSE '{NOTHING_TO_SUMMARIZE}' END AS summary FROM documents""")
def guarded_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SPARSE).alias("text"))
    return summaries.guarded_summary(docs, whole_digest).select("doc_id", "summary")


QUESTION = "CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN role END"


@query("sm5_guarded_answer", f"""SELECT conv_id, turn, CASE WHEN coalesce({QUESTION}, '') = '' OR text = '' THEN '{NOTHING_TO_ANSWER}'
 ELSE cast(length(text) AS string) || ' of ' || ({QUESTION}) END AS answer FROM conversations""")
def guarded_answer(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").withColumn("question", F.expr(QUESTION))
    return summaries.guarded_answer(asked, answer_length).select("conv_id", "turn", "answer")


@query("ud1_annotate", f"""WITH {DOCS} SELECT doc_id, CASE WHEN NOT contains(text, 'Termination') THEN {sql_digest('text')} END AS value,
 CASE WHEN contains(text, 'Termination') THEN 'ValueError: refused' END AS error FROM d""")
def annotated(spark, sf_dir):
    return annotate(
        documents(spark, sf_dir).select("doc_id", "text"), failing_on_termination, ["text"],
        "value string",
    ).select("doc_id", "value", "error")


# Requests: each conversation turn asks for a document or brings its own text.
# One document is asked for by a third of them, the others by all over the table.
REQUEST_DOC = """CASE WHEN turn % 4 = 3 THEN cast(NULL AS bigint) WHEN conv_id % 3 = 0 THEN cast(7 AS bigint)
 WHEN turn % 4 = 2 THEN conv_id + 1000000000 ELSE conv_id * 10 + turn END"""
REQUESTS = f"""q AS (SELECT cast(conv_id AS string) || '-' || cast(turn AS string) AS request_id, {REQUEST_DOC} AS ref,
 CASE WHEN conv_id % 2 = 0 THEN text END AS text FROM conversations)"""


@query("jn2_requested_summaries", f"""WITH {DOCS}, {REQUESTS}, u AS (SELECT 'd' || cast(doc_id AS string) AS doc_id, text FROM d
 UNION ALL SELECT 'q' || request_id, text FROM q WHERE ref IS NULL AND coalesce(text, '') <> ''), {heuristic_sql(5, 'u')}
SELECT request_id, summary, CASE WHEN ref IS NOT NULL AND summary IS NULL THEN '{DOCUMENT_NOT_FOUND}'
  WHEN ref IS NULL AND coalesce(text, '') = '' THEN '{NO_DOCUMENT_OR_TEXT}' END AS error
FROM q LEFT JOIN hs ON hs.doc_id = CASE WHEN ref IS NOT NULL THEN 'd' || cast(ref AS string) ELSE 'q' || request_id END""")
def requested_summaries(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        F.expr("cast(conv_id as string) || '-' || cast(turn as string)").alias("request_id"),
        F.expr(REQUEST_DOC).cast("string").alias("doc_id"),
        F.expr("case when conv_id % 2 = 0 then text end").alias("text"),
    )
    store = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    done, rejected = summaries.requested_summaries(requests, store)
    return done.unionByName(rejected, allowMissingColumns=True)
