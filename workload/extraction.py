"""Queries: extraction, scoring, verdicts, cleaning."""

from pyspark.sql import functions as F

from docmill.fixed_values import CLAUSE_KEYWORDS, QUESTION_LABEL, ANSWER_LABEL, SUMMARIZE_PROMPT, VERDICT_PROMPT
from docmill.functions import extract, score
from docmill.functions.text import clean_text, words
from docmill.functions.verdict import parse_verdict
from docmill.operators import lemma_rules, lexical, pages as pages_op
from docmill.plans.analyze import rule_scores
from workload.registry import (
    DOCS, WORDS, WS, documents, query, sql_dates, sql_emails, sql_keyword_count, sql_list,
    sql_not_blank, sql_phones, sql_signers, sql_strip, table,
)

FREQUENT = ("the", "le", "of the", "de", "THE payment")


def _joined(values):
    return F.array_join(values, "|")


def _per_document(name, column, sql):
    """All matches of a text, duplicates kept, in text order."""
    @query(name, f"WITH {DOCS} SELECT doc_id, array_to_string({sql('text')}, '|') AS found FROM d")
    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", _joined(column(F.col("text"))).alias("found"))


_per_document("ex1_emails", extract.emails, sql_emails)
_per_document("ex2_phones", extract.phones, sql_phones)
_per_document("ex3_dates", extract.dates, sql_dates)
_per_document("ex4_signers", extract.signers, sql_signers)


def _counts_sql(source, keywords):
    return "\nUNION ALL ".join(
        f"SELECT doc_id, '{kw}' AS clause, {sql_keyword_count('text', kw)} AS n FROM {source}"
        for kw in keywords
    )


@query("ex5_clause_counts", f"WITH {DOCS} {_counts_sql('d', CLAUSE_KEYWORDS)}")
def clause_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.explode(extract.clause_counts(F.col("text"))).alias("clause", "n")
    ).withColumn("n", F.col("n").cast("bigint"))


@query("ex5_clause_counts_overlapping", f"WITH {DOCS} {_counts_sql('d', FREQUENT)}")
def clause_counts_overlapping(spark, sf_dir):
    """Keywords that share words, and occur often."""
    return documents(spark, sf_dir).select(
        "doc_id", F.explode(extract.clause_counts(F.col("text"), FREQUENT)).alias("clause", "n")
    ).withColumn("n", F.col("n").cast("bigint"))


def _present_sql(x):
    checks = ", ".join(f"CASE WHEN {sql_keyword_count(x, kw)} > 0 THEN '{kw}' END" for kw in CLAUSE_KEYWORDS)
    return f"array_to_string(list_filter([{checks}], lambda k: k IS NOT NULL), '|')"


PAGES = f"""{DOCS}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: {sql_not_blank('p')}) AS pages FROM d),
p AS (SELECT doc_id, unnest(pages) AS text, generate_subscripts(pages, 1) AS page FROM l)"""


def _page_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return pages_op.explode_pages(docs.select("doc_id", pages_op.paragraphs(F.col("text")).alias("pages")))


@query("ex6_page_clauses", f"WITH {PAGES} SELECT doc_id, page, {_present_sql('text')} AS clauses FROM p")
def page_clauses(spark, sf_dir):
    return _page_table(spark, sf_dir).select(
        "doc_id", F.col("page").cast("bigint").alias("page"),
        _joined(extract.clauses_present(F.col("text"))).alias("clauses"),
    )


@query("ex7_document_clause_keys",
       f"SELECT doc_id, '{'|'.join(CLAUSE_KEYWORDS)}' AS clauses_found FROM documents")
def document_clause_keys(spark, sf_dir):
    """Every keyword is a key of a document's counts, even at zero."""
    keys = F.map_keys(extract.clause_counts(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", _joined(keys).alias("clauses_found"))


# A dictionary of all words of the benchmark passages, which recur in documents, cut
# into runs of one to six words; runs of one only if the word is long.
_RUNS = {0: 1, 1: 2, 3: 3, 6: 4, 10: 5, 15: 6}


def _run(n: int, at: str) -> str:
    return " || ".join([f"w[{at} + 1]"] + [f"s[{at} + {k + 1}] || w[{at} + {k + 1}]" for k in range(1, n)])


def _words_sql(x: str) -> str:
    """Words, and what stands before each, whitespace as one space."""
    return (f"regexp_extract_all({x}, '{WORDS}') AS w, list_transform(string_split_regex({x}, '{WORDS}'), "
            f"lambda x: CASE WHEN regexp_full_match(x, '{WS}+') THEN ' ' ELSE x END) AS s")


GAZETTEER = f"""gw AS (SELECT item_id, {_words_sql('text')} FROM benchmark),
gp AS (SELECT item_id, w, s, unnest(range(len(w))) AS o FROM gw),
g AS (SELECT DISTINCT surface, CASE (item_id + o) % 2 WHEN 0 THEN 'PERSON' ELSE 'ORG' END AS label FROM (
 SELECT item_id, o, CASE o % 21 {' '.join(f"WHEN {k} THEN {_run(n, 'o')}" for k, n in _RUNS.items())} END AS surface,
  o % 21 = 0 AS single FROM gp) WHERE surface IS NOT NULL AND (NOT single OR length(surface) > 7))"""
ENTITIES = f"""dw AS (SELECT doc_id, {_words_sql('text')} FROM d),
dt AS (SELECT doc_id, unnest(list_transform(range(len(w)), lambda p: {{'pos': p, 'keys': [{', '.join(_run(n, 'p') for n in range(1, 7))}]}})) AS r FROM dw),
e AS (SELECT doc_id, pos, label, surface FROM (SELECT doc_id, r.pos AS pos, unnest(r.keys) AS k FROM dt) JOIN g ON k = surface)"""


def gazetteer(spark, sf_dir):
    runs = table(spark, sf_dir, "benchmark").select(
        "item_id", words(F.col("text")).alias("w"), lexical._separators(F.col("text")).alias("s")
    ).select("item_id", "w", "s", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("o"))
    cut = F.expr("case o % 21 " + " ".join(
        f"when {k} then " + " || ".join(["w[o]"] + [f"get(s, o + {j}) || get(w, o + {j})" for j in range(1, n)])
        for k, n in _RUNS.items()) + " end")
    return runs.filter(F.size("w") > 0).select(
        cut.alias("surface"), F.expr("case (item_id + o) % 2 when 0 then 'PERSON' else 'ORG' end").alias("label"), "o"
    ).filter("surface is not null and (o % 21 <> 0 or length(surface) > 7)").select("surface", "label")


def known(spark, sf_dir):
    return lexical.dictionary(gazetteer(spark, sf_dir))


@query("ex8_gazetteer_entities", f"WITH {DOCS}, {GAZETTEER}, {ENTITIES} SELECT * FROM e")
def gazetteer_entities(spark, sf_dir):
    return lexical.gazetteer_entities(
        documents(spark, sf_dir), known(spark, sf_dir)
    ).withColumn("pos", F.col("pos").cast("bigint"))


# candidates are all entries; a walk from the left takes the longest at each place
# where it arrives and goes on behind it
MENTIONS = f"""el AS (SELECT *, len(regexp_extract_all(surface, '{WORDS}')) AS words FROM e),
at_place AS (SELECT doc_id, pos, max(words) AS words FROM el GROUP BY doc_id, pos),
nx AS (SELECT a.doc_id, a.pos, a.words, b.pos AS nxt FROM at_place a ASOF LEFT JOIN at_place b ON a.doc_id = b.doc_id AND a.pos + a.words <= b.pos),
walk AS (SELECT * FROM nx WHERE (doc_id, pos) IN (SELECT (doc_id, min(pos)) FROM at_place GROUP BY doc_id)
 UNION ALL SELECT nx.* FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.pos = walk.nxt),
m AS (SELECT el.* FROM walk JOIN el USING (doc_id, pos, words))"""


@query("ex8_longest_mentions", f"WITH RECURSIVE {DOCS}, {GAZETTEER}, {ENTITIES}, {MENTIONS} SELECT doc_id, pos, words, label, surface FROM m")
def longest_mentions(spark, sf_dir):
    return lexical.longest_mentions(documents(spark, sf_dir), known(spark, sf_dir)).withColumns(
        {c: F.col(c).cast("bigint") for c in ("pos", "words")})


@query("ex9_page_mentions", f"""WITH RECURSIVE {PAGES}, pd AS (SELECT {{'doc_id': doc_id, 'page': page}} AS doc_id, text FROM p),
 {GAZETTEER}, {ENTITIES.replace(" FROM d)", " FROM pd)")}, {MENTIONS} SELECT doc_id.doc_id AS doc_id, doc_id.page AS page, pos, label, surface FROM m""")
def page_mentions(spark, sf_dir):
    pages = _page_table(spark, sf_dir).select(F.struct("doc_id", "page").alias("doc_id"), "text")
    return lexical.longest_mentions(pages, known(spark, sf_dir)).select(
        "doc_id.doc_id", F.col("doc_id.page").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("pos"), "label", "surface")


@query("ex9_page_entities", f"""WITH {PAGES} SELECT doc_id, page, text,
 array_to_string({sql_emails('text')}, '|') AS emails, array_to_string({sql_phones('text')}, '|') AS phones,
 {_present_sql('text')} AS clauses_found, array_to_string({sql_signers('text')}, '|') AS signers FROM p""")
def page_entities(spark, sf_dir):
    r = pages_op.page_result(F.col("page"), F.col("text"))
    return _page_table(spark, sf_dir).select("doc_id", r.alias("r")).select(
        "doc_id", F.col("r.page").cast("bigint").alias("page"), "r.text",
        *[_joined(F.col(f"r.{c}")).alias(c) for c in ("emails", "phones", "clauses_found", "signers")],
    )


DISTINCT = ", ".join(
    f"array_to_string(list_sort(list_distinct({sql('text')})), '|') AS {name}"
    for name, sql in (("emails", sql_emails), ("phones", sql_phones), ("dates", sql_dates), ("signers", sql_signers))
)


@query("ag6_distinct_values", f"WITH {DOCS} SELECT doc_id, {DISTINCT} FROM d")
def distinct_values(spark, sf_dir):
    found = {"emails": extract.emails, "phones": extract.phones,
             "dates": extract.dates, "signers": extract.signers}
    return documents(spark, sf_dir).select("doc_id", *[
        _joined(extract.distinct_sorted(f(F.col("text")))).alias(n) for n, f in found.items()
    ])


TOTAL_CLAUSES = " + ".join(sql_keyword_count("text", kw) for kw in CLAUSE_KEYWORDS)


@query("ag9_total_clauses", f"WITH {DOCS} SELECT doc_id, {TOTAL_CLAUSES} AS total_clauses FROM d")
def total_clauses(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", extract.total_clauses(
        extract.clause_counts(F.col("text"))).cast("bigint").alias("total_clauses"))


# names per document come from the dictionary
NAMES = "nm AS (SELECT doc_id, count(DISTINCT surface) AS total_names FROM e WHERE label = 'PERSON' GROUP BY doc_id)"
SCORES = f"""{DOCS}, {GAZETTEER}, {ENTITIES}, {NAMES},
c AS (SELECT d.doc_id, filename, coalesce(total_names, 0) AS total_names,
 len(list_distinct({sql_emails('text')})) AS total_emails, len(list_distinct({sql_phones('text')})) AS total_phones,
 len(list_distinct({sql_signers('text')})) AS total_signers, {TOTAL_CLAUSES} AS total_clauses
 FROM d LEFT JOIN nm USING (doc_id)),
s AS (SELECT *, least(100, least(40, 2 * total_names) + least(30, 4 * total_clauses)
 + least(30, 2 * (total_emails + total_phones))) AS legality_score FROM c)"""


def scored(spark, sf_dir):
    return rule_scores(lexical.with_names(documents(spark, sf_dir), known(spark, sf_dir), longest=False))


@query("sc1_legality_score", f"""WITH {SCORES} SELECT doc_id, total_names, total_emails, total_phones,
 total_signers, total_clauses, legality_score FROM s""")
def legality_score(spark, sf_dir):
    counts = ("total_names", "total_emails", "total_phones", "total_signers", "total_clauses",
              "legality_score")
    return scored(spark, sf_dir).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts])


_prompt = VERDICT_PROMPT.replace("'", "''")


@query("sc2_verdict_prompt", f"WITH {DOCS} SELECT doc_id, '{_prompt}' || substring(text, 1, 2000) AS prompt FROM d")
def verdict_prompts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", score.verdict_prompt(F.col("text")).alias("prompt"))


VERDICTS = f"""vr AS (SELECT doc_id, {sql_strip('raw')} AS raw FROM d),
vj AS (SELECT doc_id, raw, CASE WHEN raw LIKE '{{%' THEN raw ELSE regexp_extract(raw, '(?s)\\{{.*\\}}') END AS j FROM vr),
vp AS (SELECT *, CASE WHEN j <> '' AND json_valid(j) THEN cast(j AS json) END AS o FROM vj),
vt AS (SELECT *, json_type(o, '$.status') AS st, json_type(o, '$.confidence') AS ct, json_extract_string(o, '$.confidence') AS cv FROM vp),
vn AS (SELECT *, CASE WHEN ct IS NULL THEN 0.0 WHEN ct = 'BOOLEAN' THEN (CASE cv WHEN 'true' THEN 1.0 ELSE 0.0 END)
  WHEN ct IN ('NULL', 'ARRAY', 'OBJECT') THEN NULL ELSE try_cast(cv AS double) END AS conf,
  CASE WHEN st IS NULL THEN 'UNVERIFIED' WHEN st = 'VARCHAR' THEN json_extract_string(o, '$.status') END AS status FROM vt),
v AS (SELECT doc_id, raw,
  CASE WHEN j = '' THEN (CASE WHEN contains(upper(raw), 'LEGAL') THEN '✅ LEGAL' ELSE '❌ UNVERIFIED' END)
    WHEN o IS NULL OR conf IS NULL OR status IS NULL THEN '❌ UNVERIFIED'
    WHEN contains(upper(status), 'LEGAL') THEN '✅ LEGAL' ELSE '❌ UNVERIFIED' END AS marker,
  cast(CASE WHEN j = '' THEN try_cast(nullif(regexp_extract(raw, '(\\d{{1,3}})\\s*%', 1), '') AS bigint)
    WHEN o IS NULL OR conf IS NULL OR status IS NULL THEN NULL
    ELSE trunc(greatest(0, least(100, conf))) END AS bigint) AS ai_confidence FROM vn)"""


@query("sc3_verdicts", f"WITH {DOCS}, {VERDICTS} SELECT doc_id, raw, marker, ai_confidence FROM v")
def verdicts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", parse_verdict(F.col("raw")).alias("v")).select(
        "doc_id", "v.raw", "v.marker", F.col("v.ai_confidence").cast("bigint").alias("ai_confidence")
    )


@query("sc4_chart_data", f"""WITH {SCORES}, {VERDICTS} SELECT doc_id, 'NLP Legality Score|AI Confidence' AS labels,
 legality_score AS v1, coalesce(ai_confidence, legality_score) AS v2, coalesce(ai_confidence, legality_score) AS combined
 FROM s JOIN v USING (doc_id)""")
def chart_data(spark, sf_dir):
    replies = documents(spark, sf_dir).select("doc_id", parse_verdict(F.col("raw")).alias("v"))
    chart = score.chart_data(F.col("v.ai_confidence"), F.col("legality_score"))
    return scored(spark, sf_dir).join(replies, "doc_id").select("doc_id", chart.alias("c")).select(
        "doc_id", _joined(F.col("c.labels")).alias("labels"),
        F.col("c.values")[0].cast("bigint").alias("v1"), F.col("c.values")[1].cast("bigint").alias("v2"),
        F.col("c.combined_confidence").cast("bigint").alias("combined"),
    )


@query("sc5_question_prompts", f"""SELECT conv_id, turn, CASE WHEN role = 'user' AND text <> ''
 THEN text || '{QUESTION_LABEL}' || 'What does ' || role || ' say?' || '{ANSWER_LABEL}'
 ELSE '{SUMMARIZE_PROMPT}' || text END AS prompt FROM conversations""")
def question_prompts(spark, sf_dir):
    asked = F.when(F.col("role") == "user", F.concat(F.lit("What does "), "role", F.lit(" say?")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", score.question_prompt(F.col("text"), asked).alias("prompt")
    )


CLEAN = rf"regexp_replace(regexp_replace({sql_strip('text')}, '{WS}+', ' ', 'g'), '[^A-Za-z0-9,.!? ]+', '', 'g')"


@query("tx1_clean_text", f"WITH {DOCS} SELECT doc_id, {CLEAN} AS cleaned FROM d")
def cleaned(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


# A lemma dictionary made of benchmark words: drop a final s.
LEMMAS = f"""lw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORDS}')) AS form FROM benchmark),
lm AS (SELECT form, substring(form, 1, length(form) - 1) AS lemma FROM lw WHERE length(form) > 3 AND form LIKE '%s')"""


def lemma_table(spark, sf_dir):
    forms = table(spark, sf_dir, "benchmark").select(
        F.explode(words(F.col("text"))).alias("form")
    ).distinct()
    return forms.filter((F.length("form") > 3) & F.col("form").endswith("s")).select(
        "form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))


@query("tx2_lemmatize", f"""WITH {DOCS}, {LEMMAS},
c AS (SELECT doc_id, string_split_regex({CLEAN}, ' +') AS w FROM d),
t AS (SELECT doc_id, unnest(w) AS form, generate_subscripts(w, 1) AS pos FROM c)
SELECT doc_id, string_agg(coalesce(lemma, t.form), ' ' ORDER BY pos) AS text FROM t LEFT JOIN lm ON t.form = lm.form GROUP BY doc_id""")
def lemmatized(spark, sf_dir):
    return lexical.lemmatize(documents(spark, sf_dir), lemma_table(spark, sf_dir))


# a dictionary with three endings, and words that stay as they are
_ENDING = """case when form like '%es' then substring(form, 1, length(form) - 2) || 'a'
 when form like '%s' then substring(form, 1, length(form) - 1) else form end"""
_RULES = f"""en AS (SELECT form, {_ENDING} AS lemma FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORDS}')) AS form FROM benchmark) WHERE length(form) > 3),
ed AS (SELECT form, length(form) - common AS cut, substring(lemma, common + 1) AS add FROM (SELECT *, list_max([0] || list_filter(
 range(1, least(length(form), length(lemma)) + 1), lambda n: substring(form, 1, n) = substring(lemma, 1, n))) AS common FROM en)),
sx AS (SELECT right(form, n) AS suffix, cut, add FROM (SELECT *, unnest(range(greatest(cut, 1), greatest(cut, 1, least(length(form), 5)) + 1)) AS n FROM ed WHERE cut <= 5)),
ru AS (SELECT suffix, cut, add, votes FROM (SELECT suffix, cut, add, count(*) AS votes FROM sx GROUP BY suffix, cut, add) WHERE votes >= 2
 QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, cut, add) = 1)"""


def _endings(spark, sf_dir):
    forms = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("form")).distinct()
    return forms.filter("length(form) > 3").select("form", F.expr(_ENDING).alias("lemma"))


@query("tx2_learnt_rules", f"WITH {_RULES} SELECT suffix, cut, add, votes FROM ru")
def learnt_rules(spark, sf_dir):
    return lemma_rules.learn(_endings(spark, sf_dir)).withColumn("cut", F.col("cut").cast("bigint"))


@query("tx2_unseen_lemmas", f"""WITH {_RULES}, fo AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORDS}')) AS form FROM documents),
be AS (SELECT form, suffix, cut, add FROM (SELECT form, right(form, n) AS suffix FROM (SELECT form, unnest(range(1, least(length(form), 5) + 1)) AS n FROM fo))
 JOIN ru USING (suffix) QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) = 1)
SELECT form, coalesce(en.lemma, nullif(substring(form, 1, length(form) - cut) || add, ''), form) AS lemma
FROM fo LEFT JOIN en USING (form) LEFT JOIN be USING (form)""")
def unseen_lemmas(spark, sf_dir):
    known = _endings(spark, sf_dir)
    forms = table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("form"))
    return lemma_rules.apply(forms, known, lemma_rules.learn(known))


TOKENS = f"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{WORDS}'), lambda w: regexp_full_match(w, '\\p{{L}}+')) AS w FROM d),
tp AS (SELECT doc_id, lower(unnest(w)) AS lemma, generate_subscripts(w, 1) - 1 AS pos FROM tk),
t AS (SELECT * FROM tp WHERE lemma NOT IN ({sql_list(lexical.STOP_WORDS)}))"""


@query("tx3_keyword_tokens", f"WITH {DOCS}, {TOKENS} SELECT doc_id, pos, lemma FROM t")
def keyword_tokens(spark, sf_dir):
    return lexical.keyword_tokens(documents(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


COUNTS = f"{TOKENS}, n AS (SELECT doc_id, lemma, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY doc_id, lemma)"


@query("ag7_token_counts", f"WITH {DOCS}, {COUNTS} SELECT doc_id, lemma, n, first_pos FROM n")
def token_counts(spark, sf_dir):
    return lexical.token_counts(documents(spark, sf_dir)).withColumn(
        "first_pos", F.col("first_pos").cast("bigint"))


@query("ag8_max_count", f"""WITH {DOCS}, {COUNTS} SELECT d.doc_id, coalesce(max(n), 1) AS max_n
 FROM d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id""")
def max_count(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return lexical.max_count(docs, lexical.token_counts(docs))


TOP_KEYWORDS = f"""{COUNTS}, k AS (SELECT doc_id, lemma, n,
 row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM n)"""


@query("tk1_top_keywords", f"WITH {DOCS}, {TOP_KEYWORDS} SELECT doc_id, rank, lemma, n FROM k WHERE rank <= 10")
def top_keywords(spark, sf_dir):
    return lexical.top_keywords(documents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query("tk1_top_keywords_lemmas", f"""WITH {DOCS}, {LEMMAS}, {TOKENS},
lt AS (SELECT doc_id, coalesce(lm.lemma, t.lemma) AS lemma, pos FROM t LEFT JOIN lm ON t.lemma = lm.form),
n AS (SELECT doc_id, lemma, count(*) AS n, min(pos) AS first_pos FROM lt GROUP BY doc_id, lemma),
k AS (SELECT doc_id, lemma, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM n)
SELECT doc_id, rank, lemma, n FROM k WHERE rank <= 10""")
def top_keywords_lemmas(spark, sf_dir):
    return lexical.top_keywords(
        documents(spark, sf_dir), lemmas=lemma_table(spark, sf_dir)
    ).withColumn("rank", F.col("rank").cast("bigint"))
