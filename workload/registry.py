"""Registry and shared inputs of the queries.

Inputs are the given tables. The documents hold no dates, signers or clause
keywords, so every text gets a suffix built from its ``doc_id``. The expressions
below are read by both Spark and the SQL engine, which keeps the inputs equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.fixed_values import EMAIL_PATTERN, PHONE_PATTERN, SIGNER_PATTERN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT = """text || chr(10)
 || 'Contact a' || cast(doc_id % 50 as string) || '.b@mail' || cast(doc_id % 7 as string)
 || '.example.org. Or call +44 20-7946 0' || lpad(cast(doc_id % 1000 as string), 3, '0')
 || ' today. Paid ' || cast(1 + doc_id % 14 as string) || '/' || cast(1 + doc_id % 31 as string)
 || case doc_id % 4 when 0 then '/2021' when 1 then '-21' when 2 then '/99' else '/099' end
 || ', thank you!' || repeat(' The payment is due under this Agreement.', cast(doc_id % 4 as int))
 || case doc_id % 3 when 0 then chr(10) || 'Termination and LIABILITY follow the governing law.'
    when 1 then ' Payments end the dispute' || chr(10) || 'obligation by order of the court?' else '' end
 || case doc_id % 5 when 0 then ' Signed by: Ann Bell' || chr(10) || 'Carl Dunn'
    when 1 then ' ATTESTED BY - notary' || cast(doc_id as string)
    when 2 then chr(10) || '  Signature Ann Bell. Signature Ann Bell.' else '' end"""

FILENAME = """case doc_id % 9 when 0 then 'scan' || cast(doc_id as string) || '.pdf'
 when 1 then 'a.b.PDF' when 2 then 'pdf' when 3 then 'notes.txt' when 4 then 'x.Docx'
 when 5 then 'p.tiff' when 6 then '' when 7 then 'sheet.xlsx'
 else 'photo' || cast(doc_id as string) || '.jpeg' end"""

REPLY = """case doc_id % 15
 when 0 then '{"status":"LEGAL","confidence":' || cast(doc_id % 150 as string) || '}'
 when 1 then 'Sure: {"status":"illegal","confidence":"' || cast(doc_id % 90 as string) || '.9"} bye'
 when 2 then '{"status":"LEGAL","confidence":50} thanks'
 when 3 then '{"status":"LEGAL","confidence":null}'
 when 4 then 'It is legal, I am ' || cast(doc_id as string) || ' % sure'
 when 5 then 'cannot tell'
 when 6 then '{"confidence":true}'
 when 7 then '{"status":7,"confidence":10}'
 when 8 then '{"status":"UNVERIFIED","confidence":"-' || cast(doc_id as string) || '"}'
 when 9 then '{"status":"LEGAL","confidence":"high"}'
 when 10 then '  ' || chr(10) || '{"status":"Legal"}' || chr(10)
 when 11 then '{"status":"LEGAL","confidence":[1]}'
 when 12 then '{status: LEGAL, confidence 80%}'
 when 13 then 'LEGAL 1234% or 12%'
 else '' end"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, filename, raw`` (a verdict reply)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(TEXT).alias("text"), F.expr(FILENAME).alias("filename"),
        F.expr(REPLY).alias("raw"),
    )


# --- SQL fragments ----------------------------------------------------------

DOCS = f"d AS (SELECT doc_id, {TEXT} AS text, {FILENAME} AS filename, {REPLY} AS raw FROM documents)"

_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
WS, NOT_WS = f"[{_WS}]", f"[^{_WS}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WORDS = r"[\p{L}\p{N}_]+"

def sql_emails(x: str) -> str:
    return f"regexp_extract_all({x}, '{EMAIL_PATTERN}')"


def sql_phones(x: str) -> str:
    pattern = PHONE_PATTERN.replace(r"\d", r"\p{Nd}").replace(r"\s", _WS)
    return f"regexp_extract_all({x}, '{pattern}')"


def sql_signers(x: str) -> str:
    return f"regexp_extract_all({x}, '(?i){SIGNER_PATTERN}', 2)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_not_blank(x: str) -> str:
    return f"regexp_matches({x}, '{NOT_WS}')"


def sql_sentences(x: str) -> str:
    return f"string_split(regexp_replace({sql_strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def sql_keyword_count(x: str, kw: str) -> str:
    """Whole-word count; separators are doubled so that matches never share one."""
    kw = kw.replace(" ", "  ")
    doubled = f"regexp_replace({x}, '({NOT_WORD})', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '(?i)(?:^|{NOT_WORD}){kw}(?:$|{NOT_WORD})'))"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_iso_date(x: str) -> str:
    """ISO text of one matched date, month first, then day first."""
    p = f"string_split_regex({x}, '[/-]')"
    year = (f"CASE len({p}[3]) WHEN 4 THEN {p}[3] WHEN 2 THEN "
            f"(CASE WHEN {p}[3] >= '69' THEN '19' ELSE '20' END) || {p}[3] END")
    def parsed(m, d):
        return f"try_strptime({p}[{m}] || '/' || {p}[{d}] || '/' || ({year}), '%m/%d/%Y')"
    return f"strftime(coalesce({parsed(1, 2)}, {parsed(2, 1)}), '%Y-%m-%d')"


def sql_dates(x: str) -> str:
    """Separators are doubled first, as two dates may share the one between them."""
    doubled = f"regexp_replace({x}, '({NOT_WORD})', '\\1\\1', 'g')"
    day = r"\p{Nd}{1,2}(?://|--)\p{Nd}{1,2}(?://|--)\p{Nd}{2,4}"
    raw = f"regexp_extract_all({doubled}, '(?:^|{NOT_WORD})({day})(?:$|{NOT_WORD})', 1)"
    iso = sql_iso_date("replace(replace(r, '//', '/'), '--', '-')")
    return (f"list_filter(list_transform({raw}, lambda r: {iso}), lambda r: r IS NOT NULL)")
