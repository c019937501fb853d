import re
import time

import pytest
from pyspark.sql import functions as F

from docmill import fixed_values as fixed
from docmill.functions import extract
from tests import twins

HOSTILE = [
    "a.b@c.co.uk. and x@y-z.org", "a@b.c_d@e.f", "@x.y a@ b@c d@e. @@a@b.c", "a@b.c@d.e+f@g.h",
    "12-12-2020", "+44 20-7946\n0958 x ٠١٢٣٤٥٦٧٨٩", "+1234567 12345678 1 2 3 4 5 6 7 8 9",
    "1\u00a02\u00a03-4\u20035 6 7 8 9",
    "Signed by: John Smith and acme\nSignature of the party",
    "SIGNATURE - Ann, attested by Bob\u00a0Lee. authorized signatory\n:\n x1", "ſigned by Al",
    "signature signature signature", "signed by:: X", "signed by -\n\n",
]


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("column, plain", [
    (extract.emails, lambda t: re.findall(fixed.EMAIL_PATTERN, t)),
    (extract.phones, lambda t: re.findall(fixed.PHONE_PATTERN, t)),
    (extract.raw_dates, lambda t: re.findall(fixed.DATE_PATTERN, t)),
    (extract.signers,
     lambda t: [m.group(2) for m in re.finditer(fixed.SIGNER_PATTERN, t, re.IGNORECASE)]),
])
def test_extraction_equals_the_plain_pattern(spark, decorated, column, plain):
    texts = HOSTILE + [r.text for r in decorated]
    got = run(spark, texts, column(F.col("x")))
    assert got == [plain(t) for t in texts]
    assert any(got)


def test_hand_cases(spark):
    texts = HOSTILE[:1] + HOSTILE[4:5] + HOSTILE[8:9]
    assert run(spark, texts, extract.emails(F.col("x")))[0] == ["a.b@c.co.uk.", "x@y-z.org"]
    assert run(spark, texts, extract.phones(F.col("x")))[1] == ["12-12-2020"]
    assert run(spark, texts, extract.signers(F.col("x")))[2] == [
        "John Smith and acme\nSignature of the party"]


def test_dates_month_first_then_day_first(spark):
    raw = ["3/14/2021", "14/3/21", "13/13/2020", "1/2/099", "12/31/99", "2-29/2020", "29-02-2021",
           "1/1/68", "1/1/69", "00/10/2020"]
    assert run(spark, raw, extract.parse_date(F.col("x"))) == [
        "2021-03-14", "2021-03-14", None, None, "1999-12-31", "2020-02-29", None,
        "2068-01-01", "1969-01-01", None]
    assert run(spark, [" ".join(raw)], extract.dates(F.col("x")))[0] == [
        "2021-03-14", "2021-03-14", "1999-12-31", "2020-02-29", "2068-01-01", "1969-01-01"]


def test_clause_hand_cases(spark):
    got = run(spark, ["payments Payment épayment payment payment²", "governing\nlaw governing law"],
              extract.clause_counts(F.col("x")))
    assert got[0]["payment"] == 2 and got[1]["governing law"] == 1
    assert set(got[0]) == set(fixed.CLAUSE_KEYWORDS)
    assert run(spark, [""], extract.clauses_present(F.col("x")))[0] == []


@pytest.mark.parametrize("keywords", [
    fixed.CLAUSE_KEYWORDS,
    ("the", "le", "of the", "THE", "e"),
    ("é", "the", "thé"),
    ("c++", "c", "+44", "a.b"),
])
def test_clause_counts_equal_one_scan_per_keyword(spark, decorated, keywords):
    texts = ["c++ C++x c +44 +44 a.b aXb", "dıspute DiſPUTE thé the The\u0301 e"]
    texts += [r.text for r in decorated]
    got = run(spark, texts, extract.clause_counts(F.col("x"), keywords))
    present = run(spark, texts, extract.clauses_present(F.col("x"), keywords))
    for text, counts, names in zip(texts, got, present):
        expected = {kw: twins.count_keyword(text, kw) for kw in keywords}
        assert counts == expected
        assert names == [kw for kw in keywords if expected[kw]]


def test_keywords_sharing_a_word_are_scanned_apart():
    groups = extract._disjoint_groups(("the", "of the", "law", "of"))
    assert groups == [["the", "law", "of"], ["of the"]]
    assert len(extract._disjoint_groups(fixed.CLAUSE_KEYWORDS)) == 1


def test_hostile_length_costs_neither_stack_nor_quadratic_time(spark):
    unpunctuated = "signed by " + "word " * 200_000 + "end"
    junk = "x" * 1_000_000 + " a@b.c"
    spaces = "signed by" + " " * 300_000 + "1"
    start = time.time()
    signers = run(spark, [unpunctuated, junk, spaces], extract.signers(F.col("x")))
    assert signers[0] == [unpunctuated.removeprefix("signed by ")]
    assert run(spark, [unpunctuated, junk, spaces], extract.emails(F.col("x")))[1] == ["a@b.c"]
    assert time.time() - start < 30
