import pytest
from pyspark.sql import functions as F

from docmill.fixed_values import MARKER_LEGAL, MARKER_UNVERIFIED
from docmill.functions import score
from docmill.functions.verdict import parse_verdict

REPLIES = [
    ('{"status":"ILLEGAL","confidence":"85.9"}', True, 85),
    ('pre {"status":"legal","confidence":150} post', True, 100),
    ('{"status":"LEGAL"} thanks', False, None),
    ('{"status":"LEGAL","confidence":null}', False, None),
    ("LEGAL 250 %", True, 250),
    ("legal 1234% or 5%", True, 234),
    ("no idea", False, None),
    ("", False, None),
    ("{}", False, 0),
    ('{"status":5,"confidence":1}', False, None),
    ('{"status":null}', False, None),
    ('{"status":{"LEGAL":1}}', False, None),
    ('{"confidence":true,"status":"LEGAL"}', True, 1),
    ('{"confidence":false}', False, 0),
    ('{"status":"LEGAL","confidence":[1]}', False, None),
    ('{"status":"LEGAL","confidence":{"a":1}}', False, None),
    ('{"status":"LEGAL","confidence":"high"}', False, None),
    ('{"status":"LEGAL","confidence":"85d"}', False, None),
    ('{"status":"LEGAL","confidence":"1e400"}', False, None),
    ('{"status":"LEGAL","confidence":"nan"}', False, None),
    ('{"status":"LEGAL","confidence":" 1_0 "}', True, 10),
    ('{"status":"LEGAL","confidence":"1e1"}', True, 10),
    ('{"status":"LEGAL","confidence":-3.5}', True, 0),
    ('{"status":"LEGAL","confidence":1e30}', True, 100),
    ('{"status":"LEGAL","confidence":99.99}', True, 99),
    ('{"a":1},{"b":2}', False, None),
    ("{'status':'LEGAL'}", False, None),
    ("x } LEGAL { 40%", True, 40),
    (' \n{"status":"Legal","confidence":7}\n ', True, 7),
    ('```json\n{"status":"UNVERIFIED","confidence":20}\n```', False, 20),
    (None, False, None),
]


def test_verdict_table(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, r string")
    got = df.orderBy("i").select(parse_verdict(F.col("r")).alias("v")).collect()
    for (reply, legal, confidence), row in zip(REPLIES, got):
        expected = MARKER_LEGAL if legal else MARKER_UNVERIFIED
        assert (row.v.marker, row.v.ai_confidence) == (expected, confidence), reply


@pytest.mark.parametrize("names, clauses, emails, phones, expected", [
    (0, 0, 0, 0, 0), (3, 2, 1, 1, 18), (100, 0, 0, 0, 40), (0, 100, 0, 0, 30),
    (0, 0, 9, 9, 30), (99, 99, 99, 99, 100),
])
def test_legality_score(spark, names, clauses, emails, phones, expected):
    parts = [F.lit(x) for x in (names, clauses, emails, phones)]
    assert spark.range(1).select(score.legality_score(*parts).alias("s")).first()["s"] == expected


def test_prompts_and_chart(spark):
    df = spark.createDataFrame(
        [("t" * 3000, "why?", 90, 40), ("t", "", None, 40), ("t", None, None, 40)],
        "text string, question string, ai int, score int")
    rows = df.select(
        score.verdict_prompt(F.col("text")).alias("v"),
        score.question_prompt(F.col("text"), F.col("question")).alias("q"),
        score.chart_data(F.col("ai"), F.col("score")).alias("c"),
    ).collect()
    assert rows[0].v.endswith("\n" + "t" * 2000)
    assert rows[0].q.endswith("t\n\nQuestion: why?\nAnswer briefly:")
    assert rows[1].q == rows[2].q and rows[1].q.endswith("\n\nt")
    assert (rows[0].c.asDict()["values"], rows[0].c.combined_confidence) == ([40, 90], 90)
    assert (rows[1].c.asDict()["values"], rows[1].c.combined_confidence) == ([40, 40], 40)
