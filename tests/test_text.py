import random
import re

from pyspark.sql import functions as F

from docmill.functions import text as T
from tests import twins

# every character Python calls whitespace
SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_takes_every_kind_of_whitespace(spark):
    values = ["  \n hi ", "", " \t", "a b", *[f"{s}x{s}y{s}" for s in SPACES]]
    assert results(column(spark, values), T.strip(F.col("x"))) == [v.strip() for v in values]


def test_blank_and_word_pieces(spark):
    values = ["", " \x1c\x85 ", "a", *[f"{s}x{s}{s}y" for s in SPACES]]
    df = column(spark, values)
    assert results(df, T.is_blank(F.col("x"))) == [not v.strip() for v in values]
    assert results(df, T.split_space(F.col("x"))) == [v.split() for v in values]


def test_words_follow_python_word_class(spark):
    values = ["a_b é2 x² e\u0301f 一二 ½", "ab1 cd", ""]
    df = column(spark, values)
    assert results(df, T.words(F.col("x"))) == [re.findall(r"\w+", v) for v in values]
    assert results(df, T.alphabetic_words(F.col("x"))) == [
        [w for w in re.findall(r"\w+", v) if w.isalpha()] for v in values
    ]


def test_sentences(spark, decorated):
    values = ["One. Two!  Three?\n\nFour", "no end", "", "a.b. c", *[r.text for r in decorated]]
    assert results(column(spark, values), T.sentences(F.col("x"))) == [
        twins.split_sentences(v) for v in values
    ]


def test_clean_text(spark, decorated):
    sample = "\n  This is   a sample!\n Números 1234; (walked)\t ok?  "
    values = [sample, None, "", *[r.text for r in decorated]]
    expected = [
        re.sub("[^A-Za-z0-9,.!? ]+", "", " ".join(v.split())) if v else "" for v in values
    ]
    assert expected[0] == "This is a sample! Nmeros 1234 walked ok?"
    assert results(column(spark, values), T.clean_text(F.col("x"))) == expected


def test_round_half_even_on_the_exact_value(spark):
    rng = random.Random(7)
    values = [0.0, 0.125, 0.375, 2.675, 1.005, 26.675, 99.995, 0.005, 0.015, 100.0, 33.335]
    values += [s / n for n in (8, 40, 200, 1000, 997) for s in rng.sample(range(100 * n), 300)]
    assert results(column(spark, values, "double"), T.round_half_even_2(F.col("x"))) == [
        round(v, 2) for v in values
    ]


def test_join_in_order_after_a_shuffle(spark):
    rows = [(1, i, f"s{i}") for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, pos int, s string").repartition(7)
    joined = df.groupBy("k").agg(T.join_in_order(F.col("pos"), F.col("s"), "|").alias("j")).first()
    assert joined["j"] == "|".join(f"s{i}" for i in range(200))


def test_word_work_holds_the_objects_of_few_values():
    import pyarrow as pa

    from docmill.functions import wordwise

    alive, most = [0], [0]

    class Counted(list):
        def __init__(self):
            super().__init__([1])
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    values = pa.array([None, *map(str, range(2000))])
    out = wordwise.in_slices(lambda v: Counted(), values, pa.list_(pa.int64()))
    assert out.to_pylist() == [None] + [[1]] * 2000 and most[0] <= 2 * wordwise.SLICE
    assert len(wordwise.in_slices(len, values[:0], pa.int64())) == 0
