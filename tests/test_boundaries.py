"""Learnt sentence boundaries against a plain walk."""

import re
import time

import pytest
from pyspark.sql import functions as F

from docmill.functions.wordwise import bare, best_sentences, sentence_list
from docmill.operators import boundaries, lexical, summaries
from tests import twins

CORPUS = ["See Art. 5 and Art. 6 here. It ends. Then Inc. goes on, Inc. stays.", "Art. 9 is it. Art. 1 too? Yes!  No. 5 stays", "It ends. It ends.",
          "Inc. and inc. and (Inc. or Inc. 4). The end.", "", None, "  .  ...  e.g.. x", "Art. 2\tand\nArt. 3.", "Inc. if"]


def counted(texts):
    out = {}
    for t in texts:
        tokens = (t or "").split()
        for token, after in zip(tokens, tokens[1:] + [""]):
            word = re.sub(r"^\W+|\W+$", "", token).lower()
            if word:
                dot = bool(re.search(r"\w\.$", token))
                n = out.setdefault(word, [0, 0, 0])
                n[0] += dot
                n[1] += not dot
                n[2] += dot and (after[:1].islower() or after[:1].isdecimal())
    return {w: tuple(n) for w, n in out.items()}


def test_counts_and_decision(spark):
    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    counts = boundaries.abbreviation_counts(df)
    want = counted(CORPUS)
    assert {r.word: (r.n_dot, r.n_plain, r.n_on) for r in counts.collect()} == want
    got = {r.word for r in boundaries.abbreviations(counts).collect()}
    assert got == {w for w, (d, p, o) in want.items() if d >= 5 and d >= 0.9 * (d + p) and o >= 0.3 * d} == {"art", "inc"}
    assert boundaries.abbreviation_counts(df.limit(0)).count() == 0


def test_sentences(spark):
    known = frozenset({"art", "inc"})
    assert sentence_list("See Art. 5 and Inc. here. (Art. 2) It ends! Art.. Next", known) == \
        ["See Art. 5 and Inc. here.", "(Art. 2) It ends!", "Art..", "Next"]
    for t in CORPUS:
        if t is not None:
            assert sentence_list(t) == twins.split_sentences(t) == sentence_list(t, frozenset({"unused"}))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CORPUS)], "doc_id int, text string")
    learnt = boundaries.known_words(boundaries.abbreviations(boundaries.abbreviation_counts(df)))
    rows = df.select("doc_id", boundaries.sentences(F.col("text"), learnt).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {k: None if t is None else sentence_list(t, known) for k, t in enumerate(CORPUS)}


def test_summaries_take_learnt_boundaries(spark):
    text = "Under Art. 5 of the act the payment falls due at once. It ends here for now."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    known = spark.sparkContext.broadcast(frozenset({"art"}))
    fixed, learnt = (lexical.frequency_summary(df, k=1, abbreviations=a).first().summary for a in (None, known))
    assert fixed == "5 of the act the payment falls due at once." and learnt == text[:54]
    assert learnt == best_sentences(text, 1, 20, frozenset(lexical.STOP_WORDS), {}, frozenset({"art"}))
    one = df.select(summaries.heuristic_summary(F.col("text"), 1, listed=boundaries.sentences(F.col("text"), known)).alias("s")).first().s
    assert one == text[:54]


def test_counting_runs_once_and_marks_inside_a_token_cost_no_square(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(t,) for t in CORPUS if t], "text string").mapInArrow(passed, "text string")
    known = boundaries.known_words(boundaries.abbreviations(boundaries.abbreviation_counts(rows)))
    assert known.value == {"art", "inc"} and seen.value == sum(1 for t in CORPUS if t)
    token = "(a" + "-" * 1_000_000 + "b."
    start = time.monotonic()
    assert bare(token) == token[1:-1] and bare("--") == bare("") == "" and bare("_x!") == "_x"
    assert sentence_list(f"{token} And {token} So.", frozenset({token[1:-1]})) == [f"{token} And {token} So."]
    assert time.monotonic() - start < 5
    with pytest.raises(ValueError):
        boundaries.known_words(spark.createDataFrame([("a",), ("b",)], "word string"), max_rows=1)
