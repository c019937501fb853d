"""Sentence boundaries that know abbreviations.

Whether a word is an abbreviation is learnt from the corpus: one that hardly ever
stands without a full stop, and whose full stop is often followed by a small letter or
a digit, does not end a sentence (``Art. 5``, ``Inc. and``). Learning is one
aggregation over word types; splitting is done inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmill.functions import wordwise

# Parameters of the decision.
LEAST, DOT_SHARE, ON_SHARE, MOST_CHARS = 5, 0.9, 0.3, 8

def abbreviation_counts(docs: DataFrame) -> DataFrame:
    """``word, n_dot, n_plain, n_on`` over ``docs (text)``: how often a word, in lower case and
    without marks at its ends, stands with a full stop, without, and with one that a small
    letter or a digit follows. Null texts count nothing. Tasks add up before the shuffle."""
    partial = docs.select("text").mapInArrow(
        wordwise.stop_counts, "word string, n_dot long, n_plain long, n_on long")
    return partial.groupBy(F.lower("word").alias("word")).agg(
        *[F.sum(n).alias(n) for n in ("n_dot", "n_plain", "n_on")])


def abbreviations(counts: DataFrame, least: int = LEAST, dot_share: float = DOT_SHARE, on_share: float = ON_SHARE,
                  most_chars: int = MOST_CHARS) -> DataFrame:
    """``(word)``: the words of ``counts`` that pass for abbreviations."""
    return counts.where(
        (F.col("n_dot") >= least) & (F.length("word") <= most_chars)
        & (F.col("n_dot") >= dot_share * (F.col("n_dot") + F.col("n_plain")))
        & (F.col("n_on") >= on_share * F.col("n_dot"))).select("word")


def known_words(words: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20):
    """A broadcast set of ``(word)``, measured as it comes; none of them may be dropped, so a
    table too large for it is an error (ask for more evidence then). ``words`` runs once."""
    found = [r.word for r in words.limit(max_rows + 1).collect()]
    if len(found) > max_rows or sum(len(w.encode()) for w in found) > max_bytes:
        raise ValueError("too many abbreviations to broadcast; raise `least` or the shares")
    return words.sparkSession.sparkContext.broadcast(frozenset(found))


def sentences(text: Column, known) -> Column:
    """The sentences of a text; ``known`` comes from :func:`known_words`."""
    return wordwise.split_sentences(text, known)
