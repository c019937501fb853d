"""Word-level operators: keywords, lemmas, dictionary entities, frequency summary.

Everything that one text decides, counts, keywords, summaries, lemmas and mentions of
dictionary entries, is computed inside its row; dictionaries are broadcast once they
are measured to be small. With a larger table of lemmas, the texts are shuffled once,
by ``doc_id``, before they are split into words; all later grouping and ranking is
within a document and reuses that partitioning. Rows without a ``doc_id`` are left out
there, and rows that share one count as one document; in the row, neither happens.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmill.fixed_values import (
    KEYWORDS_KEPT, NO_SUMMARY, SUMMARY_MIN_CHARS, SUMMARY_SENTENCES,
)
from docmill.functions.text import (
    SPACE, WORD, alphabetic_words, bind, clean_text, join_in_order, sentences, words,
)
from docmill.functions import wordwise
from docmill.session import broadcast_if_small, is_small

# A short default; pass the list that suits the language at hand.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be",
    "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has",
    "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "may", "me", "more", "most", "my", "no", "not", "of", "on", "only", "or", "other",
    "our", "out", "over", "she", "should", "so", "some", "such", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "those", "to", "under",
    "up", "upon", "was", "we", "were", "what", "when", "which", "who", "will", "with",
    "would", "you", "your",
)


def _by_document(docs: DataFrame) -> DataFrame:
    """The one shuffle. It carries exactly ``(doc_id, text)``, so that all
    operators used on the same documents in one query share it."""
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").repartition("doc_id")


def _lemma_of(tokens: DataFrame, form: str, lemmas: DataFrame | None) -> DataFrame:
    """Replace ``form`` by its lemma where the dictionary has one."""
    if lemmas is None:
        return tokens
    dictionary = broadcast_if_small(
        lemmas.select(F.col("form").alias(form), F.col("lemma").alias("_lemma"))
        .groupBy(form).agg(F.min("_lemma").alias("_lemma"))
    )
    return (
        tokens.join(dictionary, form, "left")
        .withColumn(form, F.coalesce("_lemma", form))
        .drop("_lemma")
    )


def _in_rows(lemmas: DataFrame | None, rules: DataFrame | None = None):
    """A broadcast dictionary ``form -> lemma`` if ``lemmas`` is small, else None; with
    suffix ``rules`` (see ``lemma_rules``) for the forms that it lacks."""
    if lemmas is None:
        return None
    table = lemmas.where("form is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    if not is_small(table) or rules is not None and not is_small(rules):
        if rules is not None:
            raise ValueError("rules need tables that are small; see lemma_rules.apply for larger ones")
        return None
    known = {r.form: r.lemma for r in table.collect() if r.lemma is not None}
    if rules is not None:
        known = wordwise.Lemmas(known, {r.suffix: (r.cut, r.add) for r in rules.collect()})
    return lemmas.sparkSession.sparkContext.broadcast(known)


def keyword_tokens(
    docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, pos, lemma)``: alphabetic, no stop word, lower case."""
    source = docs if lemmas is None else _by_document(docs)
    tokens = (
        source.select("doc_id", F.posexplode(alphabetic_words(F.col("text"))).alias("pos", "word"))
        .select("doc_id", "pos", F.lower("word").alias("lemma"))
        .filter(~F.col("lemma").isin(*stop_words))
    )
    return _lemma_of(tokens, "lemma", lemmas)


def token_counts(
    docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, lemma, n, first_pos)``; with a small dictionary or none nothing is shuffled."""
    known = _in_rows(lemmas, rules)
    if lemmas is None or known:
        return docs.select("doc_id", F.inline(wordwise.word_counts(F.col("text"), stop_words, known)))
    return keyword_tokens(docs, stop_words, lemmas).groupBy("doc_id", "lemma").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )


def max_count(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``(doc_id, max_n)`` for every document; 1 if it has no token."""
    highest = counts.groupBy("doc_id").agg(F.max("n").alias("max_n"))
    return docs.select("doc_id").join(highest, "doc_id", "left").select(
        "doc_id", F.coalesce("max_n", F.lit(1)).alias("max_n")
    )


def top_keywords(
    docs: DataFrame, k: int = KEYWORDS_KEPT, stop_words: Sequence[str] = STOP_WORDS,
    lemmas: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, rank, lemma, n)``: most common lemmas, ties by first occurrence."""
    known = _in_rows(lemmas, rules)
    if lemmas is None or known:
        return docs.select("doc_id", F.inline(wordwise.top_words(F.col("text"), k, stop_words, known)))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return (
        token_counts(docs, stop_words, lemmas)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("doc_id", "rank", "lemma", "n")
    )


def keyword_frequency(top: DataFrame) -> DataFrame:
    """``(doc_id, keyword_frequency array<struct<rank,lemma,n>>)``."""
    return top.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "lemma", "n"))).alias("keyword_frequency")
    )


def lemmatize(docs: DataFrame, lemmas: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text)``: cleaned text with each word replaced by its lemma."""
    known = _in_rows(lemmas, rules)
    if known:
        return docs.select("doc_id", wordwise.replaced_words(clean_text(F.col("text")), known).alias("text"))
    tokens = _by_document(docs).select(
        "doc_id", F.posexplode(F.split(clean_text(F.col("text")), " +")).alias("pos", "form")
    )
    return _lemma_of(tokens, "form", lemmas).groupBy("doc_id").agg(
        join_in_order(F.col("pos"), F.col("form"), " ").alias("text")
    )


class Dictionary(NamedTuple):
    """Entries ``(key, surface, label, first, words)`` of a gazetteer: what they are
    compared by, their first word and number of words; and, if they are few, the
    automaton of all of them as a broadcast variable."""
    entries: DataFrame
    trie: Any


def _separators(text: Column) -> Column:
    """What stands around the words of a text, whitespace as one space: the part
    before word ``i`` is entry ``i``."""
    return F.transform(
        F.split(text, f"{WORD}+", -1),
        lambda x: F.when(x.rlike(rf"(?U)^{SPACE}+$"), F.lit(" ")).otherwise(x),
    )


def dictionary(gazetteer: DataFrame) -> Dictionary:
    """Distinct entries of ``gazetteer (surface, label)``, built into an automaton if
    measured small. An entry is compared by its words and what stands between them;
    entries without a word are left out."""
    parts = gazetteer.select(
        "surface", "label", words(F.col("surface")).alias("w"), _separators(F.col("surface")).alias("s")
    ).filter(F.size("w") > 0).distinct()
    pieces = F.transform("w", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get("s", i), x)))
    entries = parts.select(F.array_join(pieces, "").alias("key"), "surface", "label",
                           F.get("w", F.lit(0)).alias("first"), F.size("w").alias("words"))
    if not is_small(parts):
        return Dictionary(entries, None)
    rows = sorted((r.w, r.s, (r.label, r.surface)) for r in parts.collect())
    return Dictionary(entries, gazetteer.sparkSession.sparkContext.broadcast(wordwise.WordTrie(rows)))


def _looked_up(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """``doc_id, pos, words, label, surface`` with a dictionary of any size: the words of
    the texts meet first the words that entries begin with, which tell how long those
    are, then, as runs of just those lengths, the entries."""
    starts = entries.groupBy("first").agg(F.collect_set("words").alias("lengths"))
    placed = docs.select("doc_id", words(F.col("text")).alias("w"), _separators(F.col("text")).alias("s")).select(
        "doc_id", "w", "s", F.posexplode("w").alias("pos", "first"))
    longest = entries.agg(F.max("words")).first()[0] or 1
    cut = placed.select("doc_id", "pos", "first", *[F.slice(c, F.col("pos") + 1, longest).alias(c) for c in "ws"])
    pieces = F.expr("transform(slice(w, 1, words), (x, i) -> if(i = 0, x, concat(get(s, i), x)))")
    runs = cut.join(broadcast_if_small(starts), "first").select(
        "doc_id", "pos", "w", "s", F.explode("lengths").alias("words")
    ).where("words <= size(w)").select("doc_id", "pos", F.array_join(pieces, "").alias("key"))
    return runs.join(entries.drop("first"), "key").select("doc_id", "pos", "words", "label", "surface")


def gazetteer_entities(docs: DataFrame, known: Dictionary) -> DataFrame:
    """``(doc_id, pos, label, surface)`` for every dictionary entry in a text.

    Words and what stands between them must match, whitespace as whitespace, anything
    else equal (``O'Brien``, ``AT&T``; no entry matches across a full stop that it
    doesn't hold). Entries may overlap. A small dictionary is an automaton that reads
    each text once; of a larger one, the entries meet the texts by joins. For texts
    that are parts of documents, ``doc_id`` may be a struct.
    """
    if known.trie is None:
        return _looked_up(docs, known.entries).drop("words")
    found = wordwise.mentions(F.col("text"), known.trie, longest=False)
    return docs.select("doc_id", F.inline(found)).drop("words")


def longest_mentions(docs: DataFrame, known: Dictionary) -> DataFrame:
    """``(doc_id, pos, words, label, surface)``: mentions that don't overlap.

    A text is read from the left; where entries begin, the one with the most words is
    a mention, and reading goes on behind it. An entry with several labels or spellings
    gives a row for each. Only mentions leave a task; with a large dictionary its
    candidates meet by document (null ids are left out, equal ones are one document).
    """
    if known.trie is not None:
        return docs.select("doc_id", F.inline(wordwise.mentions(F.col("text"), known.trie, longest=True)))
    candidate = F.struct("pos", (-F.col("words")).alias("less"), "label", "surface")
    found = _looked_up(docs, known.entries).where("doc_id is not null").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(candidate)).alias("c"))
    kept = wordwise.apart(F.col("c.pos"), F.transform("c.less", lambda x: -x))
    return found.select("doc_id", F.explode(F.transform(kept, lambda i: F.get("c", i))).alias("m")).select(
        "doc_id", "m.pos", (-F.col("m.less")).alias("words"), "m.label", "m.surface")


def entity_lists(entities: DataFrame, distinct: bool = True) -> DataFrame:
    """``(doc_id, names, organizations)`` from dictionary entities: distinct and
    sorted for documents, every mention in text order for pages."""
    def mentions(label: str) -> Column:
        surface = F.when(F.col("label") == label, F.col("surface"))
        if distinct:
            return F.array_sort(F.collect_set(surface))
        ordered = F.array_sort(F.collect_list(
            F.when(F.col("label") == label, F.struct("pos", "surface"))
        ))
        return F.transform(ordered, lambda x: x["surface"])

    return entities.groupBy("doc_id").agg(
        mentions("PERSON").alias("names"), mentions("ORG").alias("organizations")
    )


def _lists(mentions: Column, distinct: bool) -> Column:
    """``struct<names, organizations>`` from an array of mentions in text order."""
    def surfaces(label: str) -> Column:
        found = F.transform(F.filter(mentions, lambda m: m["label"] == label), lambda m: m["surface"])
        return F.array_sort(F.array_distinct(found)) if distinct else found
    return F.struct(surfaces("PERSON").alias("names"), surfaces("ORG").alias("organizations"))


def with_names(docs: DataFrame, known: Dictionary, longest: bool = True) -> DataFrame:
    """``docs (doc_id, text, ..)`` with ``names`` and ``organizations``, distinct and sorted:
    of mentions that don't overlap, or of all entries. Only a large dictionary is joined."""
    if known.trie is not None:
        found = docs.withColumn("_m", wordwise.mentions(F.coalesce("text", F.lit("")), known.trie, longest))
        return found.withColumn("_m", _lists(F.col("_m"), True)).select(
            *docs.columns, F.col("_m.names").alias("names"), F.col("_m.organizations").alias("organizations"))
    found = entity_lists((longest_mentions if longest else gazetteer_entities)(docs.select("doc_id", "text"), known))
    return docs.join(found, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("names", "organizations")})


def page_lists(pages: Column, known: Dictionary, longest: bool = True) -> Column:
    """``array<struct<names, organizations>>``, every mention of each of an array of texts in
    text order; for a small dictionary."""
    return F.transform(wordwise.page_mentions(pages, known.trie, longest), lambda m: _lists(m, False))


def _candidates(listed: Column, min_chars: int) -> Column:
    """``array<struct<pos, sentence, ranked>>``, in no useful order. Of equal
    sentences the first stands for all. Sorting puts them side by side, which
    keeps a text with very many sentences from comparing each with each."""
    by_sentence = F.array_sort(F.transform(
        listed, lambda s, i: F.struct(s.alias("sentence"), i.alias("pos"))
    ))
    return bind(by_sentence, lambda ordered: F.transform(ordered, lambda x, j: F.struct(
        x["pos"].alias("pos"),
        x["sentence"].alias("sentence"),
        (
            (F.length(x["sentence"]) > min_chars)
            & ((j == 0) | (F.get(ordered, j - 1)["sentence"] != x["sentence"]))
        ).alias("ranked"),
    )))


def frequency_summary(
    docs: DataFrame, k: int = SUMMARY_SENTENCES, min_chars: int = SUMMARY_MIN_CHARS,
    stop_words: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None, abbreviations=None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, summary)``: the ``k`` sentences with the most frequent words.

    A sentence scores the sum, over its words, of the word's count in the
    document (stop words count 0). Counts stay integers: dividing all by the
    highest would not change the order but would blur ties. Repeated sentences
    count once, ties go by position, and the summary is in score order. Sentences end
    by the fixed rule, or, given ``abbreviations`` (see ``boundaries.known_words``), not
    behind those.
    """
    known = _in_rows(lemmas, rules)
    if lemmas is None or known:
        return docs.select("doc_id", wordwise.summary(
            F.col("text"), k, min_chars, stop_words, known, abbreviations).alias("summary"))
    if abbreviations is not None:
        raise ValueError("abbreviations need a table of lemmas that is small, or none")
    by_doc = _by_document(docs).select("doc_id", sentences(F.col("text")).alias("sentences"))

    candidates = _candidates(F.col("sentences"), min_chars)
    # explode_outer, as explode would add a filter below the shuffle and keep
    # the two uses of by_doc from sharing it
    tokens = (
        by_doc.select("doc_id", F.explode_outer(candidates).alias("c"))
        .select("doc_id", "c.pos", "c.ranked", words(F.col("c.sentence")).alias("w"))
        .select("doc_id", "pos", "ranked", F.explode("w").alias("word"))
        .withColumn("word", F.lower("word"))
        .filter(~F.col("word").isin(*stop_words))
    )
    in_document = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "word"))
    scores = (
        _lemma_of(tokens, "word", lemmas)
        .withColumn("freq", in_document)
        .filter("ranked")
        .groupBy("doc_id", "pos")
        .agg(F.sum("freq").alias("score"))
    )
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    best = (
        scores.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .groupBy("doc_id")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda x: x["pos"]
        ).alias("best"))
    )

    # Sentences without any counted word score 0 and follow in text order.
    best_or_none = F.coalesce("best", F.expr("cast(array() as array<int>)"))
    eligible = F.array_sort(F.transform(
        F.filter(candidates, lambda c: c["ranked"]), lambda c: c["pos"]
    ))
    picked = F.when(F.size(best_or_none) == k, best_or_none).otherwise(
        F.slice(F.array_union(best_or_none, eligible), 1, k)
    )
    chosen = by_doc.join(best, "doc_id", "left").select(
        "doc_id", "sentences", picked.alias("picked")
    )
    summary = F.array_join(F.transform("picked", lambda i: F.col("sentences")[i]), " ")
    return chosen.select(
        "doc_id", F.when(F.size("picked") > 0, summary).otherwise(NO_SUMMARY).alias("summary")
    )


def with_words(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None) -> DataFrame:
    """``docs (doc_id, text, ..)`` with ``keyword_frequency array<struct<rank, lemma, n>>`` and
    ``summary``. Only a large table of lemmas is joined."""
    known = _in_rows(lemmas)
    if lemmas is None or known:
        both = wordwise.words_and_summary(
            F.col("text"), KEYWORDS_KEPT, SUMMARY_SENTENCES, SUMMARY_MIN_CHARS, stop_words, known)
        return docs.withColumn("_w", both).select(
            *docs.columns, F.col("_w.keyword_frequency").alias("keyword_frequency"),
            F.coalesce("_w.summary", F.lit(NO_SUMMARY)).alias("summary"))
    texts = docs.select("doc_id", "text")
    top = top_keywords(texts, stop_words=stop_words, lemmas=lemmas)
    return docs.join(keyword_frequency(top), "doc_id", "left").join(
        frequency_summary(texts, stop_words=stop_words, lemmas=lemmas), "doc_id", "left")
