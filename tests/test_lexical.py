import random

import pytest
from pyspark.sql import functions as F

from docmill.functions.vectors import codepoint_sum, embed
from docmill.operators import lexical, summaries
from tests import twins

TEXTS = [
    "", "Short. Tiny!", "the of and.",
    "This sentence is here twice today. A different sentence stands here. "
    "This sentence is here twice today. The of and the of and the of and.",
    "Beta alpha beta alpha gamma. Alpha beta x1 gamma2 delta delta.",
    "The of and the of and the of. Is it on the and of the it. One real sentence with words.",
    "Emoji 😀 and über straße Straße. Ünder ünder the sea goes everyone.",
]


@pytest.fixture(scope="module")
def docs(spark, decorated):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in decorated]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)


def test_top_keywords(docs):
    df, texts = docs
    got = {}
    for r in lexical.top_keywords(df).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.lemma, r.n))
    for doc_id, text in texts.items():
        assert got.get(doc_id, []) == twins.word_ranking(text, lexical.STOP_WORDS, 10)


@pytest.mark.parametrize("k", [1, 3])
def test_frequency_summary(docs, k):
    df, texts = docs
    got = {r.doc_id: r.summary for r in lexical.frequency_summary(df, k=k).collect()}
    assert got == {d: twins.best_sentences(t, lexical.STOP_WORDS, k) for d, t in texts.items()}


def test_heuristic_summary(docs):
    df, texts = docs
    got = df.select("doc_id", summaries.heuristic_summary(F.col("text")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {
        d: twins.weighty_sentences(t, 5) for d, t in texts.items()}


def test_max_count_is_one_without_tokens(docs):
    df, texts = docs
    got = {r.doc_id: r.max_n for r in lexical.max_count(df, lexical.token_counts(df)).collect()}
    assert got[0] == 1 and got[2] == 1 and set(got) == set(texts)


def test_lemmas_merge_counts_and_keep_the_first_position(spark):
    df = spark.createDataFrame([(1, "Cats run. A cat ran; dogs run")], "doc_id int, text string")
    lemmas = spark.createDataFrame(
        [("cats", "cat"), ("ran", "run"), ("dogs", "dog"), ("dogs", "zz")], "form string, lemma string")
    top = lexical.top_keywords(df, lemmas=lemmas).orderBy("rank").collect()
    assert [(r.lemma, r.n) for r in top] == [("run", 3), ("cat", 2), ("dog", 1)]
    assert lexical.lemmatize(df, lemmas).first()["text"] == "Cats run. A cat run dog run"


def test_lemma_join_is_the_same_without_broadcast(spark, docs, monkeypatch):
    df, _ = docs
    lemmas = spark.createDataFrame([("payment", "pay"), ("alpha", "beta")], "form string, lemma string")
    wanted = {tuple(r) for r in lexical.top_keywords(df, lemmas=lemmas).collect()}
    monkeypatch.setattr(lexical, "is_small", lambda d: False)
    monkeypatch.setattr(lexical, "broadcast_if_small", lambda d: d.hint("merge"))
    assert {tuple(r) for r in lexical.top_keywords(df, lemmas=lemmas).collect()} == wanted


@pytest.mark.parametrize("small", [True, False])
def test_gazetteer(spark, small, monkeypatch):
    df = spark.createDataFrame(
        [(1, "Ann Bell met Ann at Acme Corp. Ann Bell"), (2, "nobody"), (3, "")],
        "doc_id int, text string")
    entries = spark.createDataFrame(
        [("Ann Bell", "PERSON"), ("Ann", "PERSON"), ("Acme Corp", "ORG"), ("Ann", "PERSON")],
        "surface string, label string")
    if not small:
        monkeypatch.setattr(lexical, "is_small", lambda d: False)
        monkeypatch.setattr(lexical, "broadcast_if_small", lambda d: d)
    found = lexical.gazetteer_entities(df, lexical.dictionary(entries))
    assert sorted((r.pos, r.surface) for r in found.collect()) == [
        (0, "Ann"), (0, "Ann Bell"), (3, "Ann"), (5, "Acme Corp"), (7, "Ann"), (7, "Ann Bell")]
    document = lexical.entity_lists(found).first()
    assert (document.names, document.organizations) == (["Ann", "Ann Bell"], ["Acme Corp"])
    page = lexical.entity_lists(found, distinct=False).first()
    assert page.names == ["Ann", "Ann Bell", "Ann", "Ann", "Ann Bell"]


@pytest.mark.parametrize("small", [True, False])
def test_gazetteer_takes_any_length_and_spelling(spark, small, monkeypatch):
    df = spark.createDataFrame(
        [(1, "The Bank of New York Mellon hired O'Brien and AT&T. Ann. Bell rang Ann\n\tBell"),
         (2, "one two three four five six seven Acme Inc."), (3, None), (4, "Ann Bell")], "doc_id int, text string")
    entries = spark.createDataFrame(
        [("Bank of New York Mellon", "ORG"), ("O'Brien", "PERSON"), ("AT&T", "ORG"), ("Ann Bell", "PERSON"),
         ("two three four five six seven", "ORG"), ("Acme  Inc.", "ORG"), ("...", "ORG"), (None, "ORG")],
        "surface string, label string")
    if not small:
        monkeypatch.setattr(lexical, "is_small", lambda d: False)
        monkeypatch.setattr(lexical, "broadcast_if_small", lambda d: d)
    found = lexical.gazetteer_entities(df, lexical.dictionary(entries))
    assert sorted((r.doc_id, r.pos, r.surface) for r in found.collect()) == [
        (1, 1, "Bank of New York Mellon"), (1, 7, "O'Brien"), (1, 10, "AT&T"), (1, 15, "Ann Bell"),
        (2, 1, "two three four five six seven"), (2, 7, "Acme  Inc."), (4, 0, "Ann Bell")]


MENTIONED = [
    (1, "New York Times said New York Post and York Times", [(0, "New York Times"), (4, "New York"), (8, "York Times")]),
    (2, "a b c d a b", [(0, "a b"), (2, "c d"), (4, "a b")]),
    (3, "York  New\tYork\nTimes", [(0, "York"), (1, "New York Times")]),
    (4, "", []), (5, None, []), (6, "nothing here", []),
]


@pytest.mark.parametrize("small", [True, False])
def test_mentions_are_leftmost_longest(spark, small, monkeypatch):
    df = spark.createDataFrame([r[:2] for r in MENTIONED], "doc_id int, text string")
    entries = spark.createDataFrame(
        [("New York", "ORG"), ("New York Times", "ORG"), ("York Times", "ORG"), ("York", "PERSON"), ("a b", "PERSON"),
         ("b c", "ORG"), ("b c d", "ORG"), ("c d", "ORG"), ("a b", "ORG")], "surface string, label string")
    if not small:
        monkeypatch.setattr(lexical, "is_small", lambda d: False)
        monkeypatch.setattr(lexical, "broadcast_if_small", lambda d: d)
    known = lexical.dictionary(entries)
    found = lexical.longest_mentions(df, known)
    got = {(r.doc_id, r.pos, r.surface) for r in found.collect()}
    assert got == {(d, *m) for d, _, ms in MENTIONED for m in ms}
    assert sorted((r.pos, r.label) for r in found.where("doc_id = 2").collect()) == [
        (0, "ORG"), (0, "PERSON"), (2, "ORG"), (4, "ORG"), (4, "PERSON")]
    named = {r.doc_id: (r.names, r.organizations) for r in lexical.with_names(df, known).collect()}
    assert named[1] == ([], ["New York", "New York Times", "York Times"]) and named[5] == ([], [])
    every = {r.doc_id: r.organizations for r in lexical.with_names(df, known, longest=False).collect()}
    assert every[2] == ["a b", "b c", "b c d", "c d"]
    assert lexical.longest_mentions(df, lexical.dictionary(entries.limit(0))).count() == 0
    if small:       # nothing but mentions leaves a task, and nothing is shuffled
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_random_mentions_against_a_plain_walk(spark):
    rng = random.Random(9)
    entries = {tuple(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(25)}
    texts = {k: rng.choices("abcde", k=40) for k in range(60)}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id int, text string")
    table = spark.createDataFrame([(" ".join(e), "ORG") for e in entries], "surface string, label string")
    want = set()
    for k, w in texts.items():
        at = 0
        while at < len(w):
            n = max((len(e) for e in entries if tuple(w[at:at + len(e)]) == e), default=0)
            if n:
                want.add((k, at, n))
            at += n or 1
    got = {(r.doc_id, r.pos, r.words) for r in lexical.longest_mentions(df, lexical.dictionary(table)).collect()}
    assert got == want


@pytest.mark.parametrize("small", [True, False])
def test_lemmas_in_and_out_of_the_row(spark, docs, small, monkeypatch):
    df, texts = docs
    lemmas = spark.createDataFrame([("payment", "pay"), ("alpha", "beta"), ("the", "a"), ("pay", "x"), (None, "y"), ("z", None)],
                                   "form string, lemma string")
    if not small:
        monkeypatch.setattr(lexical, "is_small", lambda d: False)
    frames = {
        "counts": lexical.token_counts(df, lemmas=lemmas), "text": lexical.lemmatize(df, lemmas),
        "summary": lexical.frequency_summary(df, lemmas=lemmas), "top": lexical.top_keywords(df, lemmas=lemmas)}
    got = {name: sorted(map(tuple, f.collect()), key=repr) for name, f in frames.items()}
    assert got["counts"] and got["text"] and got["top"] and len(got["summary"]) == len(texts)
    LEMMA_RESULTS.setdefault("first", got)
    assert LEMMA_RESULTS["first"] == got


LEMMA_RESULTS = {}


def test_rows_without_an_id_stay_in_the_row(spark):
    df = spark.createDataFrame([(None, "alpha beta alpha"), (None, "gamma words and more words here"), (1, None), (1, "delta")],
                               "doc_id int, text string")
    assert sorted((r.lemma, r.n) for r in lexical.top_keywords(df, k=1).collect()) == [("alpha", 2), ("delta", 1), ("words", 2)]
    assert lexical.frequency_summary(df).count() == 4


def test_embedding_and_chunks(spark, docs):
    df, texts = docs
    long = "".join(chr(97 + i % 26) for i in range(2701))
    texts = {**texts, -1: long, -2: long[:1000], -3: long[:1001], -4: long[:1800], -5: "a😀" * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = df.select("doc_id", embed(F.col("text")).alias("v"), summaries.chunks(F.col("text")).alias("c"))
    for r in rows.collect():
        t = texts[r.doc_id]
        assert r.v == twins.text_vector(t)
        assert r.c == ([t] if len(t) <= 1000 else [t[i:i + 900] for i in range(0, len(t), 900)])
    nulls = spark.createDataFrame([(None,), ("b",)], "t string").select(codepoint_sum(F.col("t")).alias("n"))
    assert sorted(r.n or 0 for r in nulls.collect()) == [0, 98]


def test_keywords_and_summary_come_from_one_reading_of_the_text(spark):
    rows = [(1, "The cat sat on the mat, the Cat slept. A dog barked at the cat! x1 mats? Mats of cats lie here today."),
            (2, ""), (3, None), (4, "One. one. ONE two. two")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    both = lexical.with_words(df)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("run(") == 1
    top = {r.doc_id: [] for r in df.collect()}
    for r in sorted(lexical.top_keywords(df).collect()):
        top[r.doc_id].append((r.rank, r.lemma, r.n))
    summary = {r.doc_id: r.summary for r in lexical.frequency_summary(df).collect()}
    for r in both.collect():
        assert [tuple(k) for k in r.keyword_frequency or []] == top[r.doc_id] and r.summary == summary[r.doc_id]
    assert top[1][:2] == [(1, "cat", 3), (2, "mats", 2)] and top[4] == [(1, "one", 3), (2, "two", 2)]
