"""Induced lemma rules against a plain model, and their accuracy on held-out forms."""

import random
from collections import Counter

import pytest

from docmill.operators import lemma_rules, lexical


def inflected(n=700):
    """Stems with regular endings: plurals, past forms, participles, and a few words alone."""
    rng = random.Random(31)
    out = {}
    for _ in range(n):
        stem = "".join(rng.choice("bdfglmnprt") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) + rng.choice("bdgklmnprt")
        form, lemma = rng.choice([(stem + "s", stem), (stem + "ed", stem + "e"), (stem + "ing", stem), (stem + "ies", stem + "y"), (stem, stem)])
        out[form] = lemma
    return out


def learnt(known, longest=5, least=2):
    votes = Counter()
    for form, lemma in known.items():
        common = 0
        while common < min(len(form), len(lemma)) and form[common] == lemma[common]:
            common += 1
        cut, add = len(form) - common, lemma[common:]
        if cut <= longest:
            for n in range(max(cut, 1), max(cut, 1, min(len(form), longest)) + 1):
                votes[form[-n:], cut, add] += 1
    best = {}
    for (suffix, cut, add), n in votes.items():
        if n >= least:
            best[suffix] = min(best.get(suffix, (0, 0, "")), (-n, cut, add))
    return {s: (cut, add, -n) for s, (n, cut, add) in best.items()}


@pytest.fixture(scope="module")
def tables(spark):
    known = inflected()
    held = {f: lemma for k, (f, lemma) in enumerate(known.items()) if k % 5 == 0}
    seen = {f: lemma for f, lemma in known.items() if f not in held}
    rows = list(seen.items()) + [(None, "x"), ("x", None), ("", "y"), *list(seen.items())[:5]]
    df = spark.createDataFrame(rows, "form string, lemma string")
    return df, lemma_rules.learn(df), seen, held


def test_rules_equal_the_model(tables):
    df, rules, seen, _ = tables
    assert {r.suffix: (r.cut, r.add, r.votes) for r in rules.collect()} == learnt(seen)
    assert lemma_rules.learn(df.limit(0)).count() == 0


def test_held_out_forms(spark, tables):
    df, rules, seen, held = tables
    forms = spark.createDataFrame([(f,) for f in [*held, *list(seen)[:20], "zzz", "", None]], "form string")
    got = {r.form: r.lemma for r in lemma_rules.apply(forms, df, rules).collect()}
    assert all(got[f] == seen[f] for f in list(seen)[:20]) and got["zzz"] == "zzz" and got[""] == ""
    right = sum(got[f] == lemma for f, lemma in held.items())
    assert right >= 0.95 * len(held)
    plain = sum(f == lemma for f, lemma in held.items())
    assert plain < 0.5 * len(held)      # what the dictionary alone would give


def test_rules_inside_the_row(spark, tables):
    df, rules, seen, held = tables
    text = " ".join([*held, *list(seen)[:10]])
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    lemma_of = {r.form: r.lemma for r in lemma_rules.apply(
        spark.createDataFrame([(w,) for w in text.split()], "form string"), df, rules).collect()}
    want = " ".join(lemma_of[w] for w in text.split())
    assert lexical.lemmatize(docs, df, rules).first().text == want
    counts = {r.lemma: r.n for r in lexical.token_counts(docs, (), df, rules).collect()}
    assert counts == Counter(want.split())
    assert lexical.frequency_summary(docs, lemmas=df, rules=rules).count() == 1


def test_rules_need_small_tables(spark, tables, monkeypatch):
    df, rules, *_ = tables
    monkeypatch.setattr(lexical, "is_small", lambda d: False)
    with pytest.raises(ValueError):
        lexical.token_counts(spark.createDataFrame([(1, "a")], "doc_id int, text string"), (), df, rules)
