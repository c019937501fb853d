"""Small hostile tables and plain-Python twins of the operators."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

PASSAGE = "The quick brown fox jumps over the lazy dog while forty seven owls keep watch. " * 4
LONG = " ".join(f"word{k % 997} tail{k % 89}" for k in range(30_000)) + "\n" + "z" * 50_000

DOCS = [
    (1, PASSAGE + "First ending line of words.\nReleased under the MIT License.", "en", "a"),
    (2, PASSAGE + "Second ending line of words.\nreleased UNDER the mit license", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "x", "fr", "b"),
    (6, LONG, "en", "c"),
    (7, PASSAGE + "First ending line of words.\nReleased under the MIT License.", "en", None),
    (8, "same row twice, with more than three words", "en", "a"),
    (8, "same row twice, with more than three words", "en", "a"),
    (9, "Ünïcode 日本語 text 😀 and\x00controls\r\nhere \t tabs", "de", "c"),
    (10, " \n\t\n ", "de", "c"),
    (None, "a row without an id but with words", "en", "a"),
    (11, "ab " * 400, "es", "b"),
    (12, LONG[:120_000] + " changed", "en", "b"),
]
#: Names the operators use inside, and what results are called.
CLASHES = ("row", "twin", "class", "n", "label", "score", "best", "size", "taken", "position", "block",
           "name", "kept", "packed", "spans", "token", "component", "node", "a", "b", "first", "start",
           "words", "line", "sim", "ids", "target", "bucket", "held_out", "data", "digest", "leaf")


def documents(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def grouped(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def jaccard_groups(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = grouped(len(sets), links)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=repr)


def repeated_spans(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans: list[list[int]] = []
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(spans)
    return data, out
