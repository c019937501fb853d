"""License scans: an exact set-similarity join of text blocks with notice templates.

A template is a set of words, and so is a block: the words of a window that moves
by half its length, long enough that any run of words as long as the template lies
in one window. A template is found in a block that holds at least ``THRESHOLD`` of
its words. The join is a prefix-filter join: template words are ordered by their
frequency over all documents, rarest first; a block must hold one of the first
``n - need + 1`` words of a template of n words; a block with fewer than ``need``
distinct words is too short; and the place of the first shared word in the template
bounds what can still follow. Survivors are counted exactly.

Beside the join, three base phrases are located word by word. DataFrame functions
only. Templates are constants, so the broadcast side has a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from docmill.llm.common import store

THRESHOLD = 0.9

# Base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Notices in their customary wording.
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

# A word before and after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def tokens(text: Column) -> Column:
    """Words in lower case (all alphabets; the base phrases fold A-Z only)."""
    return F.array_remove(F.split(F.lower(text), GAP + "+"), "")


def _template_words(templates) -> list[tuple[str, list[str]]]:
    import re
    return [(label, list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))) for label, text in templates]


def _phrase(words: str) -> str:
    return rf"(?i)(?<!{WORD})" + rf"{GAP}+".join(words.split()) + rf"(?!{WORD})"


def base_columns(text: Column) -> dict[str, Column]:
    """Word count, and places, first and last word and labels of the base phrases."""
    any_base = "(?i)(?<!%s)(?:%s)(?!%s)" % (
        WORD, "|".join(rf"{GAP}+".join(p.split()) for _, p in BASE), WORD)
    word = WORD + "+"
    n_words = F.regexp_count(text, F.lit(word))
    n_base = F.regexp_count(text, F.lit(any_base))
    pieces = F.split(text, any_base)
    found = F.regexp_extract_all(text, F.lit("(" + any_base + ")"), F.lit(1))
    last = F.regexp_count(F.element_at(pieces, -1), F.lit(word)) \
        + F.regexp_count(F.element_at(found, -1), F.lit(word))
    labels = F.array_sort(F.filter(F.array(*(
        F.when(F.regexp_like(text, F.lit(_phrase(p))), F.lit(label)) for label, p in BASE)), lambda x: x.isNotNull()))
    none = F.lit(None)
    return {
        "n_words": n_words.cast("long"), "n_base": n_base.cast("long"),
        "first_word": F.when(n_base > 0, F.regexp_count(F.element_at(pieces, 1), F.lit(word))).otherwise(none).cast("long"),
        "last_word": F.when(n_base > 0, n_words - last).otherwise(none).cast("long"),
        "base": F.when(n_base > 0, labels).otherwise(F.array().cast("array<string>")),
    }


def ordered_templates(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Templates with words by frequency in ``docs``; at most one row per template word returns."""
    parts = _template_words(templates)
    vocabulary = sorted({w for _, ws in parts for w in ws})
    counts = dict(
        docs.select(F.explode(F.array_intersect(
            tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))).alias("word"))
        .groupBy("word").count().collect())
    out = []
    for label, ws in parts:
        ws = sorted(ws, key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(threshold * len(ws) - 1e-9)
        span = 8
        while span < len(ws):
            span *= 2
        out.append({"label": label, "words": ws, "need": need, "prefix": ws[:len(ws) - need + 1], "span": span})
    return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base and template findings, one row per row of ``docs``.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    blocks``; ``blocks`` lists the template matches (``label``, first word of the
    block, share of the template's words). ``score`` is the largest share, 1 where
    a base phrase stands, else 0. A null text is empty; null and repeated ids are
    rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    ready = ordered_templates(docs, templates, threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    prefix = sorted({w for t in ready for w in t["prefix"]})
    # cheap and exact: a document without any prefix word has no block with one
    maybe = F.regexp_like(text, F.lit(rf"(?i)(?<!{WORD})(?:{'|'.join(prefix)})(?!{WORD})"))
    rows = docs.select("doc_id", text.alias("text"))
    words = F.when(maybe, tokens(F.col("text")))
    holds = F.lit(False)
    for t in ready:
        holds = holds | (F.size(F.array_intersect(F.col("words"), F.array(*map(F.lit, t["words"])))) >= t["need"])
    found = store(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    *(c.alias(k) for k, c in base_columns(F.col("text")).items()), words.alias("words"))
        .withColumn("words", F.when(F.col("words").isNotNull() & holds, F.col("words"))), "licenses")

    spans = F.array(*map(F.lit, sorted({t["span"] for t in ready})))
    blocks = (
        found.where("words is not null").select("row", "words", F.explode(spans).alias("span"))
        .select("row", "span", "words", F.explode(F.expr("sequence(0, greatest(0, size(words) - 1) div span)")).alias("k"))
        .select("row", "span", (F.col("k") * F.col("span")).alias("start"),
                F.array_distinct(F.expr("slice(words, k * span + 1, 2 * span)")).alias("block")))
    index = spark.createDataFrame(
        [(n, w, k + 1, t["label"], t["words"], t["need"], t["span"])
         for n, t in enumerate(ready) for k, w in enumerate(t["prefix"])],
        "template int, word string, place int, label string, template_words array<string>, need int, span int")
    pairs = (
        blocks.where(F.size("block") > 0).select("row", "span", "start", "block", F.explode("block").alias("word"))
        .join(F.broadcast(index), ["span", "word"])
        .where("size(block) >= need")                           # length
        .where("size(template_words) - place + 1 >= need"))     # position
    pairs = pairs.groupBy("row", "span", "start", "template").agg(
        *(F.any_value(c).alias(c) for c in ("block", "label", "template_words", "need")))
    verified = pairs.withColumn("shared", F.size(F.array_intersect("block", "template_words"))) \
        .where("shared >= need")
    by_row = verified.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(
            "start", "label", (F.col("shared") / F.size("template_words")).alias("share")))).alias("blocks"))
    nothing = F.array().cast("array<struct<start:int,label:string,share:double>>")
    return found.drop("words").join(by_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(
            "base", F.coalesce(F.col("blocks.label"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.col("blocks.share")), F.lit(0.0))).alias("score"),
        F.coalesce("blocks", nothing).alias("blocks"))
