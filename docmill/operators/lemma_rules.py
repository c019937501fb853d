"""Lemmas of words that a dictionary lacks, by suffix rules learnt from it.

An entry ``form -> lemma`` shows an edit of the form's end: what is left after the
common beginning goes, and the lemma's rest comes. Each suffix of the form that holds
the edit, up to ``LONGEST`` characters, votes for it; the edit with most votes is the
suffix's rule. An unseen form takes the rule of its longest suffix that has one, and
stays as it is if none has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LONGEST, LEAST = 5, 2   # characters of a suffix, and votes that a rule needs

_COMMON = ("aggregate(sequence(1, greatest(1, least(length(form), length(lemma)))), 0, "
           "(n, i) -> if(n = i - 1 and substring(form, i, 1) = substring(lemma, i, 1) and i <= length(form) and i <= length(lemma), i, n))")


def learn(lemmas: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``suffix, cut, add, votes`` from ``(form, lemma)``: of a form that ends in ``suffix``
    the last ``cut`` characters give way to ``add``. Entries count once, by their smallest
    lemma; null and empty ones don't count. Ties go to the shorter cut, then by ``add``."""
    entries = lemmas.where("form <> '' and lemma <> ''").groupBy("form").agg(F.min("lemma").alias("lemma"))
    edits = entries.withColumn("common", F.expr(_COMMON)).select(
        "form", (F.length("form") - F.col("common")).alias("cut"), F.expr("substring(lemma, common + 1)").alias("add"))
    suffixes = edits.where(F.col("cut") <= longest).select(
        "cut", "add", F.explode(F.expr(
            f"transform(sequence(greatest(cut, 1), greatest(cut, 1, least(length(form), {longest}))), n -> right(form, n))")).alias("suffix"))
    votes = suffixes.groupBy("suffix", "cut", "add").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
    best = Window.partitionBy("suffix").orderBy(F.desc("votes"), "cut", "add")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def apply(forms: DataFrame, lemmas: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``form, lemma`` of the distinct ``forms (form)``: from the dictionary, else by rule."""
    wanted = forms.where("form is not null").select("form").distinct()
    known = lemmas.where("form <> '' and lemma <> ''").groupBy("form").agg(F.min("lemma").alias("known"))
    suffix = wanted.select("form", F.explode(F.expr(
        f"transform(sequence(1, greatest(1, least(length(form), {longest}))), n -> right(form, n))")).alias("suffix"))
    ruled = suffix.join(rules, "suffix").groupBy("form").agg(
        F.max(F.struct(F.length("suffix").alias("size"), "cut", "add")).alias("rule"))
    by_rule = F.concat(F.expr("substring(form, 1, length(form) - rule.cut)"), F.col("rule.add"))
    return wanted.join(known, "form", "left").join(ruled, "form", "left").select(
        "form", F.coalesce("known", F.when(by_rule != "", by_rule), "form").alias("lemma"))
