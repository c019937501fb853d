"""Plain-Python models of the operators, written for the tests."""

import collections
import re

from docmill import fixed_values as fixed

WORD = re.compile(r"\w+")


def split_sentences(text):
    return re.split(r"(?<=[.!?])\s+", text.strip())


def count_keyword(text, keyword):
    return sum(1 for _ in re.finditer(rf"\b{re.escape(keyword)}\b", text, re.I))


def word_ranking(text, stop, k):
    """Most common all-letter words; the earlier first word wins a tie."""
    tally = collections.Counter()
    for word in WORD.findall(text):
        if word.isalpha() and word.lower() not in stop:
            tally[word.lower()] += 1
    return [(w, n) for w, n in sorted(tally.items(), key=lambda item: -item[1])[:k]]


def best_sentences(text, stop, k):
    tally = collections.Counter(
        w for w in map(str.lower, WORD.findall(text)) if w not in stop
    )
    weight = {}
    for sentence in split_sentences(text):
        if len(sentence) > fixed.SUMMARY_MIN_CHARS and sentence not in weight:
            weight[sentence] = sum(tally[w] for w in map(str.lower, WORD.findall(sentence)))
    if not weight:
        return fixed.NO_SUMMARY
    return " ".join(sorted(weight, key=weight.get, reverse=True)[:k])


def weighty_sentences(text, k):
    def weight(sentence):
        hits = sum(word in sentence.lower() for word in fixed.SUMMARY_KEYWORDS)
        return len(sentence.split()) + fixed.HEURISTIC_BONUS * hits

    return " ".join(sorted(split_sentences(text), key=weight, reverse=True)[:k])


def text_vector(text):
    total = sum(map(ord, text))
    return [float(len(text)), float(total % 1000), float(total // (len(text) + 1) % 100)]
