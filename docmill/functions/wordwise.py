"""Word work inside a row: counts, summaries, lemmas and dictionary mentions of one text.

The columns here are Arrow functions: whole batches of texts cross to Python and back,
which for counting words is several times faster than nested lambdas in the JVM, and
nothing is shuffled. Dictionaries come as broadcast variables of checked size.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from operator import itemgetter
from unicodedata import category

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from docmill.fixed_values import NO_SUMMARY

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(r"\w+")
_CUT = re.compile(r"(\w+)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_STOPPED = re.compile(r"\w\.\Z")


SLICE = 64      # values that are Python objects at a time, of a batch of thousands


def in_slices(fn: Callable, values: pa.Array, arrow: pa.DataType) -> pa.Array:
    """``fn`` of each value; null stays null. What it returns becomes Arrow by slices, as the
    lists and dictionaries of a whole batch take a hundred times the room of its texts."""
    parts = [pa.array([None if (v := x.as_py()) is None else fn(v) for x in values.slice(k, SLICE)], arrow)
             for k in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], arrow)


def _column(fn: Callable, kind: str, arrow: pa.DataType):
    """An Arrow function of one column from a function of one value; null stays null."""
    def run(values: pa.Array) -> pa.Array:
        return in_slices(fn, values, arrow)
    return F.arrow_udf(run, kind)


class Lemmas:
    """A dictionary of lemmas and, for forms it lacks, suffix rules ``suffix -> (cut, add)``."""

    def __init__(self, known: dict[str, str], rules: dict[str, tuple[int, str]]):
        self.known, self.rules = known, rules
        self.longest = max(map(len, rules), default=0)

    def get(self, form: str, default: str) -> str:
        found = self.known.get(form)
        if found is not None:
            return found
        for size in range(min(self.longest, len(form)), 0, -1):
            rule = self.rules.get(form[-size:])
            if rule is not None:
                return form[:len(form) - rule[0]] + rule[1] or default
        return default


_COUNTS = pa.list_(pa.struct([("lemma", pa.string()), ("n", pa.int64()), ("first_pos", pa.int32())]))


def count_words(text: str, stop: frozenset[str], lemmas: dict[str, str]) -> list[tuple[str, int, int]]:
    """``lemma, n, first place`` of the alphabetic words that aren't stop words, by first
    place, which counts all alphabetic words."""
    found = [w for w in _WORD.findall(text) if w.isalpha()]
    first = dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
    out: dict[str, list[int]] = {}
    for word, n in Counter(found).items():
        low = word.lower()
        if low in stop:
            continue
        low = lemmas.get(low, low)
        known = out.get(low)
        if known is None:
            out[low] = [n, first[word]]
        else:
            known[0] += n
            known[1] = min(known[1], first[word])
    return sorted(((w, n, at) for w, (n, at) in out.items()), key=lambda x: x[2])


def word_counts(text: Column, stop: Sequence[str], lemmas=None) -> Column:
    """``array<struct<lemma, n, first_pos>>``; ``lemmas`` is a broadcast dictionary."""
    stop = frozenset(stop)

    def run(value):
        found = count_words(value, stop, lemmas.value if lemmas else {})
        return [{"lemma": w, "n": n, "first_pos": at} for w, n, at in found]
    return _column(run, "array<struct<lemma:string,n:bigint,first_pos:int>>", _COUNTS)(text)


_RANKED = pa.list_(pa.struct([("rank", pa.int32()), ("lemma", pa.string()), ("n", pa.int64())]))


_RANKED_KIND = "array<struct<rank:int,lemma:string,n:bigint>>"


def _ranks(top: list[tuple[str, int]]) -> list[dict]:
    return [{"rank": i + 1, "lemma": w, "n": n} for i, (w, n) in enumerate(top)]


def top_words(text: Column, k: int, stop: Sequence[str], lemmas=None) -> Column:
    """``array<struct<rank, lemma, n>>``: the most common, ties by first place."""
    stop = frozenset(stop)

    def run(value):
        return _ranks(Words(value).top(k, stop, lemmas.value if lemmas else {}))
    return _column(run, _RANKED_KIND, _RANKED)(text)


def bare(token: str) -> str:
    """A token without the marks at its ends."""
    if token.isalnum():
        return token
    first, end = _WORD.search(token), len(token)
    if first is None:
        return ""
    while not _WORD.match(token, end - 1):
        end -= 1
    return token[first.start():end]


def sentence_list(text: str, abbreviations: frozenset[str] = frozenset()) -> list[str]:
    """Split after ``.``, ``!`` or ``?`` and whitespace, but not after an abbreviation's stop."""
    text = text.strip()
    if not abbreviations:
        return _SENTENCE_END.split(text)
    out, start, seen = [], 0, 0
    for gap in _SENTENCE_END.finditer(text):
        at = gap.start()
        if text[at - 1] == "." and at > 1 and _WORD.match(text[at - 2]):
            # the token before the gap lies behind the last gap that was looked at
            if bare(text[seen:at].rsplit(None, 1)[-1]).lower() in abbreviations:
                seen = gap.end()
                continue
        out.append(text[start:at])
        start = seen = gap.end()
    out.append(text[start:])
    return out


TYPES = 1 << 17     # different tokens that a task counts before it hands them on


def stop_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` to partial counts ``word, n_dot, n_plain, n_on`` (see ``boundaries``)."""
    all_, on = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        words: dict[str, list[int]] = {}
        for token, n in all_.items():
            if token.isalnum():     # most are, and need no look at their ends
                words.setdefault(token, [0, 0, 0])[1] += n
            elif word := bare(token):
                row = words.setdefault(word, [0, 0, 0])
                row[0 if _STOPPED.search(token) else 1] += n
                row[2] += on[token]
        rows = list(zip(*((w, *row) for w, row in words.items()))) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])],
            names=["word", "n_dot", "n_plain", "n_on"])

    for batch in batches:
        for value in batch.column(0):
            tokens = (value.as_py() or "").split()
            all_.update(tokens)
            stopped = [(t, after[0]) for t, after in zip(tokens, tokens[1:]) if t[-1] == "."]
            on.update(t for t, c in stopped if category(c) in ("Ll", "Nd") and _STOPPED.search(t))
            if len(all_) > TYPES:
                yield counted()
                all_.clear()
                on.clear()
    yield counted()


def split_sentences(text: Column, abbreviations) -> Column:
    """``array<string>``; ``abbreviations`` is a broadcast set."""
    return _column(lambda value: sentence_list(value, abbreviations.value), "array<string>", pa.list_(pa.string()))(text)


class Words:
    """The words of one text, sentence by sentence, counted once for keywords and summary.

    Sentences end at whitespace, so their words are those of the text, in order."""

    def __init__(self, text: str, abbreviations: frozenset[str] = frozenset()):
        self.sentences = sentence_list(text, abbreviations)
        self.words = [_WORD.findall(s) for s in self.sentences]
        self.counts = Counter(chain.from_iterable(self.words))  # in order of first places

    def top(self, k: int, stop: frozenset[str], lemmas) -> list[tuple[str, int]]:
        """The most common alphabetic words, ties by first place."""
        out: dict[str, int] = {}
        for word, n in self.counts.items():
            if word.isalpha() and (low := word.lower()) not in stop:
                low = lemmas.get(low, low)
                out[low] = out.get(low, 0) + n
        return heapq.nlargest(k, out.items(), key=itemgetter(1))    # as stable as a sort

    def best(self, k: int, min_chars: int, stop: frozenset[str], lemmas) -> str:
        """The ``k`` sentences with the most frequent words, best first; ties by place."""
        counted: dict[str, int] = {}
        known = {}
        for word, n in self.counts.items():
            if (low := word.lower()) not in stop:
                known[word] = low = lemmas.get(low, low)
                counted[low] = counted.get(low, 0) + n
        weight = {w: counted[known[w]] if w in known else 0 for w in self.counts}
        scores: dict[str, int] = {}
        for sentence, words in zip(self.sentences, self.words):
            if len(sentence) > min_chars and sentence not in scores:
                scores[sentence] = sum(map(weight.__getitem__, words))
        return " ".join(heapq.nlargest(k, scores, key=scores.__getitem__)) or NO_SUMMARY


def best_sentences(text: str, k: int, min_chars: int, stop: frozenset[str], lemmas: dict[str, str],
                   abbreviations: frozenset[str] = frozenset()) -> str:
    """The ``k`` sentences with the most frequent words, best first; ties by place."""
    return Words(text, abbreviations).best(k, min_chars, stop, lemmas)


def words_and_summary(text: Column, keywords: int, k: int, min_chars: int, stop: Sequence[str], lemmas=None) -> Column:
    """``struct<keyword_frequency, summary>`` as of :func:`top_words` and :func:`summary`, from
    one reading of the text; null for a null text."""
    stop = frozenset(stop)

    def run(value):
        words, known = Words(value), lemmas.value if lemmas else {}
        return {"keyword_frequency": _ranks(words.top(keywords, stop, known)), "summary": words.best(k, min_chars, stop, known)}
    return _column(run, f"struct<keyword_frequency:{_RANKED_KIND},summary:string>",
                   pa.struct([("keyword_frequency", _RANKED), ("summary", pa.string())]))(text)


def summary(text: Column, k: int, min_chars: int, stop: Sequence[str], lemmas=None, abbreviations=None) -> Column:
    stop = frozenset(stop)

    def run(value):
        return best_sentences(value, k, min_chars, stop, lemmas.value if lemmas else {},
                              abbreviations.value if abbreviations else frozenset())
    return F.coalesce(_column(run, "string", pa.string())(text), F.lit(NO_SUMMARY))


def replaced_words(text: Column, lemmas) -> Column:
    """Each piece between blanks replaced by its lemma."""
    def run(value):
        known = lemmas.value
        return " ".join(known.get(w, w) for w in re.split(" +", value))
    return _column(run, "string", pa.string())(text)


class WordTrie:
    """A dictionary as an automaton over words.

    A node is ``{(separator, word): node}`` with its entries under ``None``; the first
    word has no separator. Whitespace of any kind is one blank.
    """

    def __init__(self, rows):
        """``rows``: words, separators before each, and the entry."""
        self.start: dict = {}
        for words, separators, entry in rows:
            node = self.start.setdefault(words[0], {})
            for separator, word in zip(separators[1:], words[1:]):
                node = node.setdefault((separator, word), {})
            node.setdefault(None, []).append(entry)

    def matches(self, text: str) -> Iterator[tuple[int, list[tuple[int, list]]]]:
        """``place, [(words, entries), ..]`` of each place where entries begin, shorter ones first."""
        words = _WORD.findall(text)
        if self.start.keys().isdisjoint(words):
            return
        cut = None
        for at in [i for i, word in enumerate(words) if word in self.start]:
            node = self.start[words[at]]
            found, end = [], at + 1
            while True:
                if None in node:
                    found.append((end - at, node[None]))
                if end == len(words) or len(node) == (None in node):
                    break
                if cut is None:
                    cut = _CUT.split(text)
                separator = cut[2 * end]
                node = node.get((" " if separator.isspace() else separator, words[end]))
                if node is None:
                    break
                end += 1
            if found:
                yield at, found

    def mentions(self, text: str, longest: bool) -> Iterator[tuple[int, int, tuple]]:
        """``place, words, entry``: all, or leftmost-longest ones that don't overlap."""
        free = 0
        for at, found in self.matches(text):
            if longest:
                if at < free:
                    continue
                found = found[-1:]
                free = at + found[0][0]
            for size, entries in found:
                for entry in entries:
                    yield at, size, entry


_MENTIONS = pa.list_(pa.struct([("pos", pa.int32()), ("words", pa.int32()), ("label", pa.string()), ("surface", pa.string())]))
_MENTION_KIND = "array<struct<pos:int,words:int,label:string,surface:string>>"


def _listed(trie: WordTrie, text: str | None, longest: bool) -> list[dict]:
    return [{"pos": at, "words": n, "label": e[0], "surface": e[1]} for at, n, e in trie.mentions(text or "", longest)]


def mentions(text: Column, trie, longest: bool) -> Column:
    """Mentions of one text in text order; ``trie`` is a broadcast :class:`WordTrie`."""
    return _column(lambda value: _listed(trie.value, value, longest), _MENTION_KIND, _MENTIONS)(text)


def page_mentions(pages: Column, trie, longest: bool) -> Column:
    """The same for each of an array of texts."""
    return _column(lambda values: [_listed(trie.value, v, longest) for v in values],
                   f"array<{_MENTION_KIND}>", pa.list_(_MENTIONS))(pages)


def apart(starts: Column, sizes: Column) -> Column:
    """Of candidates ordered by place, longest first, the indexes of those that a walk
    from the left keeps."""
    def run(at: pa.Array, size: pa.Array) -> pa.Array:
        out = []
        for begins, lengths in zip(at.to_pylist(), size.to_pylist()):
            kept, free, last = [], 0, None
            for i, (a, n) in enumerate(zip(begins, lengths)):
                if a >= free or (a, n) == last:     # entries of one spelling stay together
                    kept.append(i)
                    free, last = a + n, (a, n)
            out.append(kept)
        return pa.array(out, pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")(starts, sizes)
