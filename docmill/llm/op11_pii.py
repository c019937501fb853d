"""Personal data, in the open and disguised, with spans in the source text.

Base spans are found in the text as it is. Then transducers normalise it, each a set of
rewrites of short stretches that reads the output of the one before: look-alike
characters and invisible ones; words in brackets or between words that stand for ``@``
and ``.``; spelled and look-alike digits. Every rewrite is kept as an edit, and the
edits of the transducers compose, so that any place in the normalised text maps to a
place in the source. Identifiers are sought again there, by the same patterns with
stricter edges, and those that hold an edit come back as spans of source characters.

A text that no transducer changes, which is nearly every one, is read once by each
pattern and copied by none. Offsets are code points. All patterns read a text in time
that grows with its length only.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds in the order of the contract, and what makes one valid.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS, IP_MOST = (14, 19), (10, 15), 255

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# runs of digits are taken whole, so a match starts at the start of one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes, by the character they stand for; letters of Latin, Cyrillic,
# Greek and Armenian script, then marks, blanks and characters that show nothing.
LOOK_ALIKE_LETTERS = {
    "a": "\u0430\u0251\u03b1", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435\u04bd", "h": "\u04bb", "i": "\u0456\u0131\u03b9",
    "j": "\u0458\u03f3", "k": "\u03ba", "l": "\u04cf", "m": "\u043c", "n": "\u0578", "o": "\u043e\u03bf\u0585", "p": "\u0440\u03c1",
    "q": "\u051b", "s": "\u0455", "u": "\u03c5\u057d", "v": "\u03bd\u0475", "w": "\u051d", "x": "\u0445\u03c7", "y": "\u0443\u04af",
    "A": "\u0410\u0391", "B": "\u0412\u0392", "C": "\u0421\u03f9", "E": "\u0415\u0395", "H": "\u041d\u0397", "I": "\u0406\u0399\u04c0",
    "J": "\u0408", "K": "\u041a\u039a", "M": "\u041c\u039c", "N": "\u039d", "O": "\u041e\u039f", "P": "\u0420\u03a1", "S": "\u0405",
    "T": "\u0422\u03a4", "X": "\u0425\u03a7", "Y": "\u04ae\u03a5", "Z": "\u0396",
}
LOOK_ALIKE_MARKS = {
    ".": "\u2024\u3002\uff61\uff0e", "@": "\uff20\ufe6b", "-": "\u2010\u2011\u2012\u2013\u2014\u2212\uff0d",
    "+": "\uff0b\ufe62", "_": "\uff3f", " ": "\u00a0\u2007\u2009\u202f", "": "\u00ad\u200b\u200c\u200d\u2060\ufeff",
}
# Words for marks and digits, in English, French, Spanish and German.
AT_WORDS = ("at", "arobase", "arroba")
DOT_WORDS = ("dot", "point", "punto", "punkt")
NO_HOSTS = ("the", "a", "an", "this", "that", "le", "la", "les", "el", "der", "die", "das")
PLUS_WORDS = ("plus",)
DIGIT_WORDS = (
    ("zero", "oh", "null", "cero", "zéro"), ("one", "un", "uno", "eins"), ("two", "deux", "dos", "zwei"),
    ("three", "trois", "tres", "drei"), ("four", "quatre", "cuatro", "vier"), ("five", "cinq", "cinco", "fünf"),
    ("six", "seis", "sechs"), ("seven", "sept", "siete", "sieben"), ("eight", "huit", "ocho", "acht"),
    ("nine", "neuf", "nueve", "neun"),
)
LETTER_DIGITS = {"o": "0", "O": "0", "l": "1", "I": "1", "|": "1"}

_FOLD = {x: to for group in (LOOK_ALIKE_LETTERS, LOOK_ALIKE_MARKS) for to, some in group.items() for x in some}
_WIDE = {chr(c): chr(c - 0xFEE0) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_LETTERS = "[" + "".join(x for some in LOOK_ALIKE_LETTERS.values() for x in some) + "]"
_OTHERS = "[" + "".join((*"".join(LOOK_ALIKE_MARKS.values()), *_WIDE)) + "]"
# letters count only beside Latin ones, so that texts in those scripts stay as they are
_FOLDED = re.compile(
    rf"{_OTHERS}|(?![0-9])\d|(?<=[A-Za-z0-9@._-]){_LETTERS}++|(?<!{_LETTERS[:-1]}A-Za-z0-9@._-]){_LETTERS}++(?=[A-Za-z0-9@_-])")

_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
# these read the text in lower case, character for character
_BRACKETED = re.compile(
    rf"{_OPEN}[ ]?(?:(?P<at>@|{'|'.join(AT_WORDS)})|(?P<dot>\.|{'|'.join(DOT_WORDS)}))[ ]?{_SHUT}")
# bare words count only together: `` at host dot end`` after a name
_HOST, _DOTS = r"[a-z0-9-]++", rf"(?: (?:{'|'.join(DOT_WORDS)}) )"
_SPOKEN = re.compile(
    rf"(?<=[a-z0-9_%+-])(?P<at> (?:{'|'.join(AT_WORDS)}) )(?!(?:{'|'.join(NO_HOSTS)}) )(?P<host>{_HOST}(?:(?:\.|{_DOTS}){_HOST})*)")
_SPOKEN_END = re.compile(rf"{_DOTS}[a-z]{{2,}}\Z")
_DOT = re.compile(_DOTS)
_DOT_BEFORE = re.compile(rf"[a-z0-9_%+-](?={_DOTS}\Z)")
_LONGEST_DOT = max(map(len, DOT_WORDS)) + 3

_DIGIT = {w: str(k) for k, some in enumerate(DIGIT_WORDS) for w in some}
_ANY_DIGIT = "|".join(sorted(_DIGIT, key=len, reverse=True))
_SPELLED = re.compile(
    rf"(?<!\w)(?:(?:{'|'.join(PLUS_WORDS)}) )?+(?:{_ANY_DIGIT}|[0-9]++)"
    rf"(?:(?:[ -]|\.| (?:{'|'.join(DOT_WORDS)}) |, )(?:{_ANY_DIGIT}|[0-9]++))+(?!\w)")
_SPELLED_PART = re.compile(
    rf"(?P<digit>{_ANY_DIGIT})|(?P<dot> (?:{'|'.join(DOT_WORDS)}) )|(?P<plus>(?:{'|'.join(PLUS_WORDS)}) )|(?P<comma>, )")
# a run counts if it holds a spelled digit between its first and its last one
_SPELLED_INSIDE = re.compile(rf"[ ,.-](?:{_ANY_DIGIT})[ ,.-]")
_LETTERED = re.compile(r"(?<=[0-9])[oOlI|]++(?=[\x20-]?[0-9])|(?<=[0-9][\x20-])[oOlI|]++(?=[0-9])")
_LETTER_AFTER = re.compile(r"[0-9][\x20-]?[oOlI|]")
_SOME_DIGIT = re.compile("[0-9]")

Edit = tuple[int, int, str]


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """A match's local part is the run before an ``@``; other starts lead to no other match."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= IP_MOST


def spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one text, by start, then kind."""
    out = [("email", a, b) for a, b in email_spans(text)] if "@" in text else []
    if not _SOME_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if CARD_DIGITS[0] <= m.end() - m.start() <= 2 * CARD_DIGITS[1] and \
                CARD_DIGITS[0] <= len(d := _digits(m[0])) <= CARD_DIGITS[1] and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
                out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


class Rewritten:
    """A text after edits ``(start, end, replacement)``, and the way back.

    Only the edits are kept: between them both texts run in parallel. A place maps
    back to the source through every transducer's edits in turn.
    """

    def __init__(self, text: str, edits: Iterable[Edit], before: Rewritten | None = None):
        self.before, self.starts, self.ends, self.source = before, [], [], []
        out, at, size = [], 0, 0
        for start, end, new in edits:
            out += (text[at:start], new)
            size += start - at
            self.starts.append(size)
            size += len(new)
            self.ends.append(size)
            self.source.append((start, end))
            at = end
        out.append(text[at:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of ``start:end``, and whether an edit lies inside it."""
        a, b = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_left(self.starts, end) - 1
        left = start if a < 0 else self.source[a][0] if start < self.ends[a] else self.source[a][1] + start - self.ends[a]
        right = end if b < 0 else self.source[b][1] + max(end - self.ends[b], 0)
        inside = b > a or a >= 0 and start < self.ends[a]
        if self.before is None:
            return left, right, inside
        left, right, more = self.before.back(left, right)
        return left, right, inside or more


def look_alikes(text: str) -> Iterator[Edit]:
    """Look-alike letters beside Latin ones, marks, and digits of any script; invisible
    characters vanish."""
    if not text.isascii():
        for m in _FOLDED.finditer(text):
            for k, c in enumerate(m[0], m.start()):
                yield k, k + 1, _FOLD[c] if c in _FOLD else _WIDE[c] if c in _WIDE else str(unicodedata.digit(c))


def _apart(found: list[Edit]) -> Iterator[Edit]:
    """Edits in order; of those that overlap the first."""
    done = 0
    for edit in sorted(found):
        if edit[0] >= done:
            yield edit
            done = edit[1]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def marks(text: str) -> Iterator[Edit]:
    """``[at]``, ``(dot)`` and ``name at host dot end``."""
    text = _lower(text)
    found: list[Edit] = []
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        found.append((a - (text[a - 1:a] == " "), b + (text[b:b + 1] == " "), "@" if m["at"] else "."))
    for m in _SPOKEN.finditer(text) if any(f" {w} " in text for w in DOT_WORDS) else ():
        if not _SPOKEN_END.search(m["host"][-80:]):
            continue
        found.append((*m.span("at"), "@"))
        found += [(*d.span(), ".") for d in _DOT.finditer(text, *m.span("host"))]
        at = m.start()
        while True:     # the name may hold spoken dots, too
            while at and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            if not (d := _DOT_BEFORE.search(text, max(at - _LONGEST_DOT - 1, 0), at)):
                break
            found.append((d.end(), at, "."))
            at = d.end()
    return _apart(found)


def digits(text: str) -> Iterator[Edit]:
    """Runs of spelled digits become digits; letters among digits that look like one, too."""
    found: list[Edit] = []
    if _SPELLED_INSIDE.search(low := _lower(text)):
        for m in _SPELLED.finditer(low):
            if not _SPELLED_INSIDE.search(low, *m.span()):
                continue
            parts = list(_SPELLED_PART.finditer(low, *m.span()))
            spelled = [p for p in parts if p["digit"]]
            for p in parts:
                found.append((*p.span(), "." if p["dot"] else "+" if p["plus"] else " " if p["comma"] else _DIGIT[p[0]]))
            # blanks between two spelled digits go, so that they form one number
            found += [(p.end(), q.start(), "") for p, q in zip(spelled, spelled[1:]) if low[p.end():q.start()] in (" ", "-")]
    if _LETTER_AFTER.search(text):
        found += [(*m.span(), "".join(LETTER_DIGITS[c] for c in m[0])) for m in _LETTERED.finditer(text)]
    return _apart(found)


TRANSDUCERS = (look_alikes, marks, digits)


def _strict(kind: str, text: str, start: int, end: int) -> bool:
    """Edges that a disguised identifier must have, as rewriting makes chance ones likelier."""
    before, after = text[start - 1:start], text[end:end + 1]
    if before.isalnum() or after.isalnum():
        return False
    if kind == "email":
        return re.search(r"\.[A-Za-z]{2,}\Z", text[max(start, end - 64):end]) is not None
    if kind == "ip":
        return not re.match(r"\.[0-9]", text[end:end + 2]) and not re.search(r"[0-9]\.\Z", text[max(start - 2, 0):start])
    return True


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans that show only in the normalised text, in places of the source."""
    last, now = None, text
    for transducer in TRANSDUCERS:
        edits = list(transducer(now))
        if edits:
            last = Rewritten(now, edits, last)
            now = last.text
    out = []
    if last is not None:
        for kind, start, end in spans(now):
            a, b, edited = last.back(start, end)
            if edited and _strict(kind, now, start, end):
                out.append((kind, a, b))
    return out


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Base and disguised spans, by start, then kind, then end; the last field says which.

    A disguised span that cuts into a base span of its kind is left out; one that
    holds it whole, or apart from it, is not.
    """
    base = spans(text)
    out = [(*s, False) for s in base]
    known = set(base)
    for kind, a, b in disguised(text):
        clash = any(k == kind and x < b and a < y and not (a <= x and y <= b) for k, x, y in base)
        if not clash and (kind, a, b) not in known:
            known.add((kind, a, b))
            out.append((kind, a, b, True))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_()),
                   ("value", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1):
            source = text.as_py() or ""
            found.append([{"kind": k, "start": a, "end": b, "disguised": d, "value": source[a:b]}
                          for k, a, b, d in all_spans(source)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, disguised, value>>``, one row per row.

    ``start`` and ``end`` count code points of the source text, end exclusive; ``value``
    is the source's own characters. A null text is empty; null and repeated ids are
    rows of their own; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,disguised:boolean,value:string>>")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of their places, and all places."""
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: ~s["disguised"])
    return found.select(
        "doc_id",
        *(F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
