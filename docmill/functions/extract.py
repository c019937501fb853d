"""Extraction functions: e-mails, phones, dates, signers and clauses in a text.

Each returns what scanning the plain pattern of ``fixed_values`` left to right
gives. Where the Java form differs from the plain one, it is to keep the time
linear and the stack flat on hostile text; the language is unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from docmill.fixed_values import (
    CLAUSE_KEYWORDS, DATE_PATTERN, EMAIL_PATTERN, PHONE_PATTERN, SIGNER_PATTERN,
)
from docmill.functions.text import SPACE, WORD, bind, extract_all, no_strings

_LOCAL = EMAIL_PATTERN[:EMAIL_PATTERN.index("]") + 1]
# A local part can only begin where a run of its characters begins or where the
# previous match ended, and never gives characters back. So a long run without
# "@" is read once instead of once per character.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+" + EMAIL_PATTERN.removeprefix(_LOCAL)

_PHONE = "(?U)" + PHONE_PATTERN.replace(r"\s", r"\s\x1C-\x1F")

# A cheap look at the first character comes before all that is costlier; it never decides.
# "\b" next to a digit, spelled with the word class of functions.text
_DATE = r"(?U)(?=\d)" + (
    DATE_PATTERN.removeprefix(r"\b").removesuffix(r"\b").join((rf"(?<!{WORD})", rf"(?!{WORD})"))
)

# Possessive repeats: the words after the trigger are matched in a loop instead
# of by recursion, which overflows the stack on long unpunctuated text. None of
# them can be followed by a character it could give back.
_SIGNER = SIGNER_PATTERN.replace("(", "(?:", 1)
for _loose in (r"\s*", r"[:\-]?", "[a-z]+", ")*"):
    _SIGNER = _SIGNER.replace(_loose, _loose + "+")
_SIGNER = "(?iU)(?=[sa])" + _SIGNER.replace(r"\s", SPACE)


def emails(text: Column) -> Column:
    # most texts have no "@", and finding that out is far cheaper than the scan
    return F.when(F.contains(text, F.lit("@")), extract_all(text, _EMAIL)).otherwise(no_strings())


def phones(text: Column) -> Column:
    return extract_all(text, _PHONE)


def raw_dates(text: Column) -> Column:
    return extract_all(text, _DATE)


def signers(text: Column) -> Column:
    return extract_all(text, _SIGNER, 1)


def parse_date(raw: Column) -> Column:
    """ISO text of one matched date, null if it is no date.

    Month first; day first where that fails. Two-digit years follow the POSIX
    pivot (69-99 -> 19xx); three-digit years are no dates.
    """
    part = F.split(raw, "[/-]")
    year = (
        F.when(F.length(part[2]) == 4, part[2])
        .when((F.length(part[2]) == 2) & (part[2] >= "69"), F.concat(F.lit("19"), part[2]))
        .when(F.length(part[2]) == 2, F.concat(F.lit("20"), part[2]))
    )

    def as_date(month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("/", month, day, year), "M/d/yyyy")

    parsed = F.coalesce(as_date(part[0], part[1]), as_date(part[1], part[0]))
    return F.when(year.isNotNull(), F.date_format(parsed, "yyyy-MM-dd"))


def dates(text: Column) -> Column:
    return F.array_compact(F.transform(raw_dates(text), parse_date))


def distinct_sorted(values: Column) -> Column:
    """Distinct values in a stable order."""
    return F.array_sort(F.array_distinct(values))


# --- Clauses ---------------------------------------------------------------

# Letters that match an ASCII letter when case is ignored: dotted capital I,
# dotless i, long s and the Kelvin sign.
_FOLDED_FROM, _FOLDED_TO = "İıſK", "iisk"


def _keyword_pattern(alternatives: Sequence[str]) -> str:
    """Whole keywords, any case. A keyword edge that is no word character has
    the opposite demand on its neighbour, as a word boundary does."""
    def bounded(kw: str) -> str:
        before = rf"(?<!{WORD})" if re.match(r"\w", kw) else rf"(?<={WORD})"
        after = rf"(?!{WORD})" if re.search(r"\w\Z", kw) else rf"(?={WORD})"
        return before + r"\Q" + kw + r"\E" + after

    if all(re.fullmatch(r"\w(?:.*\w)?", kw) for kw in alternatives):
        joined = "|".join(r"\Q" + kw + r"\E" for kw in alternatives)
        first = "".join(sorted({kw[0].lower() for kw in alternatives}))
        return rf"(?iU)(?=[{first}])(?<!{WORD})(?:{joined})(?!{WORD})"
    return "(?iU)" + "|".join(bounded(kw) for kw in alternatives)


def _disjoint_groups(keywords: Sequence[str]) -> list[list[str]]:
    """Split keywords so that those in a group share no word.

    Matches of such keywords never overlap, so one scan finds them all.
    """
    groups: list[tuple[set[str], list[str]]] = []
    for kw in keywords:
        parts = set(re.findall(r"\w+", kw.lower())) or {kw}
        for seen, members in groups:
            if kw.isascii() and members[0].isascii() and not parts & seen:
                seen |= parts
                members.append(kw)
                break
        else:
            groups.append((set(parts), [kw]))
    return [members for _, members in groups]


def clause_occurrences(text: Column, keywords: Sequence[str] = CLAUSE_KEYWORDS) -> Column:
    """One array entry, the keyword, per whole-word occurrence."""
    found = []
    for group in _disjoint_groups(keywords):
        pattern = _keyword_pattern(group)
        if len(group) == 1:
            found.append(F.array_repeat(F.lit(group[0]), F.regexp_count(text, F.lit(pattern))))
        else:
            names = F.create_map(*[F.lit(x) for kw in group for x in (kw.lower(), kw)])
            found.append(F.transform(
                extract_all(text, pattern),
                lambda m: names[F.lower(F.translate(m, _FOLDED_FROM, _FOLDED_TO))],
            ))
    return F.concat(*found)


def clause_counts(text: Column, keywords: Sequence[str] = CLAUSE_KEYWORDS) -> Column:
    """``map<keyword,int>`` with every keyword, zeros kept."""
    names = F.array(*[F.lit(kw) for kw in keywords])
    return bind(
        clause_occurrences(text, keywords),
        lambda found: F.map_from_arrays(
            names, F.transform(names, lambda kw: F.size(F.filter(found, lambda m: m == kw)))
        ),
    )


def clauses_present(text: Column, keywords: Sequence[str] = CLAUSE_KEYWORDS) -> Column:
    """Keywords that occur, in keyword-list order."""
    names = F.array(*[F.lit(kw) for kw in keywords])
    return F.array_intersect(names, clause_occurrences(text, keywords))


def total_clauses(counts: Column) -> Column:
    """Occurrences over all keywords of a ``clause_counts`` map."""
    return F.aggregate(F.map_values(counts), F.lit(0), lambda total, n: total + n)
