"""Text helpers with Unicode semantics.

``SPACE`` and ``WORD`` spell out the character classes. Java's own ``\\s`` (in
``(?U)`` mode) lacks U+001C-U+001F, and its ``\\w`` counts combining marks but
not numerals such as a superscript two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"[^\s\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]"

# the characters of SPACE
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Expressions inside a lambda are evaluated per element; binding the value
    as a lambda variable keeps a costly regular expression from running again.
    """
    return F.transform(F.array(value), body)[0]


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Remove whitespace of every kind from both ends (``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(_SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U){NOT_SPACE}")


def split_space(text: Column) -> Column:
    """Pieces between whitespace runs, without empty ones."""
    return extract_all(text, rf"(?U){NOT_SPACE}+")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return extract_all(text, rf"{WORD}+")


def alphabetic_words(text: Column) -> Column:
    """Whole words made of letters only: ``ab1`` gives nothing."""
    return extract_all(text, rf"(?<!{WORD})\p{{L}}++(?!{WORD})")


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(strip(text), rf"(?U)(?<=[.!?]){SPACE}+")


def preview(text: Column, chars: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def clean_text(text: Column) -> Column:
    """Strip, collapse whitespace, keep only ``A-Za-z0-9,.!?`` and spaces."""
    collapsed = F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")
    # ASCII letters and digits; Java scans the negated class [^A-Za-z0-9..] far slower
    return F.coalesce(F.regexp_replace(collapsed, r"[^\p{Alnum},.!? ]+", ""), F.lit(""))


def join_in_order(position: Column, piece: Column, separator: str) -> Column:
    """Aggregate: concatenate ``piece`` by ``position``, whatever the shuffle did."""
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("pos"), piece.alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), separator)


def round_half_even_2(value: Column) -> Column:
    """Round a double to two places on its exact binary value, ties to even.

    ``bround`` rounds the shortest decimal spelling (2.675 -> 2.68, though the
    double lies below the tie). Here ``twice + error`` is exactly ``value*200``:
    ``high + low`` splits the value so that both products are exact. A tie needs
    ``twice`` to be an odd integer, and then ``error`` tells the true side.
    """
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    low = value - high
    twice = value * F.lit(200.0)
    error = (high * F.lit(200.0) - twice) + low * F.lit(200.0)
    below = F.floor(twice / 2)
    is_tie = (twice == F.floor(twice)) & (F.pmod(twice, F.lit(2.0)) == 1)
    goes_up = (error > 0) | ((error == 0) & (F.pmod(below, F.lit(2)) == 1))
    nearest = F.when(is_tie, below + F.when(goes_up, 1).otherwise(0)).otherwise(F.rint(twice / 2))
    return nearest.cast("double") / 100
