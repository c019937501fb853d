"""File names and file bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmill.fixed_values import ACCEPTED_TYPES, DEFAULT_FILENAME, IMAGE_TYPES, UNKNOWN_TYPE
from docmill.functions.text import strip


def file_type(filename: Column) -> Column:
    """Extension if accepted, else ``unknown``. A name without a dot is its own
    extension, so a file called ``pdf`` is a pdf."""
    extension = F.lower(F.substring_index(filename, ".", -1))
    return F.when(extension.isin(*ACCEPTED_TYPES), extension).otherwise(UNKNOWN_TYPE)


def filename_or_default(filename: Column) -> Column:
    return F.when(F.coalesce(filename, F.lit("")) != "", filename).otherwise(DEFAULT_FILENAME)


def route(filename: Column) -> Column:
    """Which reader a file needs: ``pdf``, ``image`` or ``text``. Here a name
    without a dot has no extension."""
    name = filename_or_default(filename)
    extension = F.when(
        F.contains(name, F.lit(".")), F.substring_index(F.lower(name), ".", -1)
    ).otherwise("")
    return (
        F.when(extension == "pdf", "pdf")
        .when(extension.isin(*IMAGE_TYPES), "image")
        .otherwise("text")
    )


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid UTF-8, else as Latin-1."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def combine_texts(text: Column, ocr_texts: Column) -> Column:
    """Direct text and OCR texts, empties dropped, one per line, stripped."""
    parts = F.filter(
        F.concat(F.array(text), F.coalesce(ocr_texts, F.expr("cast(array() as array<string>)"))),
        lambda part: F.coalesce(part, F.lit("")) != "",
    )
    return strip(F.array_join(parts, "\n"))
