"""Text helpers that the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in, which is several times faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Bytes to bytes: A-Z to a-z, ASCII that is no letter or digit to a space; other bytes stay.
WORD_BYTES = bytes(
    code + 32
    if 65 <= code <= 90
    else code
    if 48 <= code <= 57 or 97 <= code <= 122 or code >= 128
    else 32
    for code in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z, as UTF-8."""
    return text.encode().lower().split() if text else []
