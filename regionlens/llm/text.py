"""Words as all operators of this package see them.

A word is a run of characters other than space and the control characters 0x09 to 0x0D.
``bytes.split()`` and ``bytes.lower()`` follow exactly that rule on UTF-8: they know the six
ASCII white-space bytes and the 26 ASCII capitals, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; NULL counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return utf8(text).lower().split()


def words_of(text: Column) -> Column:
    """The words of a text as an array column; empty for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
