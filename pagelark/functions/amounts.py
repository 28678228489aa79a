"""Printed amounts: grammar, value, and whether a text states a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,4)"

# The grammar of printed amounts, and of amounts within a text.
_BODY = r"(?:\d{1,3}(?:(?:[,，]|\s)\d{3})+|\d+)(?:\.\d+)?"
AMOUNT = rf"(?U)^\s*(?:\(\s*{_BODY}\s*\)|（\s*{_BODY}\s*）|[+\-−–—]?\s*{_BODY})\s*$"
DASH = r"(?U)^\s*[-−–—]\s*$"
_STATED_BODY = r"\d+(?:(?:[,，]|\s)\d{3})*(?:\.\d+)?"
STATED = rf"(?U)\(\s*{_STATED_BODY}\s*\)|（\s*{_STATED_BODY}\s*）|[-−–—]\s*{_STATED_BODY}|{_STATED_BODY}"


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def is_dash(text: Column) -> Column:
    """An empty cell of a printed table."""
    return text.rlike(DASH)


def is_amount(text: Column) -> Column:
    return text.rlike(AMOUNT)


def amount(text: Column) -> Column:
    """Value of a printed amount, null if it isn't one; parentheses of one kind around it mean negative."""
    plain = F.regexp_replace(_ascii_digits(text), r"(?U)[\s,，()（）+−–—-]", "")
    negative = text.rlike(r"[()（）−–—-]")
    value = plain.try_cast(DECIMAL)
    return F.when(is_amount(text), F.when(negative, -value).otherwise(value)).cast(DECIMAL)


def decimal_of(text: Column) -> Column:
    """Finite decimal or null; blanks, NaN and infinities are null."""
    return F.trim(text).try_cast(DECIMAL)


def states_amount(text: Column, value: Column) -> Column:
    """Whether an amount of exactly this value is printed in the text, its sign included."""
    tokens = F.regexp_extract_all(text, F.lit(STATED), F.lit(0))

    def equal(token: Column) -> Column:
        size = F.regexp_replace(_ascii_digits(token), r"[ ,，()（）−–—-]", "").try_cast(DECIMAL)
        signed = F.when(token.rlike(r"^[(（−–—-]"), -size).otherwise(size)
        return F.coalesce(signed == value, F.lit(False))

    return F.coalesce(F.exists(tokens, equal), F.lit(False))
