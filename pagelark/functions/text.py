"""Normal forms, lines and phrase tests of text columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .forms import SEPARATORS, normal_forms

_PIECE = re.compile(r"[^ ]+")


def normal_form(text: str) -> tuple[str, list[int]]:
    """Matching form of a text, and for each of its characters the place in the text that it comes from.

    NFKC and lower case, character by character; white space and separators become single spaces between the pieces. The
    place of such a space is that of the last character before the next piece.
    """
    spread = [(item, i) for i, c in enumerate(text) for item in normalize("NFKC", c).lower()]
    flat = "".join(" " if item.isspace() or item in SEPARATORS else item for item, _ in spread)
    parts: list[str] = []
    places: list[int] = []
    for piece in _PIECE.finditer(flat):
        if parts:
            parts.append(" ")
            places.append(spread[piece.start() - 1][1])
        parts.append(piece[0])
        places += [i for _, i in spread[piece.start() : piece.end()]]
    return "".join(parts), places


def normalised(text: str) -> str:
    return next(normal_forms([text]))[0]


def compacted(text: str) -> str:
    """The matching form without its spaces."""
    return normalised(text).replace(" ", "")


def _normalise_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        there = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[there.to_numpy()] = [form for form, _ in normal_forms(texts[there].tolist())]
        yield out


#: Ranges of characters whose matching form is their lower case, beside ASCII: letters of Latin-1 and the first of Latin
#: Extended-A, CJK commas, stops and brackets, unified ideographs.
OWN_FORMS = ("\u00bf-\u012f", "\u3001-\u3002\u3008-\u3011", "\u4e00-\u9fff")


def normalise(text: Column) -> Column:
    """Matching form of a column. Spark has no NFKC, hence an Arrow function, which works on whole batches, for texts with
    characters that aren't ASCII or OWN_FORMS; the others take built-in functions. Compute it once for a corpus and keep it."""
    # runs of one range each are taken off: one class of all ranges would be tried character by character, ten times as slow
    runs = "|".join(f"[{r}]+" for r in (r"\x00-\x7f", *OWN_FORMS))
    built_in = (F.length(text) == F.octet_length(text)) | (F.regexp_replace(text, runs, "") == "")
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s\x0b\x1c-\x1f._/()-]+", " "))
    return F.when(built_in, plain).otherwise(F.pandas_udf(_normalise_batches, "string")(F.when(~built_in, text)))


def compact(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def phrases_in(normal: Column, phrases: Sequence[str]) -> Column:
    """The phrases, as written, whose matching form occurs in the spaced form of a text.

    Only the spaced form is looked at: a phrase that the text splits by a space is not a context.
    """
    return F.array_compact(F.array(*[F.when(F.contains(normal, F.lit(normalised(p))), F.lit(p)) for p in phrases]))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines without white space at their ends."""
    every = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return F.filter(F.transform(every, stripped), lambda line: line != "")


def one_spaced(text: Column) -> Column:
    """Words joined by single spaces; layout doesn't count."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, start: Column, end: Column, margin: int = 450) -> Column:
    """The text around [start, end), clipped."""
    first = F.greatest(F.lit(0), start - margin)
    last = F.least(F.length(text), end + margin)
    return F.substring(text, first + 1, last - first)


def looks_like_table(text: Column, normal: Column) -> Column:
    """At least 30 digits, and two years or dates or a printed unit."""
    digits = F.regexp_count(text, F.lit(r"(?U)\d"))
    columns = F.regexp_count(text, F.lit(r"(?U)(?:19|20)\d{2}|\d{1,2}月\d{1,2}日"))
    from .lexicon import TABLE_UNITS

    unit = F.lit(False)
    for phrase in TABLE_UNITS:
        unit = unit | F.contains(normal, F.lit(phrase))
    return (digits >= 30) & ((columns >= 2) | unit)


def joined_scores(scores: Column) -> Column:
    """Scores with four decimals, joined by bars."""
    return F.array_join(F.transform(scores, lambda s: F.format_string("%.4f", s)), "|")


def joined_texts(texts: Column) -> Column:
    """Texts on one line each, joined by double bars."""
    return F.array_join(F.transform(texts, lambda t: F.translate(t, "\r\n", "  ")), " || ")
