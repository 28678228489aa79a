"""Matching forms of whole batches of texts, with the places that their characters come from, by array operations.

A batch is one array of code points. A table gives the form of each code point, filled as code points are met; those with
several characters are spread by run lengths. What a character-by-character walk would decide about spaces follows from
running maxima over that array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from unicodedata import normalize

import numpy as np

#: Characters that count as a space beside white space; fixed values.
SEPARATORS = "·•….-_—–/╱()（）"

#: Characters of a batch that are looked at together; bounds the memory.
CHARACTERS = 1 << 20

_UNKNOWN = -1
_table = np.full(0x110000, _UNKNOWN, np.int32)
_several: list[np.ndarray] = []


def form_of(character: str) -> str:
    """NFKC and lower case of one character; white space and separators are spaces."""
    return "".join(" " if c.isspace() or c in SEPARATORS else c for c in normalize("NFKC", character).lower())


def _looked_up(codes: np.ndarray) -> np.ndarray:
    """The form of each code point: its code, or -2 - i for the i-th of several characters."""
    found = _table[codes]
    if (found == _UNKNOWN).any():
        for code in np.unique(codes[found == _UNKNOWN]).tolist():
            form = form_of(chr(code))
            if len(form) == 1:
                _table[code] = ord(form)
            else:
                _several.append(np.array([ord(c) for c in form], np.int32))
                _table[code] = -1 - len(_several)
        found = _table[codes]
    return found


def _batch(texts: Sequence[str]) -> tuple[list[str], list[np.ndarray]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    forms = _looked_up(codes)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.flatnonzero(forms < _UNKNOWN)
    if len(wide):
        spread = [_several[-2 - i] for i in forms[wide].tolist()]
        times = np.ones(len(forms), np.int64)
        times[wide] = [len(s) for s in spread]
        where = np.repeat(forms < _UNKNOWN, times)
        forms, text, place = np.repeat(forms, times), np.repeat(text, times), np.repeat(place, times)
        if where.any():
            forms[where] = np.concatenate(spread)
    at = np.arange(len(forms))
    solid = forms != 32
    starts = np.searchsorted(text, np.arange(len(texts)))
    before = np.maximum.accumulate(np.where(solid, at, -1)) if len(at) else at
    follows = np.concatenate((solid[1:] & (text[1:] == text[:-1]), [False])) if len(at) else solid
    # the last space between two pieces stays
    keep = solid | (follows & (before >= starts[text]))
    kept = np.bincount(text[keep], minlength=len(texts))
    whole, places = forms[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), place[keep]
    ends = np.cumsum(kept)
    cuts = list(zip((ends - kept).tolist(), ends.tolist()))
    return [whole[a:b] for a, b in cuts], [places[a:b] for a, b in cuts]


def normal_forms(texts: Sequence[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Matching form of each text, and for each of its characters the place in the text that it comes from."""
    block, held = [], 0
    for text in texts:
        if block and held + len(text) > CHARACTERS:
            yield from zip(*_batch(block))
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield from zip(*_batch(block))
