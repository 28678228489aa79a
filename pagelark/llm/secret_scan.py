"""Secret scan by assignment-aware lexing.

A text that may hold an assignment is lexed once, left to right, into names, string literals, bare words, numbers and
operators. From that come name-literal pairs in the forms of source and configuration files: `name = "x"`,
`name: x`, `"name": "x"`, `name := x`, `export NAME=x`, `<name>x</name>`, `--name x`. Literals joined by `+` or by
standing side by side are one literal. A pair defines a constant; where the right side is itself a name that the text
defines, its literal is propagated, through several names and whichever comes first: `a = "xyz"` before or after
`db_password = a` marks the literal of `a`. Of several definitions the last one before the use counts, else the first one
after it. A literal is scored by how
sensitive its target name is (parts of the name, split at case changes and punctuation) and by what it looks like; the
pairs that reach the threshold are added spans, kind `literal`, unless a base span covers or meets them.

Base spans (assign, access, hex) are fixed patterns; they always stay.

The lexer is Python in Arrow batches. Each row is worked on alone with memory linear in its text, so there is no shuffle,
and a lost executor costs its own tasks only. A text without any of the base patterns' fixed characters and without an
assignment sign next to a sensitive word is passed over after a few substring searches.

Cases: a null or empty text has no spans; texts are scanned whole; each row stands for itself, so null or repeated ids
don't matter; extra columns pass through untouched unless they bear the name of an output column, which then replaces
them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")

#: Base patterns; fixed values. Letters of the names match in either case, A-Z only.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How much a part of a target name tells; fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.8, "private": 0.5, "access": 0.4,
    "api": 0.4, "key": 0.5, "signing": 0.5, "encryption": 0.5, "client": 0.2, "dsn": 0.5, "salt": 0.5, "session": 0.3,
}
#: Parts that name something public; fixed values.
HARMLESS = {"public": -0.8, "name": -0.5, "id": -0.3, "url": -0.4, "path": -0.5, "file": -0.5, "length": -0.8, "type": -0.6, "count": -0.8, "field": -0.6, "hint": -0.8, "prompt": -0.8, "expiry": -0.6, "expires": -0.6, "ttl": -0.8, "min": -0.6, "max": -0.6}
#: Literals that stand for a missing value; fixed values.
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|true|false|undefined|changeme|change_me|example|placeholder|redacted|todo|x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[-_ ].*)$")
THRESHOLD = 1.0

LEX = re.compile(
    r"""(?P<comment>(?<!\S)(?:\#|//)\x20)|(?P<string>(?<!\\)"(?:[^"\\\n]|\\.)*"|(?<!\\)'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<flag>(?<![\w-])--[A-Za-z][\w-]*)|(?P<open><[A-Za-z][\w.-]*>)"""
    r"""|(?P<word>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<number>\d[\w.+/=-]*)"""
    r"""|(?P<assign>:=|=>|==|!=|<=|>=|=|:)|(?P<plus>\+)|(?P<line>\n)|(?P<other>[^\s])""",
    re.ASCII,
)
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^&*-]{6,}", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: What a name of any score holds once only its letters and digits are left: the keys of SENSITIVE without their extensions.
HINTS = tuple(k.encode() for k in SENSITIVE if not any(o != k and o in k for o in SENSITIVE))
_LOWER = bytes(range(256)).lower()
_BETWEEN = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
SIGN = re.compile(r"[=:]|--|>")


def base_matches(text: str) -> list[tuple[int, int, str]]:
    """(start, rank, end) of base spans; rank is the kind's place in KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """How sensitive a target name is."""
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    good = [SENSITIVE[p] for p in parts + joined if p in SENSITIVE]
    if not good:
        return 0.0
    return max(good) + 0.3 * (sum(good) - max(good)) + sum(HARMLESS.get(p, 0.0) for p in parts)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret rather than a word, a number or a placeholder."""
    if len(value) < 8 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return -1.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    if classes < 2 or not re.search("[0-9]", value) or entropy < 2.5:
        return -0.5
    return 0.1 * (classes - 1) + 0.1 * min(3.0, entropy - 2.5)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(target name, literal, start, end) of the assignments of a text, constants propagated."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in LEX.finditer(text)]
    n = len(tokens)
    word = lambda i: text[tokens[i][1] : tokens[i][2]]

    def target(i: int) -> tuple[str, int]:
        """Name that the token assigns to and the place of what it gets; "" if it is no target."""
        kind = tokens[i][0]
        if kind in ("word", "string") and i + 1 < n and tokens[i + 1][0] == "assign" and word(i + 1) in ("=", ":", ":=", "=>"):
            return word(i).strip("\"'`"), i + 2
        if kind == "string" and 0 < i < n - 2 and word(i - 1) == "[" and word(i + 1) == "]" and word(i + 2) in ("=", ":="):
            return word(i)[1:-1], i + 3  # an entry by its key
        if kind == "flag" and i + 1 < n:
            return word(i)[2:], i + 1 + (word(i + 1) == "=")
        return (word(i)[1:-1], i + 1) if kind == "open" else ("", i)

    def block(i: int) -> int:
        """Place of the first token of a block scalar that the token at i opens; i itself if it opens none."""
        if not (1 <= i < n and word(i) in ("|", ">") and word(i - 1) == ":"):
            return i
        j = i + 1
        while j < n and (word(j) in ("-", "+") or tokens[j][0] == "number") and tokens[j][1] == tokens[j - 1][2]:
            j += 1
        first = j
        while j < n and tokens[j][0] == "line":
            j += 1
        return j if first < j < n else i

    defined = {name for i in range(n) if (name := target(i)[0])}
    found: list[tuple[str, tuple[str, int, int] | None, str]] = []  # name, literal, the name that it refers to
    i = 0
    while i < n:
        name, at = target(i)
        if not name or at >= n:
            i += 1
            continue
        opened = block(at)
        of_block, at = opened != at, opened
        joined, first, last, j = "", None, None, at
        while j < n and tokens[j][0] == "string" and len(word(j)) >= 2:
            joined, first, last = joined + word(j)[1:-1], tokens[j][1] + 1 if first is None else first, tokens[j][2] - 1
            j += 1 + (j + 2 < n and tokens[j + 1][0] == "plus" and tokens[j + 2][0] == "string")
        refers = ""
        if first is None and tokens[at][0] in ("word", "number", "plus", "other"):
            if tokens[at][0] == "word" and word(at) in defined and not of_block:
                refers = word(at)
            elif bare := BARE.match(text, tokens[at][1]):
                joined, first = bare[0].rstrip(".=,;"), tokens[at][1]
                last = first + len(joined)
                while j < n and tokens[j][1] < last:
                    j += 1
        literal = (joined, first, last) if first is not None and joined else None
        if literal or refers:
            found.append((name, literal, refers))
        i = at if refers else max(j, i + 1) if literal else i + 1
    places: dict[str, list[int]] = {}
    for k, (name, *_) in enumerate(found):
        places.setdefault(name, []).append(k)
    ends: dict[int, tuple[str, int, int] | None] = {}  # what the chain of names from an assignment on leads to
    for k, (name, literal, _) in enumerate(found):
        path, here = [], k
        while here not in ends and found[here][2]:
            ends[here] = None  # until known; a chain that comes back here leads nowhere
            path.append(here)
            of = places.get(found[here][2], [])
            cut = bisect_left(of, here)
            here = of[cut - 1] if cut else next((x for x in of[:2] if x != here), here)
        end = ends[here] if here in ends else found[here][1]
        for x in path:
            ends[x] = end
        if literal := (end or literal):
            yield name, *literal


def hinted(text: str) -> bool:
    """Whether a name in the text may be sensitive; true wherever name_score is above 0, also by parts that are joined."""
    left = text.encode("ascii", "ignore").translate(_LOWER, _BETWEEN)
    return any(k in left for k in HINTS)


def literal_matches(text: str) -> list[tuple[int, int, str]]:
    """(start, rank, end) of literals whose pair reaches the threshold."""
    if not (SIGN.search(text) and hinted(text)):
        return []
    found = set()
    for name, value, start, end in pairs(text):
        sensitive = name_score(name)
        if sensitive > 0 and (look := literal_score(value)) > 0 and sensitive + look >= THRESHOLD:
            found.add((start, 3, end))
    return sorted(found)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of one text."""
    if not text:
        return [], []
    base = base_matches(text)
    added, at = [], 0
    for s in literal_matches(text):
        while at < len(base) and base[at][2] <= s[0] and (at + 1 >= len(base) or base[at + 1][0] <= s[0]):
            at += 1
        if all(b[2] <= s[0] or s[2] <= b[0] for b in base[max(0, at - 2) : at + 4]) and (not added or added[-1][2] <= s[0]):
            added.append(s)
    return base, added


SPAN = "array<struct<start:int,rank:int,end:int>>"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    as_rows = lambda spans: [{"start": s, "rank": r, "end": e} for s, r, e in spans]
    for texts in batches:
        found = [scan_text(t) for t in texts]
        yield pd.DataFrame({"base": [as_rows(b) for b, _ in found], "added": [as_rows(a) for _, a in found]})


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base and added, array<struct<start, rank, end>> in order; rank is the kind's place in KINDS."""
    docs = docs.drop("base", "added", "_found")
    found = F.pandas_udf(_scan, f"base {SPAN}, added {SPAN}")(F.col(text_col))
    return docs.withColumn("_found", found).select(*docs.columns, "_found.base", "_found.added")


def written(array: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    name = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(array), name), ",")
