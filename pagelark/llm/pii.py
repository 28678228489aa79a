"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Two layers, both DataFrame expressions on whole texts:

* Base spans: one pattern for each kind (email, ip, card, phone) with a check of its digits. They always stay.
* Candidate spans from wider patterns (spelled-out addresses, numbers without a plus sign, numbers standing side by
  side, long ip forms). Five labelers vote 1, 0 or -1 on each: the base rule, a gazetteer, the words before the span,
  the shape and the internal structure. Beside the votes stand TRAITS of the span and of what surrounds it. Candidates
  are counted over all documents by (kind, votes, traits), a table of at most 4 x 3^5 x 2^8 rows. Expectation
  maximisation on the votes estimates each labeler's reliability and the chance that a candidate is personal data; a
  logistic span classifier learns that chance from the traits alone, which generalises over what the labelers abstain
  on or err in. Its weights are literals of the second scan, which adds the candidates that it accepts and that overlap
  no base span; of candidates that overlap each other the first stays.

Patterns are possessive where nothing can follow that would need backtracking, and start only where a run of their
characters starts or where the previous match ended, so a long run costs linear time. Positions are code points; they
are running totals of the lengths of matches and of what split() leaves between them. Running totals go in two levels,
so a text with n matches costs about n^1.5 steps. There is no shuffle but that of the counts.

Cases: a null or empty text has no spans. A text of any length is scanned whole. Nulls, ties and repeats of ids don't
matter, as each row stands for itself. Extra columns pass through untouched unless they bear the name of an output
column, which then replaces them. Without candidates the classifier keeps its prior weights.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Base patterns; fixed values.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
QUAD = rf"^{OCTET}(?:\.{OCTET}){{3}}$"

#: Wider patterns; their matches are only candidates.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "number": r"(?<![0-9])[0-9]{14,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])|(?<![\w.@-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w@]|[.-][0-9])",
}

#: Gazetteers; fixed values.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|co|biz|eu|de|fr|es|uk|us|it|nl|ch|at|be|jp|cn|in|br|au|ca|mx|hk"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|62)"
AREA_CODE = r"^[2-9][0-9]{2}[2-9]"
CUES = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|host|server|addr|ping|ipv6",
    "card": r"(?i)card|visa|amex|credit|debit|carte|karte|tarjeta|pan\b",
    "phone": r"(?i)tel|phone|call|fax|mobile|cell|m[oó]vil|whatsapp|sms",
}
COUNTER_CUES = r"(?i)isbn|order|invoice|serial|version|sku|part\x20no|ref\b|article|[#$€=]\x20?$"

VOTES = 5
#: What the classifier sees of a span, 1 where it speaks for personal data and -1 where it doesn't.
TRAITS = ("cue", "no_counter_cue", "free_left", "free_right", "known_prefix_or_ending", "checksum_or_structure", "usual_length", "varied")
ACCEPT = 0.85
#: Characters before a span that cues are looked for in.
CONTEXT = 24


def bound(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(v: str, op: str, zero: str) -> str:
    """SQL of the running totals of an array of int, by its name, under an associative op of s and x, each element included.

    aggregate() copies the array that it grows, so blocks of about the square root of the size are folded on their own
    and start from the totals of the blocks before.
    """
    width = f"greatest(16, cast(ceil(sqrt(size({v}))) as int))"
    starts = f"sequence(1, greatest(size({v}), 1), {width})"
    at = op.format(s="acc.at", x="x")
    folded = lambda array, first: (
        f"aggregate({array}, named_struct('at', {first}, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', {at}, 'out', concat(acc.out, array({at}))), acc -> acc.out)"
    )
    totals = f"transform({starts}, b -> aggregate(slice({v}, b, {width}), {zero}, (t, x) -> {op.format(s='t', x='x')}))"
    before = f"slice(concat(array({zero}), {folded(totals, zero)}), 1, size({starts}))"
    return f"flatten(zip_with({starts}, {before}, (b, first) -> {folded(f'slice({v}, b, {width})', 'first')}))"


def let(name: str, value: str, body: str) -> str:
    """SQL of body with the value bound to a name, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def pairs_of(text: Column, patterns: Sequence[tuple[str, Column]]) -> Column:
    """For each pattern its matches m with the gaps before them; the last gap has no match behind it.

    With each pattern stands a cheap test that holds for every text with a match.
    """
    none = F.expr("cast(array() as array<struct<gap:string,m:string>>)")
    found = lambda p: F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"))
    return F.array(*[F.when(there, found(p)).otherwise(none) for p, there in patterns])


def located(pairs: str, around: bool = False) -> Column:
    """For each pattern of the column that pairs_of gave, array<struct<start, end, m>> in code points, end exclusive.

    With `around` a match has also before, the last CONTEXT characters from the previous match's surroundings on, and
    after, the next character.
    """
    fields = "'start', get(e, i) - length(p.m), 'end', get(e, i), 'm', p.m"
    if around:
        last = "coalesce(get(pairs, i - 1).gap, ''), coalesce(get(pairs, i - 1).m, '')"
        fields += f", 'before', right(concat({last}, p.gap), {CONTEXT}), 'after', left(coalesce(get(pairs, i + 1).gap, ''), 1)"
    widths = "transform(pairs, p -> length(p.gap) + coalesce(length(p.m), 0))"
    placed = let("w", widths, let("e", running("w", "{s} + {x}", "0"), f"transform(pairs, (p, i) -> named_struct({fields}))"))
    return F.expr(f"transform({pairs}, pairs -> filter({placed}, m -> m.m is not null))")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the checksum of a string of digits holds."""

    def term(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + term(i))
    return F.when(F.length(number) > 0, total % 10 == 0).otherwise(F.lit(False))


def base_pairs(text: Column) -> Column:
    """pairs_of the base patterns, by KINDS; the digits are yet to be checked."""
    # most texts hold none of a pattern's fixed characters; looking for those is far cheaper than matching
    there = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    return pairs_of(text, [(BASE[k], there.get(k, text.rlike("[0-9]"))) for k in KINDS])


def passes(kind: str, s: Column) -> Column:
    """Whether the digits of a base match are as they should be."""
    d = digits(s["m"])
    if kind == "ip":
        return s["m"].rlike(QUAD)
    if kind == "card":
        return F.length(d).between(14, 19) & luhn(d)
    return F.length(d).between(10, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)).otherwise(F.lit(0)) if no is not None else out.otherwise(F.lit(-1))).cast("int")


def wide_pairs(text: Column) -> Column:
    """pairs_of the wider patterns, by WIDE."""
    there = {"email": text.rlike(r"@|[\[({]at[\])}]"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "number": text.rlike("[0-9]{3}")}
    return pairs_of(text, [(p, there[k]) for k, p in WIDE.items()])


def candidates(wide: Column) -> Column:
    """Candidates among located wide matches with their votes and traits, array<struct<kind, start, end, votes, traits>>."""

    def judged(kind: Column | str, s: Column, base: Column, gazetteer: Column, shape: Column, structure: Column, cue: Column, length: Column) -> Column:
        counter = s["before"].rlike(COUNTER_CUES)
        votes = [_vote(base, F.lit(False)), _vote(gazetteer), _vote(cue, counter), _vote(shape), _vote(structure)]
        traits = [
            cue, ~counter, (s["before"] == "") | s["before"].rlike(r"[\s,;:(\[<>|\x22']$"), s["after"].rlike(r"^(?:$|[\s,;:.!?)\]<>|\x22'])"), gazetteer, structure, length,
            ~s["m"].rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)*[^0-9]*$"),
        ]
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.array(*votes).alias("votes"), F.array(*[_vote(t) for t in traits]).alias("traits"),
        )

    def email(s: Column) -> Column:
        m = s["m"]
        return judged(
            "email", s, m.rlike("^" + BASE["email"] + "$"),
            m.rlike(rf"(?i)(?:\.|\[dot\]|\(dot\)|\{{dot\}})\x20?(?:{TOP_DOMAINS})$"),
            m.rlike(r"^[A-Za-z0-9]") & (F.length(m) <= 120),
            m.rlike(r"(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++$"), s["before"].rlike(CUES["email"]), F.length(m).between(6, 64),
        )

    def ip(s: Column) -> Column:
        known = s["m"].rlike(r"(?i)^(?:2[0-9a-f]{3}|fe80|fc|fd|0*:)")
        return judged("ip", s, F.lit(False), known, F.length(s["m"]) >= 15, s["m"].rlike("[0-9]"), s["before"].rlike(CUES["ip"]), F.length(s["m"]).between(20, 39))

    def number(s: Column) -> Column:
        m = s["m"]

        def of(d: Column) -> Column:
            card = (F.length(d) >= 13) & ~m.rlike(r"^\+|\(")
            holds = luhn(d)
            return judged(
                F.when(card, F.lit("card")).otherwise(F.lit("phone")), s, card & holds,
                F.when(card, d.rlike(CARD_PREFIX)).otherwise(F.right(d, F.lit(10)).rlike(AREA_CODE)),
                F.when(card, F.length(d).isin(15, 16)).otherwise(m.rlike(r"\(|-")),
                F.when(card, holds).otherwise(~d.rlike(r"^([0-9])\1+$")),
                F.when(card, s["before"].rlike(CUES["card"])).otherwise(s["before"].rlike(CUES["phone"])),
                F.when(card, F.length(d).isin(15, 16)).otherwise(F.length(d).isin(10, 11)),
            )

        return bound(digits(m), of)

    return F.concat(*[F.transform(F.get(wide, F.lit(i)), of) for i, of in enumerate((email, ip, number))])


Pattern = tuple[int, ...]


def candidate_counts(docs: DataFrame, text_col: str = "text") -> dict[str, dict[tuple[Pattern, Pattern], int]]:
    """How often each (votes, traits) occurs over all documents, by kind: at most 4 x 3^VOTES x 2^TRAITS numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.where(text.rlike(r"[0-9]{3}|@|[\[({]at[\])}]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"))
        .select(wide_pairs(text).alias("_pairs"))
        .select(located("_pairs", around=True).alias("_w"))
        .select(F.explode(candidates(F.col("_w"))).alias("c"))
        .groupBy("c.kind", "c.votes", "c.traits")
        .count()
        .collect()
    )
    found: dict[str, dict[tuple[Pattern, Pattern], int]] = {k: {} for k in KINDS}
    for r in rows:
        found[r["kind"]][tuple(r["votes"]), tuple(r["traits"])] = r["count"]
    return found


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation maximisation over labelers independent given the truth.

    Each labeler starts, and is smoothed, as better than chance, which fixes what the two classes mean.
    """
    belief = {1: {1: 0.6, 0: 0.25, -1: 0.15}, 0: {1: 0.15, 0: 0.25, -1: 0.6}}
    theta = [{y: dict(belief[y]) for y in (0, 1)} for _ in range(VOTES)]
    prior, posterior = 0.5, {}
    strength = 10.0
    for _ in range(rounds):
        for votes in patterns:
            log = {y: math.log(prior if y else 1 - prior) + sum(math.log(theta[j][y][v]) for j, v in enumerate(votes)) for y in (0, 1)}
            posterior[votes] = 1 / (1 + math.exp(min(700.0, log[0] - log[1])))
        weight = {1: sum(n * posterior[v] for v, n in patterns.items()), 0: sum(n * (1 - posterior[v]) for v, n in patterns.items())}
        prior = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        for j in range(VOTES):
            for y in (0, 1):
                for value in (-1, 0, 1):
                    seen = sum(n * (posterior[v] if y else 1 - posterior[v]) for v, n in patterns.items() if v[j] == value)
                    theta[j][y][value] = (seen + strength * belief[y][value]) / (weight[y] + strength)
    return posterior


def span_classifier(patterns: dict[Pattern, int], posterior: dict[Pattern, float], steps: int = 400) -> list[float]:
    """Bias and one weight for each place of the patterns: logistic regression on the posteriors, shrunk towards equal trust."""
    places = len(next(iter(patterns), (0,) * len(TRAITS)))
    start = [-1.0] + [1.0] * places
    w = list(start)
    total = sum(patterns.values()) or 1
    for _ in range(steps):
        grad = [0.02 * (x - x0) for x, x0 in zip(w, start)]
        for seen, n in patterns.items():
            z = w[0] + sum(a * v for a, v in zip(w[1:], seen))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - posterior[seen]) * n / total
            grad = [g + error * x for g, x in zip(grad, (1, *seen))]
        w = [a - 0.5 * g for a, g in zip(w, grad)]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    """Weights of the span classifier by kind."""
    out = {}
    for kind, counts in candidate_counts(docs, text_col).items():
        by_votes: dict[Pattern, int] = defaultdict(int)
        by_traits: dict[Pattern, int] = defaultdict(int)
        expected: dict[Pattern, float] = defaultdict(float)
        for (votes, _), n in counts.items():
            by_votes[votes] += n
        posterior = reliabilities(by_votes)
        for (votes, traits), n in counts.items():
            by_traits[traits] += n
            expected[traits] += n * posterior[votes]
        out[kind] = span_classifier(by_traits, {t: expected[t] / n for t, n in by_traits.items()})
    return out


def spans(docs: DataFrame, weights: dict[str, list[float]], text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs with base and added, array<struct<start, rank, end, kind>> in order; rank is the kind's place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.drop("base", "added")

    def as_span(kind: Column, rank: Column, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), kind.alias("kind"))

    def tagged(kind: str) -> Column:
        good = F.filter(F.get("_base", F.lit(KINDS.index(kind))), lambda s: passes(kind, s))
        return F.transform(good, lambda s: as_span(F.lit(kind), F.lit(KINDS.index(kind)), s))

    base = F.array_sort(F.concat(*[tagged(k) for k in KINDS]))

    def accepted(c: Column) -> Column:
        score = F.lit(0.0)
        for kind, w in weights.items():
            z = F.lit(float(w[0]))
            for j, weight in enumerate(w[1:]):
                z = z + F.lit(float(weight)) * F.get(c["traits"], F.lit(j))
            score = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(score)
        return score >= accept

    ranked = lambda c: as_span(c["kind"], (F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]) - 1).cast("int"), c)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    return (
        plain.withColumns({"_base": base_pairs(text), "_wide": wide_pairs(text)})
        .withColumns({"_base": located("_base"), "_wide": located("_wide", around=True)})
        .withColumns({"base": base, "_wide": F.transform(F.filter(candidates(F.col("_wide")), accepted), ranked)})
        .withColumn("added", F.when(F.size("_wide") > 0, apart("base", "_wide")).otherwise(none))
        .drop("_base", "_wide")
    )


def apart(base: str, wide: str) -> Column:
    """The spans of column wide that overlap none of column base, nor an earlier span that overlaps none of base."""
    far = (1 << 31) - 1
    mixed = lambda spans, new: f"transform({spans}, s -> named_struct('start', s.start, 'new', {new}, 'rank', s.rank, 'end', s.end, 'kind', s.kind))"
    # the furthest end of the base spans up to each place, and the next start of one from there on
    reached = let("v", "transform(every, x -> if(x.new, -1, x.end))", running("v", "greatest({s}, {x})", "-1"))
    following = let("v", f"reverse(transform(every, x -> if(x.new, {far}, x.start)))", f"reverse({running('v', 'least({s}, {x})', str(far))})")
    clear = let("r", reached, let("f", following, "filter(every, (x, i) -> x.new and get(r, i) <= x.start and get(f, i) >= x.end)"))
    free = let("every", f"array_sort(concat({mixed(base, 'false')}, {mixed(wide, 'true')}))", clear)
    before = let("v", "transform(free, x -> x.end)", running("v", "greatest({s}, {x})", "-1"))
    first = let("free", free, let("r", before, "filter(free, (x, i) -> coalesce(get(r, i - 1), -1) <= x.start)"))
    return F.expr(f"transform({first}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind))")


def written(array: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, weights: dict[str, list[float]], text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets."""
    found = spans(docs, weights, text_col).withColumn("_all", F.array_sort(F.concat("base", "added")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(F.col(text_col), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        replaced = F.struct(s["end"].alias("at"), F.concat(state["out"], before, F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        return F.when(s["start"] >= state["at"], replaced).otherwise(state)

    rest = lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.length(text_col)))
    return found.withColumn(text_col, F.when(F.size("_all") > 0, F.aggregate("_all", start, step, rest)).otherwise(F.col(text_col))).select(*docs.columns)
