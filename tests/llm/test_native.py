"""Exact dedup, sharding, mixing and personal data against brute force, on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagelark.llm import exact_dedup, mixing, pii, sharding

DOCS = "doc_id long, text string, source string, kept boolean, size long"
A_Z = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with two columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, True, -1) for r in rows], DOCS)


AWKWARD = [
    (1, "Hello World", "a"), (2, "hello world", "a"), (3, "hello World!", "b"), (4, None, "b"), (5, "", None), (6, "ÄÖ É", "a"), (7, "äÖ É", "a"),
    (8, "ÄÖ é", None), (9, "hello world", "c"), (9, "hello world", "c"), (None, "hello world", "a"), (None, "alone", "a"), (10, "x " * 40000, "a"),
]


def lowered(text):
    return (text or "").translate(A_Z)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_equals_brute_force(spark, keep):
    groups = defaultdict(list)
    for i, t, _ in AWKWARD:
        groups[lowered(t)].append(i)
    pick = min if keep == "smallest" else max
    want = Counter()
    for i, t, _ in AWKWARD:
        ids = [x for x in groups[lowered(t)] if x is not None]
        best = pick(ids) if ids else None
        want[i, best, len(groups[lowered(t)]), i == best, hashlib.sha256(lowered(t).encode()).hexdigest()] += 1
    got = exact_dedup.annotate(docs_of(spark, AWKWARD), keep=keep)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()) == want
    assert "source" in got.columns


def test_hash_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.annotate(docs_of(spark, [(1, "a", "s"), (2, "b", "s"), (3, "A", "s")])).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_distinct_documents_keep_their_columns(spark):
    kept = exact_dedup.distinct_documents(docs_of(spark, [(1, "a", "s"), (2, "A", "s"), (3, "b", "s")]))
    assert kept.columns == ["doc_id", "text", "source", "kept", "size"] and {r["doc_id"] for r in kept.collect()} == {1, 3}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_distinct_documents_keep_one_row_of_each_text(spark, keep):
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "A", "t"), (2, "a", "s"), (2, "a", "s"), (None, "n", "s"), (None, "n", "s"), (None, "N", "t"), (3, "c", "s"), (3, "d", "s"), (None, "", "s"), (None, None, "s")]
    kept = [(r["doc_id"], lowered(r["text"])) for r in exact_dedup.distinct_documents(docs_of(spark, rows).repartition(3), keep=keep).collect()]
    assert Counter(kept) == Counter([(1 if keep == "smallest" else 2, "a"), (None, "n"), (3, "c"), (3, "d"), (None, "")])


def test_jump_hash_moves_only_into_the_new_shard(spark):
    keys = spark.range(3000).select("id", *[sharding.jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 7, 40, 41)])
    rows = keys.collect()
    assert all(r["s1"] == 0 and 0 <= r["s40"] < 40 for r in rows)
    moved = [r for r in rows if r["s41"] != r["s40"]]
    assert all(r["s41"] == 40 for r in moved) and 30 < len(moved) < 130
    assert max(Counter(r["s7"] for r in rows).values()) < 3000 / 7 * 1.25


def test_shards_sizes_and_slots(spark):
    rows = AWKWARD + [(i, f"text {i}", "z") for i in range(100, 400)]
    got = sharding.assign(docs_of(spark, rows), shards=5, slices=4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        assert r["grown_shard"] in (r["shard"], 5)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def water_level(sizes, weights, cap):
    """Targets by sharing again and again what is above the caps."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not over:
            return [cap * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= over


def test_targets_equal_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, "d": 40, None: 700}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = water_level(list(sizes.values()), [1, 2, 3, 1, 2], 3)
    assert [got[s] for s in sizes] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_is_systematic_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7919 % 200), f"s{i % 3}") for i in range(900)] + AWKWARD
    run = lambda n: sorted(map(str, mixing.systematic_copies(docs_of(spark, rows).repartition(n), slices=8).select("doc_id", "size", "source", "source_size", "target", "taken").collect()))
    assert run(1) == run(5)
    got = mixing.systematic_copies(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for s in ("s0", "s1", "s2"):
        assert sum(r["taken"] for r in by[s]) == pytest.approx(by[s][0]["target"], rel=0.05)
        copies = {r["copies"] for r in by[s]}
        assert max(copies) - min(copies) <= 1
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "kept", "size"] and mixed.count() == sum(r["copies"] for r in got)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for rank, pattern, ok in ((2, CARD, lambda d: 14 <= len(d) <= 19 and luhn(d)), (3, PHONE, lambda d: 10 <= len(d) <= 15)):
        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if ok(re.sub("[^0-9]", "", m[0]))]
    return sorted(found)


PRIVATE = [
    "mail a.b@c.de, x@y and a@b.cd%x@y.z.w or @a.b", "😀 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111",
    "call +1 (415) 555-6503 or +49 30 1234567 or +12", "4465758382889437 4465758382889437", "9" * 5000, "a" * 5000 + "@" + "b" * 5000, "a@" + "b." * 3000 + "c", "", None,
    "reach me: jane [at] corp [dot] com", "+1 2 3 4 5 6 7 8 9 0)", "order 1234567890123456", "Call (415) 555-6503 now",
]


@pytest.fixture(scope="module")
def private(spark):
    rows = [(i, t, "s") for i, t in enumerate(PRIVATE)] + [(1, PRIVATE[0], "s"), (None, "a@b.cd", None)]
    docs = docs_of(spark, rows)
    weights = pii.fit(docs)
    return docs, weights, pii.spans(docs, weights).collect()


def test_base_spans_equal_brute_force(private):
    for r in private[2]:
        assert [(s["start"], s["rank"], s["end"]) for s in r["base"]] == base_spans(r["text"] or ""), r["text"]


def test_added_spans_are_apart_from_base(private):
    by = {r["text"]: r for r in private[2]}
    assert [(s["kind"], s["start"]) for s in by["4465758382889437 4465758382889437"]["added"]] == [("card", 0), ("card", 17)]
    assert by["order 1234567890123456"]["added"] == []
    for r in private[2]:
        spans = sorted([(s["start"], s["end"]) for s in r["added"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(s["end"] <= b["start"] or b["end"] <= s["start"] for s in r["added"] for b in r["base"])


def test_redaction_replaces_spans_only(spark, private):
    docs, weights, _ = private
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs, weights).collect()}
    assert text[0].startswith("mail <email>, x@y and <email><email>") and text[8] == "" and text[9] is None
    assert text[4] == "<card> <card>"


def test_reliabilities_follow_the_majority():
    patterns = {(1, 1, 1, 1, 1): 50, (-1, -1, 0, -1, -1): 50, (1, 1, 0, 1, -1): 5}
    posterior = pii.reliabilities(patterns)
    assert posterior[1, 1, 1, 1, 1] > 0.95 and posterior[-1, -1, 0, -1, -1] < 0.05
    w = pii.span_classifier(patterns, posterior)
    assert sum(w) > 0 and w[0] - sum(w[1:]) < 0


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.annotate(d), lambda d: sharding.assign(d), lambda d: mixing.systematic_copies(d), lambda d: mixing.mix(d), lambda d: pii.spans(d, pii.fit(d)),
])
def test_empty_tables(spark, run):
    assert run(docs_of(spark, [])).count() == 0
