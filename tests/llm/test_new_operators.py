"""Prefix trie, spelling variants and near duplicates against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelark.llm import minhash_forest, prefix_trie, queries, spelling
from pagelark.llm.scans import scan
from pagelark.sources.scratch import Workspace

from .test_near_copies import brute, edited

TURNS = "conv_id long, turn long, role string, text string, depth string, n_convs string"


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_scan_restarts_with_each_group(spark, partitions):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(-9, 99), rng.randrange(1 << 62)) for g, n in ((1, 1), (2, 300), (3, 2), (4, 40), (7, 0), (8, 90)) for i in range(n)]
    shuffled = rng.sample(rows, len(rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(shuffled, "g long, i long, x long, y long")
        by_group = {(r["g"], r["i"]): (r["run_x"], r["run_y"]) for r in scan(df, ["g", "i"], Workspace(spark), "g", ("x",), ("y",))[0].collect()}
        over_all = {(r["g"], r["i"]): r["run_x"] for r in scan(df, ["g", "i"], Workspace(spark), adds=("x",))[0].collect()}
        assert scan(df.limit(0), ["g", "i"], Workspace(spark), "g", ("x",))[0].collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total, xors, whole = Counter(), Counter(), 0
    for g, i, x, y in rows:
        total[g] += x
        xors[g] ^= y
        whole += x
        assert by_group[g, i] == (total[g], xors[g])
        assert over_all[g, i] == whole


def plain_trie(convs):
    """{(conv_id, depth): the node's other columns} from {conversation: [(role, text)]}."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)

    def below(node):
        found = [node]
        for x in found:
            found += children[x]
        return found

    out = {}
    for node in list(members):
        under = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        leaves = sum(not children[x] for x in under)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        up = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (up, len(members[node]), len(children[node]), leaves, saved, digest)
    return out


def ordered(rows):
    """{conversation: [(role, text)]} in the order of turns, null first."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in by.items()}


def regrafted(convs):
    out = {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    rows = []
    for c in [*range(-12, 60), 1 << 40, (1 << 63) - 1, -(1 << 63)]:
        for t in range(rng.choice((0, 1, 2, 3, 9, 12))):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "ä", "", None, "a" * 70))))
    rows += [(70, t, "user", "same") for t in range(300)] + [(c, t, "user", "same") for c in range(100, 140) for t in range(c % 4)]
    # equal turn numbers and repeated rows
    rows += [(80, 1, "b", "x"), (80, 1, "a", "y"), (80, 1, "a", "x"), (80, 1, "a", "x"), (None, 1, "a", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("graft", [True, False])
def test_trie_equals_plain_one(spark, turns, graft):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in turns], TURNS).repartition(5)
    got = (prefix_trie.regrafted_trie if graft else prefix_trie.prefix_trie)(df).collect()
    convs = ordered(turns)
    want = plain_trie(regrafted(convs) if graft else convs)
    columns = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {(r["conv_id"], r["depth"]): tuple(r[c] for c in columns) for r in got} == want
    assert len(got) == len(want)
    # subtrees are intervals in preorder: nested or apart, each as long as its nodes
    spans = sorted((r["first"], -r["last"]) for r in got)
    open_ = []
    for first, last in spans:
        while open_ and open_[-1] <= first:
            open_.pop()
        assert not open_ or -last <= open_[-1]
        open_.append(-last)
    assert sorted(r["first"] for r in got) == list(range(len(got)))


def test_trie_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, 1, "user", "hi") for c in range(95, 125)] + [(500, 1, "user", "hi"), (500, 2, "user", "on")]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(spark.createDataFrame([(*r, "", "") for r in rows], TURNS)).collect()}
    assert got[95, 1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(95, 125))).encode()).hexdigest()
    assert got[95, 0]["n_convs"] == 31 and got[95, 1]["n_leaves"] == 1


def test_trie_of_nothing(spark):
    assert prefix_trie.regrafted_trie(spark.createDataFrame([], TURNS)).collect() == []
    alone = prefix_trie.regrafted_trie(spark.createDataFrame([(1, None, None, None, "", "")], TURNS)).collect()
    assert [(r["conv_id"], r["depth"], r["parent_conv_id"]) for r in alone if r["depth"] == 0] == [(1, 0, None)]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, ratio):
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= ratio * n[w] else None, len(others)]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: (form, root, n[w], count, n[form] if form else None) for w, (form, count, root) in out.items()}


@pytest.mark.parametrize("group", [1 << 18, 16])
def test_variants_equal_all_pairs(spark, group):
    rng = random.Random(6)
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(2, 8))) for _ in range(150)} | {"aaaaaaa", "aaaaaaaa", "ßéç", "ßéçé", "ßaç", "漢字", "漢", "字"}
    n = {w: rng.choice((1, 2, 5, 20, 50, 300, 4000)) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), ratio=10, group=group).collect()
    assert {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in got} == plain_variants(n, 10)
    assert len(got) == len(n)


def test_words_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    docs = [(1, "Straßen straßen STRAßEN École-étrange"), (2, None), (3, ""), (None, "straßen ÀÀÀÀÀÀÀ"), (4, "x" * 500_000 + " straßen!"), (4, "x" * 500_000 + " straßen!"), (5, "kürzest kürzes1t")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string").repartition(3)
    plain = {"straßen": 6, "x" * 500_000: 2}
    assert {r["word"]: r["n"] for r in spelling.words_of(df).collect()} == plain
    want = Counter()
    for i, text in docs:
        for run in "".join(c if c.isalpha() and ord(c) < 256 else " " for c in text or "").translate({c: c + 32 for c in range(65, 91)}).split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 2 == 0 else run] += 1
    got = {r["word"]: r["n"] for r in spelling.words_of(df, shortest=4, least=1, damage=2).collect()}
    assert got == {w: c for w, c in want.items() if len(w) >= 4}
    assert spelling.variants(spelling.words_of(df.limit(0))).collect() == []


def test_deletion_keys_are_those_of_the_strings():
    words = ["a", "ab", "aab", "aba", "ba", "aa", "abcdefghij", "abcdefghi", "漢字", "漢"]
    keys, row, place = spelling.deletion_keys(words)
    by = defaultdict(set)
    for k, r, p in zip(keys.tolist(), row.tolist(), place.tolist()):
        by[words[r] if p < 0 else words[r][:p] + words[r][p + 1 :]].add(k)
    assert all(len(ks) == 1 for ks in by.values()) and len({min(ks) for ks in by.values()}) == len(by)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(15)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, common = [], words(60)
    for size in (5, 8, 9, 12, 20, 45, 120, 400):
        for _ in range(6):
            base = words(size)
            texts += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 2, max(1, size // 60), size // 20 + 1)]
            texts.append(" ".join(base[: -max(1, size // 9)]))
    texts += [" ".join(common + words(rng.randrange(10, 90))) for _ in range(150)]
    hot = words(150)
    texts += [" ".join(edited(rng, hot, rng.randrange(0, 6))) for _ in range(300)] + [" ".join(hot)] * 200
    texts += ["", "  \n", None, "One", "one", "a b", "A B", "a b c d", "x y z", "Ä b c d e", "ä b c d e", "q " * 300_000, "q " * 300_001]
    rng.shuffle(texts)
    a, b, c = words(80), words(80), words(80)
    return [*enumerate(texts), (3, texts[3]), (None, "a b c d"), (None, None), (5000, " ".join(a)), (5000, " ".join(b)), (5001, " ".join(edited(rng, a, 1))), (4999, " ".join(edited(rng, b, 1))), (5002, " ".join(c)), (5002, "")]


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 80)])
def test_forest_finds_the_components(spark, documents, n, percent):
    docs = spark.createDataFrame([(*d, "x", "y") for d in documents], "doc_id long, text string, kept string, node string").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_forest.components(docs, n, percent).collect()), key=str)
    want = {}
    for i, size, component, _ in brute([d for d in documents if d[0] != 5000 and d != (5002, "")], n, percent):
        want.setdefault((i, size, component), 0)
    # an id with two texts joins what each of them is near to
    joined = {(i, c) for i, _, c in got if i in (4999, 5000, 5001)}
    assert joined == {(4999, 4999), (5000, 4999), (5001, 4999)}
    assert {r for r in got if r[0] not in (4999, 5000, 5001) and r != (5002, 0, 5002)} == {r for r in want if r[0] not in (4999, 5001)}
    assert len(got) == len(documents)


@pytest.mark.parametrize("exactly", [True, False])
def test_dense_regions_are_joined_exactly(spark, documents, monkeypatch, exactly):
    """300 near copies whose links lie about the threshold: the trees alone would miss some."""
    calls = []
    join = minhash_forest.joined_exactly
    monkeypatch.setattr(minhash_forest, "joined_exactly", lambda *a: calls.append(a) or join(*a))
    docs = spark.createDataFrame([d for d in documents if d[0] is not None and d[0] < 4000 and (exactly or d[0] < 30)], "doc_id long, text string")
    minhash_forest.components(docs, 4, 80)
    assert len(calls) == exactly


@pytest.mark.parametrize("partitions", ["1", "50"])
def test_forest_across_partitions(spark, documents, monkeypatch, partitions):
    """Partitions of a few rows, and passes over a few rows, lose no neighbour."""
    monkeypatch.setattr(minhash_forest, "PASS", 40)
    some = [d for d in documents if d[0] is not None and d[0] < 150]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame(some, "doc_id long, text string")
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_forest.components(docs, 4, 80).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(((i, n, c) for i, n, c, _ in brute(some, 4, 80)), key=str)


def test_forest_with_text_ids_and_representatives(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(base)), ("a", " ".join([*base, "more"])), ("c", "something else altogether here"), (None, " ".join(base)), ("d", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "name string, body string, kept int")
    got = {r["name"]: (r["component_id"], r["kept"]) for r in minhash_forest.components(docs, 4, 80, "name", "body").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True), "d": ("d", True)}
    stay = minhash_forest.representatives(docs, 4, 80, "name", "body")
    assert stay.columns == docs.columns and sorted(str(r["name"]) for r in stay.collect()) == ["None", "a", "c", "d"]
    assert minhash_forest.components(docs.limit(0), 4, 80, "name", "body").collect() == []


def test_signature_agrees_as_the_sets_do():
    rng = np.random.default_rng(1)
    universe = minhash_forest.finalised(rng.integers(1, 1 << 62, 1200).astype(np.uint64))
    a, b = universe[:1000], universe[200:]
    x, y = (np.frombuffer(minhash_forest.signature(s), ">u4") for s in (a, b))
    assert len(x) == minhash_forest.TREES * minhash_forest.STEP
    assert abs((x == y).mean() - 800 / 1200) < 0.15


def test_registered_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op13_minhash_forest(spark, sf).collect()), key=str)
    assert got == sorted(((i, n, c) for i, n, c, _ in brute(rows, 4, 80)), key=str)
