"""The n-gram join and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagelark.llm import exact_dedup, ngram_join, packing, quality_mil
from pagelark.llm.components import connected
from pagelark.sources.scratch import Workspace

A_Z = {c: c + 32 for c in range(65, 91)}
WHITE = " \t\n\r\x0b\x0c"


def grams(text, n):
    words = "".join(" " if c in WHITE else c for c in (text or "").translate(A_Z)).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    """{row place: (size, component, links)} by comparing all pairs that share an n-gram."""
    sets, at, root = [grams(t, n) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, s in enumerate(sets):
        if rows[a][0] is None:
            continue
        for b, both in Counter(b for g in s for b in at[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
        for g in s:
            at[g].append(a)
    smallest = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(a)] = min(i, smallest.get(find(a), i))
    return sorted(((i, len(sets[a]), smallest[find(a)] if i is not None else None, links[a]) for a, (i, _) in enumerate(rows)), key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, common = [], words(40)
    for size in (5, 8, 9, 12, 20, 45, 120, 400):
        for _ in range(6):
            base = words(size)
            texts += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 1, 2, max(1, size // 60), max(1, size // 40), size // 20 + 1)]
            texts.append(" ".join(base[: -max(1, size // 12)]))
    # a passage that many share, and a large group of near copies
    texts += [" ".join(common + words(rng.randrange(10, 60))) for _ in range(150)]
    hot = words(150)
    texts += [" ".join(edited(rng, hot, rng.randrange(0, 6))) for _ in range(400)]
    texts += ["", "  \n", None, "One", "one", "a b", "A B", "a b c d", "x y z", "Ä b c d e", "ä b c d e", "q " * 3000]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b c d"), (None, None)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_sizes_and_links(spark, rows, n, percent):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_links string").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.components(docs, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_blocks_of_a_large_cluster(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    rng = random.Random(8)
    plain = " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    others = ["https://" + "a/b" * 40, "漢字" * 30, "x" * 64, "y" * 65, "y" * 64 + "z", "q" * 300, None, ""]
    alone = [next(ngram_join.ngram_sets([t], 4)) for t in [plain, *others]]
    for size in (1, 100, 500, 1 << 20):
        monkeypatch.setattr(ngram_join, "CHUNK_BYTES", size)
        for together in (ngram_join.ngram_sets([plain, *others], 4), [*ngram_join.ngram_sets([*others[::-1], plain], 4)][::-1]):
            assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert len({t.tobytes() for t in alone}) == len(alone) - 1  # null and empty are alike


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_copies_in_blocks_with_and_without_long_words(spark, monkeypatch, partitions):
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(12)]
    long_word = "http://example.org/" + "path/" * 20
    texts = [" ".join(b) for b in bases] + [f"{long_word} {i}" for i in range(3)] + [" ".join(edited(rng, b, k % 3)) for k, b in enumerate(bases)]
    rows = list(enumerate(texts)) + [(100 + i, f"{' '.join(b)} {long_word}") for i, b in enumerate(bases)]
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions, "doc_id")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(11)
    a, b, c, d, e = ([f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(5))
    near = lambda words: " ".join(edited(rng, words, 1))
    plain = " ".join
    # ids 1 and 7 with two texts each; the near copies of the latter bear smaller ids; 8 and its own near copy share an id
    rows = [(1, plain(a)), (1, plain(b)), (2, near(a)), (3, near(b)), (7, plain(c)), (7, plain(d)), (7, plain(d).upper()), (5, near(c)), (6, near(d)), (8, plain(e)), (8, near(e)), (9, "x y z"), (9, "")]
    sizes = [(i, len(grams(t, 4))) for i, t in rows]
    links = [1, 1, 1, 1, 1, 2, 2, 1, 2, 1, 1, 0, 0]
    component = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    want = sorted((i, n, component[i], k) for (i, n), k in zip(sizes, links, strict=True))
    for partitions in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        assert sorted(tuple(r) for r in ngram_join.components(docs, 4, 85).collect()) == want


def test_every_linked_pair_meets_in_a_bucket():
    rng = np.random.default_rng(2)
    for percent in (80, 85, 93):
        bands, cells = ngram_join.Bands(percent), rng.integers(1, 9, ngram_join.CELLS)
        for _ in range(250):
            size = int(rng.integers(6, 260))
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            removed, added = rng.integers(0, size // 6 + 2, 2)
            b = np.concatenate([rng.permutation(a)[removed:], rng.integers(0, 2**64, int(added), dtype=np.uint64)])
            both = size - removed
            if both < 1 or 100 * both < percent * (size + len(b) - both) or removed + added == 0:
                continue
            sides = [[dict(zip(k.tolist(), q.tolist())) for k, q in ngram_join.signatures(np.sort(s), bands, cells)] for s in (a, b)]
            keys = [{k: v for d in side for k, v in d.items()} for side in sides]
            assert any(keys[0][k] or keys[1][k] for k in keys[0].keys() & keys[1].keys()), (percent, size, removed, added)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components(empty).count() == 0 and ngram_join.representatives(empty).count() == 0


def test_representatives_keep_columns_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(4, text, "a"), (2, text + " more", "b"), (9, "else", "c"), (None, text, "d")], "doc_id long, text string, component_id string")
    got = ngram_join.representatives(docs)
    assert got.columns == docs.columns and {r["component_id"] for r in got.collect()} == {"b", "c", "d"}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 130)] + [(205, 201), (201, 203), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 100 for j in range(100, 130)) and got[205] == got[203] == 201


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    scratch, docs, kept = Workspace(spark), spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns, name
    before, after = kept["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stayed = {r["doc_id"] for r in after.collect()}
    assert sum((i in stayed) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    before, after = kept["exact_dedup"]
    texts = {(r["text"] or "").translate(A_Z) for r in before.collect()}
    assert sorted(texts) == sorted((r["text"] or "").translate(A_Z) for r in after.collect())
    before, after = kept["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {c for _, _, c, _ in brute(rows, 5, 80)}
    before, after = kept["mixing"]
    copies, known = Counter(r["doc_id"] for r in after.collect()), {r["doc_id"] for r in before.collect()}
    assert set(copies) <= known and max(copies.values()) <= 3
    before, after = kept["packing"]
    tokens = sum(len(packing.token_ids(r["text"], packing.default_vocabulary())) for r in before.collect())
    assert sum(r["length"] for r in after.collect()) == tokens
    assert exact_dedup and quality_mil


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)
