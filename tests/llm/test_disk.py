"""What the n-gram join and the pipeline's near-dedup stage shuffle, and the steps that keep it small."""

import os

import numpy as np
import pytest

import corpus_pipeline
from pagelark.llm import ngram_join


def shuffled(spark, run):
    """Bytes that Spark's tasks write to shuffles while run() works."""
    sc = spark.sparkContext._jsc.sc()
    empty, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(empty, False, False, quantiles, empty)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_near_dedup_shuffles_less_than_twice_its_input(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    docs = spark.read.parquet(path)
    written = shuffled(spark, lambda: corpus_pipeline.near_copies(spark, docs, None).write.format("noop").mode("overwrite").save())
    assert 0 < written < 2 * os.path.getsize(path)


def test_linked_pairs_meet_where_both_give_units():
    rng = np.random.default_rng(4)
    met = 0
    for percent in (80, 85, 93):
        bands, cells = ngram_join.Bands(percent), rng.integers(1, 9, ngram_join.CELLS)
        for _ in range(1500):
            size = int(rng.integers(4, 200))
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            most = bands.difference(2 * size)
            removed = int(rng.integers(0, most + 1))
            added = int(rng.integers(0, most - removed + 1))
            b = np.concatenate([rng.permutation(a)[removed:], rng.integers(0, 2**64, added, dtype=np.uint64)])
            both = size - removed
            if removed + added == 0 or both < 1 or 100 * both < percent * (size + len(b) - both):
                continue
            sides = [{int(x) for k, gives in ngram_join.signatures(np.sort(s), bands, cells) for x in k[gives]} for s in (a, b)]
            assert sides[0] & sides[1], (percent, size, removed, added)
            met += 1
    assert met > 1500


def test_a_crowded_bucket_is_split_and_stays_connected():
    rng = np.random.default_rng(6)
    keys = np.concatenate([np.full(5000, 7), rng.integers(100, 2000, 3000), np.full(3, 9)]).astype(np.uint64)
    ids = rng.permutation(len(keys)).astype(np.int64)
    new, owners = ngram_join.uncrowded(keys, ids)
    assert (new == 7).sum() == 1 and (new == 9).sum() == 3

    def groups(keys, ids):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for k, i in zip(keys.tolist(), ids.tolist()):
            root[find(("key", k))] = find(i)
        out = {}
        for i in set(ids.tolist()):
            out.setdefault(find(i), set()).add(i)
        return sorted(map(sorted, out.values()))

    assert groups(new, owners) == groups(keys, ids)
    assert [len(x) for x in ngram_join.uncrowded(keys[:0], ids[:0])] == [0, 0]


@pytest.mark.parametrize("many", [5, 40])
def test_pairs_across_blocks(many):
    rng = np.random.default_rng(many)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[k % 9 :], rng.integers(0, 2**64, k % 4, dtype=np.uint64)])) for k in range(many)]
    for first in (1, many // 2, many):
        whole = {(i, j) for i, j in zip(*(x.tolist() for x in ngram_join.linked_pairs(sets, 80))) if i < first <= j}
        assert whole == set(zip(*(x.tolist() for x in ngram_join.linked_pairs(sets, 80, first))))
        assert whole or first == many
