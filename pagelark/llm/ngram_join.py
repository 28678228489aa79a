"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document's set holds the hashes of its word n-grams. Two sets of sizes k and l link when 100 * intersection >= t *
union, which bounds their symmetric difference by D = (100 - t)(k + l) / (100 + t).

Filter. Sizes fall into bands. For the pairs whose smaller set lies in a band, every n-gram is hashed to one of m
segments, m a little above the largest D of the band. A set gives each segment a number of units v from 0 to 2 with a
sum above its D: if two linked sets differed by v or more in every segment, they would differ by more than D in all. So
in some segment they are equal (v = 1) or one n-gram apart (v = 2). A set has a signature for each of its segments, and in
the few reserve segments also those of its one-deletion neighbours, where v = 2 may be given.
The units go to the cheapest signatures: a signature costs about as many entries as its rarest n-gram, by counts over
all documents in CELLS cells, and an empty segment costs most. Segments of widespread passages are thereby left out.

Listing. A set is listed only where it gives units. Of two linked sets take the one whose dearest unit is the cheaper, by
(cost, place). Where it meets the other the two have a signature in common, and what this costs the other set is no more
than what the first one gave: an equal segment costs both the same; the rarest n-gram of a set without one of its n-grams
is at most the second rarest of the whole; and one n-gram more only makes the second rarest rarer. So the other set gives
units there as well, and both are listed under it. The entries are shuffled once, to find the smallest id of each bucket;
signatures are cut to 48 bits for that, since what shares one is verified anyway.
Where CROWD or more sets of a portion of a few hundred share a signature, they have a bucket of their own and only the
smallest of them stands for them in the common one, so that a bucket has at most as many rows as there are portions.

Verification. Sets that share a bucket, through the smallest id in it, form candidate clusters. Within a cluster exact
intersections are computed in blocks of about BLOCK sets, or up to WIDER times as many while they have no more than
BLOCK_TOKENS n-grams, so a group never holds more than two blocks and pairs never become rows. A set of a large cluster is
shuffled once for each block that it meets; the larger the blocks, the fewer. Blocks of a large cluster are cut by set size
first, in steps of the largest ratio that linked sets can have, and a block meets those of its own and the next step only;
so a chain of sets of many sizes that a widespread passage holds together doesn't meet itself as a whole. Out come link
counts, and of each group a spanning forest of its links; their components are the result.

Copies are collapsed at first: equal sets are a class, represented by its smallest id, or, where some id has different
texts, by 64 bits of its digest, with one text of its smallest id. Hot groups: classes are
aggregated with map-side combine, buckets are crowded at most as told above; the join back to the documents has one row for
each key on the other side, so that adaptive execution can split a hot key's rows; a large cluster is dealt as pairs of
blocks. What is broadcast has a fixed size: CELLS counts and filters of FILTER_WORDS x 64 bits that tell which texts to read
again, and which documents may be dropped: `representatives` shuffles only those.

N-grams are 64-bit hashes (tabulation by character and place, finalised): two different n-grams are taken for one with
a chance of 2^-64 a pair. Links are exact up to that.

Cases: a text that is null, empty or has no words has an empty set and links with nothing; with fewer words than n the
whole sequence is one n-gram. Rows with a null id get their size, but no component and no links. Rows that repeat an id
with equal text count as copies; with different texts they join their components. Ids may be numbers or of another type with
an order, by which the smallest is found. Texts are read whole. Extra columns
pass through `annotate` untouched unless they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Workspace
from .components import connected

CELLS = 1 << 17
FILTER_WORDS = 1 << 16
BLOCK = 256
WIDER = 4
BLOCK_TOKENS = 1 << 19
#: Sets under one signature that have a bucket of their own, and entries among which they are looked for.
CROWD = 16
PORTION = 200_000
BAND = 1.6
SLACK = 1.15
RESERVE = 2

#: Bytes hashed at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 20

U = np.uint64
_STEPS = 64


def finalised(x: np.ndarray) -> np.ndarray:
    """Mix 64 bits so that each depends on all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = finalised((np.arange(_STEPS * 256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BY_PLACE = finalised(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def _hashed(data: bytes, sizes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; data joins the texts, each followed by one white-space byte."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_WHITE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    word_at = np.flatnonzero(starts)
    at = np.flatnonzero(inside)
    w = (np.cumsum(starts) - 1)[at]
    step = at - word_at[w] if len(word_at) else at
    mixed = _TABLE[(step % _STEPS) * 256 + raw[at]]
    late = np.flatnonzero(step >= _STEPS)
    if len(late):
        # later places of a very long word reuse the table, times a multiplier of their own; all others stay as they are,
        # so that a word's hash does not depend on what else is hashed in the block
        mixed[late] *= finalised(((step[late] // _STEPS).astype(np.uint64) + U(1)) * U(0xA0761D6478BD642F)) | U(1)
    edges = np.searchsorted(at, word_at)
    words = finalised(np.add.reduceat(mixed, edges)) if len(word_at) else mixed[:0]
    ends = np.cumsum(sizes)
    first = np.searchsorted(word_at, ends - sizes)
    last = np.searchsorted(word_at, ends)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        grams += words[i : len(words) - n + 1 + i] * _BY_PLACE[i % 64] if len(grams) else grams
    grams = finalised(grams)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            short = words[a:b] * _BY_PLACE[: b - a]
            yield finalised(np.array([short.sum(dtype=np.uint64) + U(b - a)]))
        else:
            yield words[:0]


def ngram_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, 64-bit."""
    if not 1 <= n <= 64:
        raise ValueError("n must be from 1 to 64")
    block, total = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass") + b" "
        if block and total + len(data) > CHUNK_BYTES:
            yield from _hashed(b"".join(block), np.array([len(x) for x in block]), n)
            block, total = [], 0
        block.append(data)
        total += len(data)
    if block:
        yield from _hashed(b"".join(block), np.array([len(x) for x in block]), n)


def class_name(n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """64-bit name of the class of equal sets, from its size and digest."""
    return finalised(one + finalised(two + n)).view(np.int64)


class Bands:
    """Size bands and the numbers that follow from the threshold in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 99:
            raise ValueError("threshold must be from 50 to 99 percent")
        self.percent = percent

    def difference(self, both: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to `both`."""
        return (100 - self.percent) * both // (100 + self.percent)

    def largest(self, size: int) -> int:
        return 100 * size // self.percent

    def smallest(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def upper(self, band: int) -> int:
        """Largest size in a band."""
        return int(4 * max(BAND, 101 / self.percent) ** (band + 1))

    def band(self, size: int) -> int:
        b = max(0, int(np.log(max(size, 4) / 4) / np.log(max(BAND, 101 / self.percent))) - 1)
        while self.upper(b) < size:
            b += 1
        return b

    def segments(self, band: int) -> int:
        top = self.upper(band)
        return int(SLACK * (self.difference(top + self.largest(top)) + 1)) + 1 + RESERVE

    @lru_cache(maxsize=1 << 16)  # noqa: B019  one instance for each task
    def roles(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, units needed) of each band in which a set of this size takes part."""
        own = self.band(size)
        if self.difference(size + self.largest(size)) == 0:
            return []  # links with equal sets only
        out = [(own, self.segments(own), self.difference(size + self.largest(size)) + 1)]
        if own and self.smallest(size) <= self.upper(own - 1):
            out.append((own - 1, self.segments(own - 1), self.difference(size + min(size, self.upper(own - 1))) + 1))
        return out


def signatures(tokens: np.ndarray, bands: Bands, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, whether the set gives units there) for each band of a set."""
    if not len(tokens):
        return
    rarity = cells[tokens >> U(64 - (CELLS.bit_length() - 1))]
    for band, m, need in bands.roles(len(tokens)):
        segment = ((tokens & U(0xFFFFFFFF)) % U(m)).astype(np.int64)
        low = np.bincount(segment, weights=(tokens & U(0xFFFFFFFF)).astype(np.float64), minlength=m)
        high = np.bincount(segment, weights=(tokens >> U(32)).astype(np.float64), minlength=m)
        total = low.astype(np.uint64) + (high.astype(np.uint64) << U(32))
        order = np.lexsort((rarity, segment))
        edge = np.searchsorted(segment[order], np.arange(m + 1))
        held = np.diff(edge)
        cost = np.full(m + RESERVE, np.iinfo(np.int64).max, np.int64)
        cost[:m][held > 0] = rarity[order][edge[:-1][held > 0]]
        name = np.arange(m, dtype=np.uint64) * U(0x9FB21C651E98DF25) + U((band + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
        keys, extra = [total + name], []
        for r in range(RESERVE):
            i = m - RESERVE + r
            if held[i] >= 2:
                mine = order[edge[i] : edge[i + 1]]
                # without its rarest n-gram the segment is as common as the next one
                cost[m + r] = max(cost[i], rarity[mine[1]])
                keys.append(total[i] - tokens[mine] + name[i])
                extra.append((r, len(mine)))
        chosen = np.zeros(m + RESERVE, bool)
        chosen[np.argsort(cost, kind="stable")[:need]] = True
        asks = [chosen[:m]] + [np.full(k, chosen[m + r]) for r, k in extra]
        yield finalised(np.concatenate(keys)), np.concatenate(asks)


def _described(n: int):
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Size and 128-bit digest of each set; at last the cell counts of the partition's sets."""
        counts = np.zeros(CELLS, np.int64)
        shift = U(64 - (CELLS.bit_length() - 1))
        for batch in batches:
            size, one, two = [], [], []
            for tokens in ngram_sets(batch["text"], n):
                counts += np.bincount((tokens >> shift).astype(np.int64), minlength=CELLS) if len(tokens) > 20000 else 0
                if 0 < len(tokens) <= 20000:
                    np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                size.append(len(tokens))
                one.append(tokens.sum(dtype=np.uint64))
                two.append(finalised(tokens * U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64))
            one, two = np.array(one, np.uint64), np.array(two, np.uint64)
            name = class_name(np.array(size, np.uint64), one, two)
            yield pd.DataFrame({"id": batch["id"], "known": batch["known"], "mark": batch["mark"], "n": size, "one": one.view(np.int64), "two": two.view(np.int64), "name": name, "cell": -1, "seen": 0})
        there = np.flatnonzero(counts)
        yield pd.DataFrame({"id": 0, "known": False, "mark": 0, "n": 0, "one": 0, "two": 0, "name": 0, "cell": there, "seen": counts[there]})

    return describe


def uncrowded(keys: np.ndarray, ids: np.ndarray, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """The entries, those of crowded keys under keys of their own, but for the smallest id, which also stays under the key."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(keys)))
    full = held >= crowd
    if not full.any():
        return keys, ids
    least = np.minimum.reduceat(ids, starts)
    own = finalised(keys[starts] ^ finalised(least.view(np.uint64)))
    return np.concatenate((np.where(np.repeat(full, held), np.repeat(own, held), keys), keys[starts[full]])), np.concatenate((ids, least[full]))


def _listed(n: int, percent: int, cells, by_class: bool):
    def entries(keys: list[np.ndarray], ids: list[np.ndarray]) -> pd.DataFrame:
        key, doc = uncrowded(np.concatenate(keys), np.concatenate(ids))
        return pd.DataFrame({"key": (key >> U(16)).view(np.int64), "id": doc})

    def list_signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, frequent, met = Bands(percent), cells.value, set()
        keys, ids, held = [], [], 0
        for batch in batches:
            for doc, tokens in zip(batch["id"].tolist(), ngram_sets(batch["text"], n)):
                digest = (len(tokens), int(tokens.sum(dtype=np.uint64)), int((tokens * tokens).sum(dtype=np.uint64)))
                if digest in met:  # a copy within the partition is found through its class
                    continue
                met.add(digest)
                if by_class:
                    two = finalised(tokens * U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
                    doc = class_name(*(np.array([x], np.uint64) for x in (len(tokens), tokens.sum(dtype=np.uint64), two)))[0]
                for k, gives in signatures(tokens, bands, frequent):
                    keys.append(k[gives])
                    ids.append(np.full(len(keys[-1]), doc, np.int64))
                    held += len(keys[-1])
                if held > PORTION:
                    yield entries(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield entries(keys, ids)

    return list_signatures


def linked_pairs(sets: list[np.ndarray], percent: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the linked pairs of a block; or only of those between the places before `first` and the others."""
    size = np.array([len(s) for s in sets])
    left, right = (len(sets), 0) if first is None else (first, first)
    if len(sets) <= 6:
        hits = [
            (i, j)
            for j in range(right, len(sets))
            for i in range(min(j, left))
            if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])
            and (both := len(np.intersect1d(sets[i], sets[j], assume_unique=True)))
            and 100 * both >= percent * (size[i] + size[j] - both)
        ]
        return np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    before = times - 1 if first is None else np.bincount(column[row < first], minlength=len(values))
    wanted = (before > 0) & (times > before)
    shared = wanted[column]
    row, column = row[shared], (np.cumsum(wanted) - 1)[column[shared]]
    both = np.zeros((left, len(sets) - right), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        present = np.zeros((len(sets), width), np.float32)
        present[row[lo:hi], column[lo:hi] - a] = 1
        both += present[:left] @ present[right:].T
    both = np.rint(both).astype(np.int64)
    link = (both > 0) & (100 * both >= percent * (size[:left, None] + size[None, right:] - both))
    i, j = np.nonzero(np.triu(link, 1) if first is None else link)
    return i, j + right


def _verified(percent: int):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        """Spanning forest (a, b, 0) and weighted link counts (a, a, links) of a group."""
        out_a, out_b, out_n = [], [], []
        for _, part in group.groupby("cluster", sort=True):
            part = part.sort_values(["block", "id"])
            ids, block, weight = part["id"].to_numpy(), part["block"].to_numpy(), part["weight"].to_numpy()
            # of a pair of blocks only what lies across is new; each block alone is a pair with itself
            first = None if part["i"].iloc[0] == part["j"].iloc[0] else int(np.searchsorted(block, block[0], "right"))
            i, j = linked_pairs([np.frombuffer(t, np.uint64) for t in part["tokens"]], percent, first)
            if not len(i):
                continue
            links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            there = np.flatnonzero(links)
            out_a.append(ids[there])
            out_b.append(ids[there])
            out_n.append(links[there].astype(np.int64))
            root = np.arange(len(ids))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(i.tolist(), j.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            top = np.array([find(x) for x in range(len(ids))])
            child = np.flatnonzero(top != np.arange(len(ids)))
            out_a.append(ids[top[child]])
            out_b.append(ids[child])
            out_n.append(np.zeros(len(child), np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(out_a), "b": join(out_b), "n": join(out_n)})

    return verify


def _with_tokens(n: int):
    def add_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [t.tobytes() for t in ngram_sets(batch["text"], n)]
            yield batch.drop(columns="text").assign(tokens=tokens)

    return add_tokens


def _place(value: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("filter")), F.lit(cells))


def _word(value: Column) -> Column:
    """The word of a filter in which a value has its bit."""
    return F.floor(_place(value, FILTER_WORDS * 64) / 64).cast("int")


def _filtered(df: DataFrame, value: Column, values: DataFrame, name: str) -> DataFrame:
    """df with _inside: true for every value that the other column holds, rarely for another; FILTER_WORDS words are broadcast."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col(name), 64).cast("int"))
    words = values.groupBy(_word(F.col(name)).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    joined = df.withColumn("_key", _word(value)).join(F.broadcast(words), F.col("_key") == F.col("_word"), "left")
    inside = F.call_function("getbit", F.col("_bits"), _place(value, 64).cast("int")) == 1
    return joined.withColumn("_inside", F.coalesce(inside, F.lit(False))).drop("_key", "_word", "_bits")


def components(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id, n_links."""
    spark = docs.sparkSession
    scratch = Workspace(spark)
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        return _by_number(docs, ngram, percent, id_col, text_col, scratch)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    described = scratch.keep(
        texts.mapInPandas(_described(ngram), "id long, known boolean, mark long, n long, one long, two long, name long, cell int, seen long"), "sets"
    )
    counts = np.zeros(CELLS, np.int64)
    for r in described.where("cell >= 0").groupBy("cell").agg(F.sum("seen").alias("seen")).collect():  # CELLS rows at most
        counts[r["cell"]] = r["seen"]
    rows = described.where("cell < 0").drop("cell", "seen")
    by_set = ["one", "two", "n"]
    filled = rows.where("known AND n > 0")
    # an id names one class only, as a rule; if some id has different texts, classes are named by their digests
    by_class = not filled.groupBy("id").agg((F.min("name") != F.max("name")).alias("several")).where("several").isEmpty()
    named = [F.min("name").alias("rep"), F.min_by("mark", F.struct("id", "mark")).alias("mark")] if by_class else [F.min("id").alias("rep")]
    classes = scratch.keep(filled.groupBy(*by_set).agg(*named, F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")), "classes")

    # each entry's bucket is named by the smallest id in it
    listed = texts.where("known").select("id", "text").mapInPandas(_listed(ngram, percent, spark.sparkContext.broadcast(counts), by_class), "key long, id long")
    met = listed.select("id", F.min("id").over(Window.partitionBy("key")).alias("center")).where("id <> center")
    near = scratch.keep(met.select("center", "id").distinct(), "near")
    rep_of = classes.select(F.col("rep").alias("id"), "rep") if by_class else filled.join(classes, by_set).select("id", "rep")
    edges = (
        near.join(rep_of, "id")
        .select("center", F.col("rep").alias("b"))
        .join(rep_of.select(F.col("id").alias("center"), F.col("rep").alias("a")), "center")
        .select("a", "b")
        .where("a <> b")
        .distinct()
    )
    clusters = connected(edges, scratch)
    scratch.drop(near)

    # the texts of the clusters' sets, one for each class, and their blocks
    source = ["id", "mark"] if by_class else ["id"]
    # linked sizes differ by a factor of 100 / percent at most, so their steps differ by one at most
    step = F.floor(F.log("n") / F.lit(1.01 * log(100 / percent))).cast("int")
    placed = clusters.withColumnRenamed("component", "cluster").join(classes.withColumnRenamed("rep", "node").withColumnRenamed("least", "id"), "node").withColumn("step", step)
    by_step = placed.groupBy("cluster", "step").agg(F.count(F.lit(1)).alias("size"))
    of = Window.partitionBy("cluster").orderBy("step")
    fit = F.floor(BLOCK_TOKENS / F.pow(F.lit((100 / percent) ** 1.01), F.col("step") + 1))
    by_step = by_step.withColumn("blocks", F.ceil(F.col("size") / F.greatest(F.lit(BLOCK), F.least(F.lit(BLOCK * WIDER), fit))).cast("int"))
    beside = lambda move, there: F.when(move("step", 1).over(of) == F.col("step") + there, move("blocks", 1).over(of)).otherwise(0)
    whole = F.sum("size").over(Window.partitionBy("cluster")) <= BLOCK
    by_step = by_step.select("cluster", "step", whole.alias("alone"), "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    members = scratch.keep(placed.join(by_step, ["cluster", "step"]).select("node", *source, "cluster", "step", "alone", "blocks", "below", "above", "weight"), "members")
    groups = max(1, members.count() // BLOCK)
    likely = _filtered(texts.where("known").select(*source, "text"), F.col("id"), members, "id").where("_inside").drop("_inside")
    named_block = lambda step, place: step.cast("long") * (1 << 24) + place
    own = named_block(F.col("step"), F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    every = lambda n, there: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: named_block(F.col("step") + there, i))
    nothing = F.lit(0).cast("long")
    dealt = (
        likely.join(members, source)
        .dropDuplicates(source)
        .select(
            F.col("node").alias("id"), "cluster", "weight", "alone", F.when(F.col("alone"), nothing).otherwise(own).alias("block"),
            F.when(F.col("alone"), F.array(nothing)).otherwise(F.concat(every("below", -1), every("blocks", 0), every("above", 1))).alias("others"), "text",
        )
        .mapInPandas(_with_tokens(ngram), "id long, cluster long, weight long, alone boolean, block long, others array<long>, tokens binary")
        .withColumn("other", F.explode("others"))
        .select(
            F.when(F.col("alone"), -1 - F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster")).alias("deal"),
            "alone", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cluster", "id", "block", "weight", "tokens",
        )
    )
    found = scratch.keep(dealt.groupBy("deal", "alone", "i", "j").applyInPandas(_verified(percent), "a long, b long, n long"), "links")

    links = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links"))
    linked = found.where("a <> b").select("a", "b")
    if by_class:
        # the classes of an id's texts are one component, which bears its smallest id
        first = filled.groupBy("id").agg(F.min("name").alias("a"))
        linked = linked.unionByName(filled.join(first, "id").select("a", F.col("name").alias("b")).where("a <> b"))
    labels = connected(linked, scratch)
    if by_class:
        of_class = labels.join(classes.select(F.col("rep").alias("node"), "least"), "node")
        labels = labels.join(of_class.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", F.col("first").alias("component"))
    labelled = (
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links.withColumnRenamed("a", "rep"), "rep", "left")
        .select(*by_set, F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    )
    out = rows.join(labelled, by_set, "left")
    return out.select(
        F.when(F.col("known"), F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("known"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"),
        F.when(F.col("known") & (F.col("n") > 0), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def _by_number(docs: DataFrame, ngram: int, percent: int, id_col: str, text_col: str, scratch: Workspace) -> DataFrame:
    """components() of ids that are no numbers: they are numbered in their order, and named again at the end."""
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "_id").sortWithinPartitions("_id").withColumn("_number", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered, "numbers")
    numbered = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(ordered, "_id", "left").select(F.col("_number").alias("number"), "text")
    found = components(numbered, ngram, percent, "number", "text")
    named = lambda number, name: ordered.select(F.col("_number").alias(number), F.col("_id").alias(name))
    out = found.join(named("number", id_col), "number", "left").withColumnRenamed("component_id", "_component").join(named("_component", "component_id"), "_component", "left")
    return out.select(id_col, "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs for one document of each component, that with the smallest id; null ids stay."""
    found = components(docs, ngram, percent, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    gone = Workspace(docs.sparkSession).keep(gone, "gone")
    # only documents that the filter takes for dropped ones are shuffled
    marked = _filtered(docs, F.col(id_col).cast(gone.schema["_gone"].dataType), gone, "_gone")
    likely = marked.where("_inside").join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    return marked.where("not _inside").select(*docs.columns).unionByName(likely.select(*docs.columns))
