"""Near-duplicate detection by an LSH forest of MinHash signatures.

A document's set holds the 64-bit hashes of its word n-grams. Its signature has one minimum for each of TREES x STEP hash
functions; two sets agree in a minimum with the chance of their Jaccard similarity. A tree is an order of all signatures,
sorted by DEPTH minima that begin at the tree's own place, so sets that are alike have long common prefixes and stand close
together in most trees.

Plan
----
1. Documents of equal sets are a class; only one row of each goes on. Digests and signatures are written once.
2. The classes are sorted in each tree: one range-partitioned sort over (tree, prefix). One pass over each partition finds
   the candidates: a row's two neighbours, and all rows of its region. The region has adaptive depth: it is the
   shortest common prefix that at most WINDOW rows share, so it is shallow where texts are singular and deep where a
   passage is widespread. A candidate pair must also
   agree in half of the minima that the tree compares, which linked pairs miss with a chance of 0.4 % a tree.
3. Neighbours across partitions: the first and last rows of each partition, a table of 2 x WINDOW rows a partition, go
   through the same pass again, with ever fewer partitions until there is one.
4. Candidates are verified on the full sets in two rounds: one partner for each class first; then, of all other
   candidates, those that the links found so far leave in different components. So a group of thousands of near copies
   costs about one verification for each, yet every candidate that can change the result is verified.

5. A region that is still larger than WINDOW at depth SHALLOW holds pairs that the trees may not find: large groups of near
   copies, widespread passages. Classes that stand in such regions in two trees or more are joined among one another by
   `ngram_join`, which misses nothing. So a linked pair is missed only if it has fewer than two common prefixes of SHALLOW
   minima: in each tree where it has one, the region is small and the pair a candidate, or it is large for both ends. At a
   similarity of 0.8 that has a chance of 6e-5, at 0.85 of 5e-7.

Hot groups: copies are aggregated map-side; equal prefixes are spread by class number in the sort; the joins on a class
have one row for each key on one side. What is broadcast is a filter of fixed size that tells which texts to read again.
Two different n-grams are taken for one with a chance of 2^-64 a pair; links are exact up to that.

Cases: a text that is null, empty or has no words has an empty set and links with nothing; with fewer words than n the
whole sequence is one n-gram. Rows with a null id get their size, but no component, and are kept. Rows that repeat an id
with equal text are copies; with different texts they join their components. Ids may be of any orderable type. Texts are
read whole. Columns other than id and text are ignored by `components` and pass through `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from .components import connected
from .ngram_join import components as joined_exactly
from .ngram_join import finalised, ngram_sets

TREES = 24
#: Minima that a tree has for itself, and minima by which it is sorted; the rest are those of the next tree.
STEP = 8
DEPTH = 12
#: Rows of a region at most.
WINDOW = 12
#: Minima of a tree's prefix in which a candidate pair agrees at least.
AGREED = 6

#: Depth of regions that are deep.
SHALLOW = 4

FILTER_WORDS = 1 << 16
#: Rows of a pass within a partition.
PASS = 1 << 16

U = np.uint64
_MULTIPLIERS = finalised(np.arange(1, TREES * STEP + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def signature(tokens: np.ndarray) -> bytes:
    """The minima of a set under each hash function, 32 bits each, in an order of bytes that is that of the numbers."""
    least = np.full(len(_MULTIPLIERS), ~U(0))
    for i in range(0, len(tokens), 256):
        np.minimum(least, (tokens[i : i + 256, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (least >> U(32)).astype(">u4").tobytes()


def digest(tokens: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits that tell sets apart, as signed numbers."""
    one, two = tokens.sum(dtype=np.uint64), finalised(tokens * U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return len(tokens), int(one.view(np.int64)), int(two.view(np.int64))


def _described(n: int, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("signature", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(*digest(t), signature(t) if len(t) else None) for t in ngram_sets(batch.column(1).to_pylist(), n)]
            columns = [list(x) for x in zip(*sets)] if sets else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), *[pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:])]], schema=schema)

    return describe


def _digested(n: int, kind: pa.DataType, tokens: bool):
    """Adds the set's digest; the text is replaced by the set's tokens if they are asked for."""
    schema = pa.schema([("id", kind), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("held", pa.binary() if tokens else pa.string())])

    def add_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(*digest(t), t.tobytes() if tokens else None) for t in ngram_sets(batch.column(1).to_pylist(), n)]
            columns = [pa.array(list(x), f.type) for x, f in zip(zip(*sets) if sets else [[]] * 4, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), *columns[:3], columns[3] if tokens else batch.column(1).cast(pa.string())], schema=schema)

    return add_digests


def candidates(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, window: int = WINDOW, agreed: int = AGREED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreeing minima) of the candidate pairs of sorted rows, and the rows whose region is deeper than SHALLOW;
    keys has a row of minima for each."""
    depth = keys.shape[1]
    common = np.cumprod((keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
    size = np.ones((depth + 1, len(keys)), np.int64)
    for d in range(1, depth + 1):
        region = np.concatenate(([0], np.cumsum(common < d)))[: len(keys)]
        size[d] = np.bincount(region)[region]
    left, right, shared = [], [], common
    for apart in range(1, min(window, len(keys))):
        if apart > 1:
            shared = np.minimum(shared[:-1], common[apart - 1 :])
        at = np.flatnonzero(shared > 0)
        if not len(at):
            break
        if apart > 1:
            at = at[size[shared[at], at] <= window]
        left.append(at)
        right.append(at + apart)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    alike = (keys[i] == keys[j]).sum(axis=1)
    fit = (alike >= agreed) & (node[i] != node[j])
    a, b = node[i[fit]], node[j[fit]]
    return np.minimum(a, b), np.maximum(a, b), alike[fit], np.flatnonzero(size[SHALLOW] > window)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs of sorted rows (alike from 0), rows in deep regions (-2), and the partition's first and last rows (-1)."""
    columns = ["a", "b", "alike", "tree", "prefix", "node"]
    held: pd.DataFrame | None = None
    opening: list[pd.DataFrame] = []

    def passed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, tree, node = np.frombuffer(b"".join(rows["prefix"]), ">u4").reshape(len(rows), DEPTH), rows["tree"].to_numpy(), rows["node"].to_numpy()
        a, b, alike, deep = candidates(tree, keys, node)
        found = pd.DataFrame({"a": a, "b": b, "alike": alike}).groupby(["a", "b"], as_index=False)["alike"].max()
        yield found.assign(tree=-1, prefix=b"", node=0)[columns]
        yield pd.DataFrame({"a": 0, "b": 0, "alike": -2, "tree": tree[deep], "prefix": b"", "node": node[deep]})[columns]

    for batch in batches:
        if sum(map(len, opening)) < WINDOW:
            opening.append(batch[: WINDOW - sum(map(len, opening))])
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= PASS:
            yield from passed(held)
            held = held[-WINDOW:]
    if held is not None and len(held):
        yield from passed(held)
        edge = pd.concat([*opening, held[-WINDOW:]], ignore_index=True)
        yield edge.assign(a=0, b=0, alike=-1)[columns]


def candidate_pairs(rows: DataFrame, scratch: Workspace) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b, alike) of rows (tree, prefix, node) over all trees, and the nodes in deep regions of several trees."""
    parts, order = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["tree", "prefix", "node"]
    found = None
    while True:
        spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        here = scratch.keep(spread.mapInPandas(_neighbours, "a long, b long, alike int, tree int, prefix binary, node long"), "neighbours")
        found = here if found is None else found.unionByName(here)
        if parts == 1:
            break
        # a row may be among the first and the last ones of its partition
        rows = here.where("alike = -1").select(*order).distinct()
        parts = min(parts - 1, -(-here.where("alike = -1").count() // PASS)) or 1
    pairs = found.where("alike >= 0").groupBy("a", "b").agg(F.max("alike").alias("alike"))
    # bits of trees, as a row may be met again at the edge of a pass
    trees = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tree"))).alias("trees")
    return pairs, found.where("alike = -2").groupBy("node").agg(trees).where(F.bit_count("trees") >= 2).select("node")


def _linked(percent: int):
    def keep_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            link = []
            for x, y in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    link.append(False)
                    continue
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                link.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(link, bool), ["a", "b"]]

    return keep_links


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, held) link."""
    left, right = tokens.select(F.col("node").alias("a"), F.col("held").alias("left")), tokens.select(F.col("node").alias("b"), F.col("held").alias("right"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInPandas(_linked(percent), "a long, b long")


def components(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id, kept."""
    scratch = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    type_name, by_set = texts.schema["id"].dataType.simpleString(), ["n", "one", "two"]
    kind = texts.limit(0).select("id").toArrow().schema.field("id").type
    described = texts.mapInArrow(_described(ngram, kind), f"id {type_name}, n long, one long, two long, signature binary")
    described = scratch.keep(described.withColumn("row", F.monotonically_increasing_id()), "sets")
    filled = described.where("id IS NOT NULL AND n > 0")
    classes = filled.groupBy(*by_set).agg(F.min("id").alias("least"), F.min("row").alias("row"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    signed = filled.select("row", "signature").join(classes.select("row", "node"), "row")
    size, wrapped = 4 * STEP * TREES, F.concat("signature", "signature")
    of_tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(wrapped, t * (size // TREES) + 1, F.lit(4 * DEPTH)))
    rows = signed.select("node", F.posexplode(of_tree).alias("tree", "prefix")).select("tree", "prefix", "node")
    rows = scratch.keep(rows, "trees")
    pairs, dense = candidate_pairs(rows, scratch)
    dense = scratch.keep(dense, "dense")
    of_dense = lambda x: dense.select(F.col("node").alias(x), F.lit(True).alias(f"{x}_dense"))
    pairs = pairs.join(of_dense("a"), "a", "left").join(of_dense("b"), "b", "left").where("a_dense IS NULL OR b_dense IS NULL")
    pairs = scratch.keep(pairs.select("a", "b", "alike"), "candidates")
    scratch.drop(rows)

    def held_by(nodes: DataFrame, tokens: bool) -> DataFrame:
        """(node, held): full sets or texts of classes, read again through a filter of fixed size."""
        within = scratch.keep(nodes.join(classes.select("node", "least", *by_set), "node"), "within")
        place = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_WORDS * 64))
        word, bit = lambda x: F.floor(place(x) / 64).cast("int"), lambda x: F.pmod(place(x), F.lit(64)).cast("int")
        words = within.groupBy(word("least").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("least"))).alias("bits"))
        likely = texts.withColumn("word", word("id")).join(F.broadcast(words), "word").where(F.call_function("getbit", F.col("bits"), bit("id")) == 1).select("id", "text")
        digested = likely.mapInArrow(_digested(ngram, kind, tokens), f"id {type_name}, n long, one long, two long, held {'binary' if tokens else 'string'}")
        found = digested.join(within.withColumnRenamed("least", "id"), ["id", *by_set]).select("node", "held").dropDuplicates(["node"])
        found = scratch.keep(found, "tokens" if tokens else "texts")
        scratch.drop(within)
        return found

    tokens = held_by(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), tokens=True)
    crowded = None if dense.isEmpty() else joined_exactly(held_by(dense, tokens=False), ngram, percent, "node", "held")

    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a"))
    links = scratch.keep(verified(nearest, tokens, percent), "links")
    labels = connected(links, scratch)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
    apart = F.coalesce("a_in", "a") != F.coalesce("b_in", "b")
    others = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(apart)
    more = verified(others, tokens, percent)
    # the classes of an id that has several texts belong together
    differ = F.max("one") != F.min("one"), F.max("two") != F.min("two"), F.max("n") != F.min("n")
    several = filled.groupBy("id").agg((differ[0] | differ[1] | differ[2]).alias("several")).where("several").select("id")
    named = filled.join(several, "id").join(classes.select(*by_set, "node"), by_set).select("id", "node")
    joined = named.join(named.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b")
    links_all = links.unionByName(more).unionByName(joined)
    if crowded is not None:
        links_all = links_all.unionByName(crowded.select(F.col("component_id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    labels = connected(links_all, scratch)
    scratch.drop(links, pairs, tokens)

    of_class = classes.join(labels, "node", "left").select(*by_set, "least", F.coalesce("component", "node").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = of_class.join(smallest, "component").select(*by_set, "component_id")
    out = described.select("id", *by_set).join(labelled, by_set, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs for the documents with the smallest id of their component; null ids stay."""
    gone = components(docs, ngram, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
