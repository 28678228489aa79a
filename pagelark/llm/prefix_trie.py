"""Prefix trie of conversations in preorder-interval encoding.

Every distinct sequence of first turns is a node. Nodes are ranked in an order in which each subtree is one interval; a
node stores where its interval begins and ends, and whatever is summed over a subtree is then a difference of two prefix
sums, which are computed over all nodes at once.

Plan
----
1. A prefix is named by the exclusive or of 64-bit hashes of (turn, place), two of them, so all names come from one
   segmented scan over the turns (`scans.scan`). Turns are hashed at once; no text is shuffled.
2. Nodes are the distinct (depth, name); their members are counted with map-side combine, so a prefix that a third of all
   conversations share sends one row for each map task.
3. The rank compares the labels of the edges on a node's path. Among siblings the one with most members comes first, the
   others by name. An edge to such a first child needs no place in the key: a key holds the other edges only, each with
   its depth, deepest first. Behind each of these edges are at most half of the members, so a key has at most
   log2(conversations) entries, however long conversations are.
4. An opening and a closing entry for each node are sorted by key together, and prefix sums of nodes, leaves and savings
   run over them. Differences of a node's two entries are its results.
5. The conversations that end at a node are written as runs in a range-partitioned order; the runs of a node are joined in
   order by a task that streams them, so its memory doesn't grow with the node. Only the digest's own sequence is serial.

Names of different prefixes agree with a chance of 2^-128 a pair.

Cases: turns of equal number are ordered by role, the first 64 characters of the text, and a hash of role and text; null
turns come first; null roles and texts are empty. Rows with a null conversation id are left out. A conversation without
turns is a member of the root only. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from .scans import scan

#: Depths stay below this; a depth counts down from it where deeper ones come first.
DEEPEST = 1 << 62

#: Ids of a run that go on as one text.
RUN = 4096

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NAME = ["depth", "one", "two"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, the text's head and bytes, and a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("code"), F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(turns: DataFrame, scratch: Workspace) -> DataFrame:
    """conv_id, place (from 1), code, bytes."""
    slim = scratch.keep(turns.withColumn("place", F.lit(1).cast("long")), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "code"]
    placed, _ = scan(slim, order, scratch, group="conv_id", adds=("place",))
    scratch.drop(slim)
    return placed.select("conv_id", F.col("run_place").alias("place"), "code", "bytes")


def regrafted(turns: DataFrame, scratch: Workspace, family: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the first one of their family: (conv_id, depth, code, bytes, ends)
    and (conv_id, length). A conversation c takes crc32(c) % shared turns, fewer if there are fewer, of c - c % family."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % shared
    c = F.col("conv_id")
    lengths = scratch.keep(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "lengths")
    convs = lengths.select("conv_id", "n", head(c).alias("h"), (c - c % family).alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = scratch.keep(convs.select("conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    scratch.drop(lengths)
    own = turns.where(F.col("place") > head(c)).join(convs, "conv_id").withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    members = F.transform(F.array(*[F.lit(i).cast("long") for i in range(1 - family, family)]), lambda i: F.try_add(c, i))
    members = F.filter(members, lambda x: x.isNotNull() & (x - x % family == c) & (head(x) >= F.col("place")))
    lent = turns.where((c % family == 0) & (F.col("place") < shared)).withColumn("conv_id", F.explode(members)).join(convs, "conv_id").withColumn("depth", F.col("place"))
    picked = ["conv_id", "depth", "code", "bytes", (F.col("depth") == F.col("length")).alias("ends")]
    return own.select(*picked).unionByName(lent.select(*picked)), convs.select("conv_id", "length")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of sorted rows: the node, its first id, and the ids as text."""
    node, ids = None, []
    for batch in batches:
        out = []
        for top, depth, c in zip(batch["top"].tolist(), batch["depth"].tolist(), batch["conv_id"].tolist()):
            if node != (top, depth) or len(ids) >= RUN:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (top, depth), []
            ids.append(c)
        yield pd.DataFrame(out, columns=["top", "depth", "first", "ids"])
    if ids:
        yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=["top", "depth", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's runs, which come sorted."""
    node, sha, columns = None, None, ["conv_id", "depth", "ends_sha256"]
    for batch in batches:
        out = []
        for top, depth, ids in zip(batch["top"].tolist(), batch["depth"].tolist(), batch["ids"]):
            if node == (top, depth):
                sha.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, sha.hexdigest()))
            node, sha = (top, depth), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=columns)
    if node:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=columns)


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id (of the node), depth and ends_sha256, from the node (top, depth) of each conversation's end; top and
    depth are never null."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["top", "depth", "conv_id"]
    runs = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_runs, "top long, depth long, first long, ids string")
    return runs.repartition("top", "depth").sortWithinPartitions("top", "depth", "first").mapInPandas(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, scratch: Workspace) -> DataFrame:
    """One row for each node.

    turns: conv_id, depth (from 1), code, bytes, ends (whether it is the conversation's last). conversations: conv_id,
    length. conv_id is the smallest member; with depth it names the node. Beside the results the rows have first and last,
    the node's interval in preorder (last exclusive).
    """
    term = lambda i: F.xxhash64("code", "depth", F.lit(i))
    turns = scratch.keep(turns.select("conv_id", "depth", "bytes", "ends", term(1).alias("one"), term(2).alias("two")), "terms")
    paths, _ = scan(turns, ["conv_id", "depth"], scratch, group="conv_id", xors=("one", "two"))
    scratch.drop(turns)
    up = [(F.col("depth") - 1).alias("depth"), F.col("run_one").bitwiseXOR(F.col("one")).alias("one"), F.col("run_two").bitwiseXOR(F.col("two")).alias("two")]
    paths = paths.select("conv_id", "depth", "bytes", "ends", F.col("run_one").alias("one"), F.col("run_two").alias("two"), *[x.alias(f"up_{n}") for x, n in zip(up, NAME)])

    nodes = paths.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), *[F.min(f"up_{n}").alias(f"up_{n}") for n in NAME]
    )
    nothing = F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(n) for n in NAME], "conv_id", "n_convs", zero.alias("bytes"), *[nothing.alias(f"up_{n}") for n in NAME])
    nodes = scratch.keep(nodes.unionByName(root), "nodes")

    largest = F.max(F.struct("n_convs", "one", "two"))
    children = nodes.where("depth > 0").groupBy(*[f"up_{n}" for n in NAME]).agg(F.count(F.lit(1)).alias("n_children"), largest.alias("largest"))
    above = nodes.select("conv_id", *[F.col(n).alias(f"up_{n}") for n in NAME]).join(children, [f"up_{n}" for n in NAME])
    above = scratch.keep(above.select(*[f"up_{n}" for n in NAME], F.col("conv_id").alias("parent_conv_id"), "n_children", F.col("largest.one").alias("first_one"), F.col("largest.two").alias("first_two")), "parents")
    below = above.select(*[F.col(f"up_{n}").alias(n) for n in NAME], "n_children")
    beside = (F.col("one") != F.col("first_one")) | (F.col("two") != F.col("first_two"))
    linked = (
        nodes.join(above.drop("n_children"), [f"up_{n}" for n in NAME], "left")
        .join(below, NAME, "left")
        .select(*NAME, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce(beside, F.lit(False)).alias("beside"))
    )
    linked = scratch.keep(linked, "linked")
    scratch.drop(nodes, above)

    # of each path the edges that its key lists: at most log2(conversations)
    listed = paths.select("conv_id", *NAME).join(linked.where("beside").select(*NAME), NAME).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*NAME))).alias("edges"))
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    edge = lambda e: F.concat(F.lit("1"), wide(F.lit(DEEPEST) - e["depth"]), wide(e["one"]), wide(e["two"]))
    path = F.coalesce(F.array_join(F.transform(F.filter("edges", lambda e: e["depth"] <= F.col("depth")), edge), ""), F.lit(""))
    keyed = linked.join(listed, "conv_id", "left").withColumn("path", path)
    opening = F.struct(F.concat("path", F.lit("0"), wide(F.col("depth"))).alias("key"), F.lit(1).cast("long").alias("node"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), F.col("saved").alias("saving"))
    closing = F.struct(F.concat("path", F.lit("1"), wide(F.lit(DEEPEST) - F.col("depth"))).alias("key"), zero.alias("node"), zero.alias("leaf"), zero.alias("saving"))
    entries = keyed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.inline(F.array(opening, closing)))
    entries = scratch.keep(entries, "entries")
    summed, _ = scan(entries, ["key"], scratch, adds=("node", "leaf", "saving"))
    scratch.drop(entries)
    span = lambda x: F.max(f"run_{x}") - F.min(F.col(f"run_{x}") - F.col(x))
    found = summed.groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), span("leaf").alias("n_leaves"),
        span("saving").alias("saved_tokens"), F.min(F.col("run_node") - F.col("node")).alias("first"), F.max("run_node").alias("last"),
    )

    ends = paths.where("ends").select(*NAME, F.col("conv_id").alias("c")).join(linked.select(*NAME, "conv_id"), NAME).select(F.col("conv_id").alias("top"), "depth", F.col("c").alias("conv_id"))
    top = linked.where("depth = 0").select("conv_id").first()  # the root's one row, if there is a conversation
    lone = conversations.where("length = 0").select(F.lit(top["conv_id"] if top else None).cast("long").alias("top"), zero.alias("depth"), "conv_id")
    ends = scratch.keep(ends.unionByName(lone), "ends")
    out = found.join(ends_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "first", "last"
    )


def regrafted_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first turns come from the first one of their family of five."""
    scratch = Workspace(conversations.sparkSession)
    return trie(*regrafted(numbered(turns_of(conversations), scratch), scratch), scratch)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    scratch = Workspace(conversations.sparkSession)
    turns = numbered(turns_of(conversations), scratch)
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    ending = turns.join(lengths, "conv_id").select("conv_id", F.col("place").alias("depth"), "code", "bytes", (F.col("place") == F.col("length")).alias("ends"))
    return trie(ending, lengths, scratch)
