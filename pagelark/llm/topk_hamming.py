"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is positive. Codes are cut into m segments of a
few bits less than log2(n), and a table lists the distinct codes by (segment, value). A query code looks up the values within radius r
of its own, r = 0, 1, 2, ...: a code at distance d has some segment within floor(d / m), so once radius r is done every
code up to distance m (r + 1) - 1 has been seen; once only s of the segments have been looked up with radius r, up to
m r + s - 1. The search of a query ends when its kth verified distance is within that. Nothing is approximate, and ties go to
the smaller id.

Each half of the segments at each radius (radii 0 and 1 at once) is one round of joins on (segment, value), for the queries
that are still open: probes are the queries' segments with r bits flipped, what they meet is verified by the whole codes, and
the best so far go on to the next round through the shared folder. Once a query has k of them, the join passes on only codes no farther than its kth distance:
others can't be among its answers. A code that several segments would find counts under the first of its nearest segments, so it
is verified once. The joins are on keys that adaptive execution can split where a value is hot; all of it is built-in
functions.

Where the probes of a round would outnumber PROBES x all codes each of the open queries had rather be compared with all codes:
queries in blocks against chunks of codes, k rows for each query from each chunk. That is also the exact way for tables
of a few codes and for queries far from everything.

A code shared by many rows keeps its k + 1 smallest ids, which a window with map-side limit finds and which is all that
any answer can need. Queries of one code are searched once.

Cases: rows with a null id, or whose vector is null, empty, has a null element or another length than `dims` (by default
the greatest length), are neither queries nor answers. A query is not its own neighbour, but others with its code are.
Rows that repeat an id count as one row of the smallest distance. Fewer than k answers exist only if there are fewer
other rows. Columns other than id and vector are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

CHUNK = 1 << 13
BLOCK = 1 << 9
#: Bits of a segment at most; bounds the table of masks that is broadcast.
WIDTH = 20
#: Bits by which a segment is narrower than log2(codes): a value then has 2^SPARE codes on average, so that what the probes
#: cost and what the codes they meet cost are about alike; with wider segments the probes outnumber the codes they meet.
SPARE = 2
#: Share of all codes that a query's probes of one radius may amount to.
PROBES = 1.0


def code_of(vector: Column, dims: int) -> Column:
    """array<bigint> of the signs, 64 dimensions to a number."""
    return F.array(*[_bits(vector, 64 * w, min(64, dims - 64 * w)) for w in range(-(-dims // 64))])


def _bits(vector: Column, first: int, width: int) -> Column:
    return F.aggregate(
        F.slice(vector, first + 1, width),
        F.lit(0).cast("long"),
        lambda code, x: F.shiftleft(code, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")),
    )


def segment_bounds(dims: int, codes: int) -> list[tuple[int, int]]:
    """(first dimension, width) of segments of about log2(codes) - SPARE bits, near equal in width."""
    width = min(WIDTH, max(4, round(log2(codes + 1)) - SPARE))
    count = max(1, ceil(dims / width))
    edges = [dims * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _apart(a: str, b: str) -> Column:
    """Hamming distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _nearest(found: DataFrame, most: int, k: int) -> DataFrame:
    """The k nearest ids of each query code; most: how many codes an id has at most."""
    by = Window.partitionBy("asked").orderBy("hamming", "id")
    few = found.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k * most).drop("_r")
    if most > 1:
        few = few.groupBy("asked", "id").agg(F.min("hamming").alias("hamming")).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")
    return few.select("asked", "id", "hamming")


def _probed(entries: DataFrame, asked: DataFrame, bounds: list[tuple[int, int]], radii: list[int], segments: range) -> DataFrame:
    """(asked, id, hamming) of the codes that one of the segments finds at one of the radii and none finds at a smaller one,
    and that are within the query's bound where it has one."""
    spark = entries.sparkSession
    masks = [(j, r, sum(1 << i for i in c)) for j, (_, w) in enumerate(bounds) if j in segments for r in radii if r <= w for c in combinations(range(w), r)]
    masks = spark.createDataFrame(pd.DataFrame(masks, columns=["segment", "radius", "mask"]), "segment int, radius int, mask long")
    probes = (
        asked.select(F.col("code").alias("asked"), F.col("segments").alias("own"), "bound", F.posexplode("segments").alias("segment", "value"))
        .join(F.broadcast(masks), "segment")
        .select("asked", "own", "bound", "segment", "radius", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    )
    index = entries.select("code", "segments", "ids", F.posexplode("segments").alias("segment", "value"))
    spread = F.zip_with("own", "segments", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # the nearest segment finds a code, the first of the nearest ones
    finder = F.array_position(F.col("_spread"), F.array_min("_spread")) - 1
    return (
        probes.join(index, ["segment", "value"])
        .withColumn("_spread", spread)
        .where((F.col("segment") == finder) & (F.col("bound").isNull() | (_apart("asked", "code") <= F.col("bound"))))
        .select("asked", F.explode("ids").alias("id"), _apart("asked", "code").cast("long").alias("hamming"))
    )


def _scanned(entries: DataFrame, asked: DataFrame, total: int, asking: int, k: int, chunk: int, block: int) -> DataFrame:
    """(asked, id, hamming) by comparing each query code with all codes, k ids from each chunk."""
    chunks, blocks = max(1, -(-total // chunk)), max(1, -(-asking // block))
    dealt = lambda x, n: F.pmod(F.xxhash64(x, F.lit("deal")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("code", "ids").withColumn("chunk", dealt("code", chunks)).withColumn("block", every(blocks))
    right = asked.select("code").withColumn("block", dealt("code", blocks)).withColumn("chunk", every(chunks))

    def compared(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(queries):
            codes = np.array(index["code"].tolist(), np.int64).view(np.uint64)
            held = np.array([len(x) for x in index["ids"]])
            ids = np.concatenate([np.asarray(x, np.int64) for x in index["ids"]])
            for code in queries["code"]:
                own = np.asarray(code, np.int64).view(np.uint64)
                near = np.repeat(np.bitwise_count(codes ^ own).sum(axis=1, dtype=np.int64), held)
                cut = np.partition(near, k - 1)[k - 1] if len(near) > k else near.max()
                some = np.flatnonzero(near <= cut)
                first = some[np.lexsort((ids[some], near[some]))][:k]
                out += [(list(code), int(ids[i]), int(near[i])) for i in first]
        return pd.DataFrame(out, columns=["asked", "id", "hamming"])

    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(compared, "asked array<long>, id long, hamming long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and hamming of the k nearest other rows of each row where is_query holds."""
    scratch = Workspace(vectors.sparkSession)
    vector = F.col(vector_col)
    if dims is None:
        dims = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    dims = max(int(dims), 1)
    whole = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())
    coded = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), code_of(vector, dims).alias("code"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # made distinct first, so that repeated rows don't use up the places of a code
    coded = scratch.keep(coded.groupBy("id", "code").agg(F.max("asks").alias("asks")), "coded")
    most = coded.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    need = k + 1  # the query itself may be among them
    by_code = Window.partitionBy("code").orderBy("id")
    entries = coded.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= need).groupBy("code").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    total = coded.select("code").distinct().count()
    bounds = segment_bounds(dims, total)
    # a segment's value from the bits of the words that it lies in
    bit = lambda d: F.call_function("getbit", F.get("code", F.lit(d // 64)), F.lit(min(63, dims - 1 - 64 * (d // 64)) - d % 64)).cast("long")
    values = [sum((F.shiftleft(bit(d), a + w - 1 - d) for d in range(a, a + w)), F.lit(0).cast("long")) for a, w in bounds]
    segmented = F.array(*values)
    entries = scratch.keep(entries.withColumn("segments", segmented), "entries")
    open_ = scratch.keep(coded.where("asks").select("code").distinct().withColumns({"segments": segmented, "bound": F.lit(None).cast("long")}), "asked")
    asking = open_.count()
    best, radii, segments = None, [0, 1], range(len(bounds))
    while asking and k > 0:
        probes = sum(comb(bounds[j][1], r) for j in segments for r in radii)
        scan = probes > PROBES * total or min(w for _, w in bounds) < radii[-1]
        found = _scanned(entries, open_, total, asking, need * most, chunk, block) if scan else _probed(entries, open_, bounds, radii, segments)
        known = open_.select(F.col("code").alias("asked"))
        if best is not None and scan:
            best = best.join(known, "asked", "left_anti")  # the comparison finds theirs again
        best = scratch.keep(_nearest(found if best is None else best.unionByName(found), most, need), "best")
        if scan:
            break
        # a code that isn't found yet differs by more than the radius in the segments done, by the radius at least in the others
        covered = len(bounds) * radii[-1] + segments.stop - 1
        kth = F.when(F.count(F.lit(1)) >= need, F.max("hamming")).alias("bound")
        reached = best.groupBy(F.col("asked").alias("code")).agg(kth)
        open_ = scratch.keep(open_.drop("bound").join(reached, "code", "left").where(F.col("bound").isNull() | (F.col("bound") > covered)), "asked")
        asking, half = open_.count(), -(-len(bounds) // 2)
        radii, segments = ([radii[-1] + 1], range(half)) if segments.stop == len(bounds) else (radii, range(segments.stop, len(bounds)))
    if best is None:
        best = coded.where(F.lit(False)).select(F.col("code").alias("asked"), "id", F.lit(0).cast("long").alias("hamming"))
    queries = coded.where("asks").select(F.col("id").alias("query_id"), F.col("code").alias("asked"))
    answers = queries.join(best, "asked").where("id <> query_id").groupBy("query_id", F.col("id").alias("neighbor_id")).agg(F.min("hamming").alias("hamming"))
    order = Window.partitionBy("query_id").orderBy("hamming", "neighbor_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "hamming")
