"""Exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside groups.

Plan
----
1. One scan counts the documents of each hash; only hashes are shuffled, with map-side combine, so that a group of
   copies sends one row for each map task whatever its size. Those that occur more than once are written to the shared
   folder.
2. Hashes that occur once need no comparison. The others set bits of a filter, a table of at most FILTER_WORDS x 64
   bits, that is broadcast. A second scan groups the documents that pass it by (hash, text): the text is part of the
   grouping key, so Spark compares its bytes, and two texts that collide in the hash stay apart. That outcome, without
   the texts, is written as well. Texts of hashes that occur once are shuffled only where the filter takes them for
   others by chance: rarely while repeated hashes are fewer than its bits; beyond that more texts move, the result
   stays the same.
3. Documents that don't pass the filter stand alone and are returned as they are. Each other one finds its group by its
   hash; where a hash stands for several texts, by the digest of its text too. The side with the documents may hold one
   hot hash; its partition is split by adaptive execution, as the other side has one row for each hash.

Cases: a null text counts as empty. Rows with a null id rank behind all others, and the group's keep_id is null only if
all of its ids are. Rows that repeat an id with equal text are one document: they share kept. Extra columns pass through
`annotate` untouched unless they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from .common import ascii_lower

#: Size of the filter of repeated hashes, in 64-bit words; bounds what is broadcast to some MB.
FILTER_WORDS = 1 << 18


def annotate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=ascii_lower,
) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 of the normalised text.

    keep: which id of a group stays, "smallest" or "largest".
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    scratch = Workspace(docs.sparkSession)
    norm: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    hashed = docs.withColumn("_norm", norm).withColumn("_hash", F.unhex(F.md5("_norm")))

    slim = docs.select(F.unhex(F.md5(norm)).alias("hash"))
    repeated = scratch.keep(slim.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    word = lambda h: F.pmod(F.xxhash64(h), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(F.xxhash64(h), 32), F.lit(64)).cast("int")
    words = scratch.keep(repeated.groupBy(word(F.col("hash")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash")))).alias("_bits")), "filter")
    marked = hashed.withColumn("_word", word(F.col("_hash"))).join(F.broadcast(words), "_word", "left")
    marked = marked.withColumn("_often", F.coalesce(F.call_function("getbit", F.col("_bits"), bit(F.col("_hash"))) == 1, F.lit(False))).drop("_word", "_bits")

    groups = (
        marked.where("_often")
        .groupBy("_hash", "_norm")
        .agg(pick(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", "keep_id", "group_size", F.sha2("_norm", 256).alias("text_sha256"))
    )
    groups = scratch.keep(groups, "groups")
    digest = F.sha2("_norm", 256)
    alone = marked.where("not _often").select(*docs.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), digest.alias("text_sha256"))
    candidates = marked.where("_often").drop("_often")
    if groups.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        found = candidates.drop("_norm").join(groups, "_hash")
    else:
        # the digest tells the texts of a collided hash apart; they were grouped by their bytes above
        found = candidates.withColumn("text_sha256", digest).drop("_norm").join(groups, ["_hash", "text_sha256"])
    out = alone.unionByName(found.select(*alone.columns))
    made = [F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return out.select(*docs.columns, "keep_id", "group_size", *made)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=ascii_lower) -> DataFrame:
    """The columns of docs for one row of each distinct text.

    Rows that repeat an id with equal text, or a text whose ids are all null, are all flagged by annotate; of these one
    stays, chosen by a hash of the whole row. Only ids, digests and hashes are grouped to find such texts; the rows
    themselves are grouped only if they share a text and that hash with another flagged row.
    """
    stay = annotate(docs, id_col, text_col, keep, normalise).where("kept")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        return stay.select(*docs.columns)
    row = F.struct(*docs.columns)
    marked = stay.withColumn("_row", F.xxhash64(row.cast("string")))
    several = marked.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least")).where("_n > 1").drop("_n")
    several = Workspace(docs.sparkSession).keep(several, "several")
    # the side with the rows may hold a hot text, which adaptive execution splits
    told = marked.join(several, "text_sha256", "left")
    alone = told.where("_least is null").select(*docs.columns)
    first = told.where("_row = _least").groupBy("text_sha256").agg(F.min_by(row, "_row").alias("_one"))
    return alone.unionByName(first.select("_one.*"))
