"""Sharding by jump consistent hashing.

A stable key walks along the jumps j -> floor((j + 1) / u), where u is the next number of a random sequence that the key
seeds; the last jump below the shard count is its shard. No ring table is kept, and when shards are appended a key
either stays or moves into a new one. The sequence here is counter based, xxhash64(key, step): a linear congruential
step would overflow 64 bits, which ANSI arithmetic rightly refuses.

Slots number the rows of a shard without gaps. One window over a shard would put a fortieth of the corpus in one task,
so rows are dealt by (shard, slice of a hash of key and text), numbered within that, and shifted by the prefix sum of the
slices' counts: shards x SLICES numbers, a table of fixed size that may be broadcast.

Cases: null keys hash as null, all to one shard; rows that repeat a key share its shard and get slots of their own. Rows
that repeat both key and text are numbered in one task.
A null text has the size of no bytes and the checksum of the empty text. Extra columns pass through untouched unless
they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Jumps that are tried for every key; more than the logarithm of any usual shard count. Keys that need more get them.
JUMPS = 16

#: Slices of a shard that are numbered independently; bounds the broadcast offsets to shards x SLICES rows.
SLICES = 256


def jump_hash(key: Column, shards: int) -> Column:
    """Shard from 0 to shards - 1 for a key of any hashable type."""
    if shards < 1:
        raise ValueError("shards must be positive")
    # numerator 2^31 and denominator of 31 random bits plus one, as the published algorithm has them
    uniform = lambda step: F.shiftrightunsigned(F.xxhash64(key, step), 33) + F.lit(1)
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, step: Column) -> Column:
        further = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / uniform(step))).cast("long")
        return F.when(
            state["next"] < shards, F.struct(state["next"].alias("at"), further.alias("next"))
        ).otherwise(state)

    # a key takes about ln(shards) jumps; each advances by at least one, so as many as shards always suffice
    tried = F.aggregate(F.sequence(F.lit(1), F.lit(min(JUMPS, shards))), start, jump)
    if shards > JUMPS:
        rest = lambda s: F.when(s["next"] < shards, F.aggregate(F.sequence(F.lit(JUMPS + 1), F.lit(shards)), s, jump)).otherwise(s)
        tried = F.get(F.transform(F.array(tried), rest), F.lit(0))
    return tried["at"].cast("int")


def assign(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    slices: int = SLICES,
) -> DataFrame:
    """docs with size (UTF-8 bytes plus overhead), text_crc32, shard, slot and grown_shard (with one shard more)."""
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sliced = lambda df: df.withColumn("shard", jump_hash(key, shards)).withColumn(
        "_slice", F.pmod(F.xxhash64(key, F.col(text_col), F.lit("slot")), F.lit(slices)).cast("int")
    )
    offsets = (
        sliced(docs.select(id_col, text_col))
        .groupBy("shard", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("shard", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    plain = docs.drop(*made)
    numbered = sliced(
        plain.withColumn("size", F.octet_length(text).cast("long") + overhead).withColumn(
            "text_crc32", F.crc32(text.cast("binary"))
        )
    ).withColumn("grown_shard", jump_hash(key, shards + 1))
    within = Window.partitionBy("shard", "_slice").orderBy(key, "text_crc32", "size")
    return (
        numbered.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_slice"])
        .withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("long"))
        .drop("_slice", "_row", "_before")
    )
