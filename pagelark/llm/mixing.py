"""Mixing sources to target weights by systematic sampling.

Targets: the words of all sources are shared by weight; no source may exceed `cap` times its own words, and what it
leaves is shared again by weight among the rest. That is one water level L with target = min(cap * words, L * weight):
sources in order of cap * words / weight are full up to some place, and prefix sums give the level there.

Sampling: the prefix sum of the documents' expected copies, plus one random offset of the source, is followed along the
source's documents, and one copy is emitted for each integer boundary crossed. A document gets the floor or the ceiling
of what it expects, so never more copies than `cap` rounded up. Documents stand in size classes, the largest first, and what a class
expects is the target still open over the words still to come: what chance gives a few large documents too much or too
little, the many small ones after them make good, so that even a source of some dozen documents comes near its target.

The fold over the classes of a source sees one row for each class, a few hundred whatever the data. A document's place in
its class is its number within a hash slice plus the count of the slices before, so that no task sees the rows of a hot
source, or of a hot size, together. Texts are counted once, and (id, source, size, hash) is kept in the shared folder,
rows that repeat all four as one with their number; `draw` needs nothing else. Only `systematic_copies` and `mix`, which
return whole rows, read the texts again and shuffle each once. Targets are windows over the table of sources, one row
for each source, in one task.

Cases: a null text has no words and its copies take none; a null source is a source of its own, ordered last; no
documents give no rows. Rows that repeat an id are sampled independently. Reruns agree: order and offset come from
hashes of the content and the seed. Extra columns pass through untouched unless they bear the name of an output column,
which then replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

#: Hash slices of each size class of a source; bounds the share of a hot source in one window task.
SLICES = 256

#: Size classes for each doubling of size.
CLASSES = 32


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, target. sized has the columns source and size."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn("_i", F.row_number().over(everything)).withColumn(
        "_w", F.element_at(cycle, ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    )
    full = F.col("source_size") * F.lit(float(cap))
    by_fill = Window.orderBy(full / F.col("_w"), "_i")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    # the level is that of the first source, in order of filling, which it doesn't fill
    return (
        weighted.withColumn("_level", level)
        .withColumn("_here", F.when(F.col("_level") * F.col("_w") <= full, F.col("_level")))
        .withColumn("_found", F.first("_here", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.least(full, F.coalesce("_found", F.lit(float("inf"))) * F.col("_w")).alias("target"))
    )


def _expected(cap: float) -> Column:
    """array<struct<c, start, rate>>: for each of `classes` where its prefix sum starts and what each document expects.

    A class expects the words still open over the words still to come; what it then takes is known from the boundaries
    that its documents cross, at the class's mean size.
    """
    none = F.expr("cast(array() as array<struct<c:int,start:double,rate:double>>)")
    zero = F.struct(F.col("target").alias("open"), F.col("source_size").cast("double").alias("ahead"), F.lit(0.0).alias("at"), none.alias("out"))

    def step(s: Column, k: Column) -> Column:
        rate = F.when(s["ahead"] > 0, F.least(F.lit(cap), F.greatest(F.lit(0.0), s["open"] / s["ahead"]))).otherwise(F.lit(0.0))
        end = s["at"] + k["n"] * rate
        copies = (F.floor(end + F.col("_offset")) - F.floor(s["at"] + F.col("_offset"))).cast("double")
        one = F.struct(k["c"].alias("c"), s["at"].alias("start"), rate.alias("rate"))
        return F.struct(
            (s["open"] - copies * k["words"] / k["n"]).alias("open"), (s["ahead"] - k["words"]).alias("ahead"), end.alias("at"), F.concat(s["out"], F.array(one)).alias("out")
        )

    return F.aggregate("classes", zero, step, lambda s: s["out"])


def _placed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, slices: int) -> DataFrame:
    """docs with size, _key (the source, never null), _class, _tie and _slice."""
    return (
        docs.withColumn("size", word_count(F.col(text_col)))
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")))
        .withColumn("_class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES).cast("int"))
        .withColumn("_tie", F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)))
        .withColumn("_slice", F.pmod("_tie", F.lit(slices)).cast("int"))
    )


CELL = ["_key", "_class", "_slice"]


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, slices: int) -> DataFrame:
    """id, source, size and place of all rows, those that agree in all of it as one row with their number _n."""
    placed = _placed(docs, seed, id_col, text_col, source_col, slices)
    slim = placed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size", "_tie", *CELL)
    return Workspace(docs.sparkSession).keep(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("_n")), "sized")


def _starts(sized: DataFrame, weights: tuple[float, ...], cap: float, seed: int) -> DataFrame:
    """For each cell of source, class and slice: where it starts in its class, and what its class expects."""
    cells = sized.groupBy("source", *CELL).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("size")).alias("size"))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    targets = source_targets(cells.select("source", "size"), weights, cap)
    by_class = cells.groupBy("source", "_class").agg(F.sum("_n").alias("n"), F.sum("size").alias("words"))
    largest_first = F.array_sort(F.collect_list(F.struct((-F.col("_class")).alias("c"), F.col("n").cast("double").alias("n"), F.col("words").cast("double").alias("words"))))
    expectations = (
        by_class.groupBy("source").agg(largest_first.alias("classes"))
        .withColumn("_offset", offset)
        .join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
        .select("source", "_offset", "source_size", "target", F.explode(_expected(float(cap))).alias("e"))
        .select(F.col("source").alias("_s"), "_offset", "source_size", "target", (-F.col("e.c")).alias("_k"), F.col("e.start").alias("_start"), F.col("e.rate").alias("_rate"))
    )
    earlier = Window.partitionBy("_key", "_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(expectations, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k")))
        .select(*CELL, "_before", "_start", "_rate", "_offset", "source_size", "target")
    )


def _copies(place: Column, cap: float) -> Column:
    """Integer boundaries that the document at a place (from 1) of its class crosses."""
    reached = lambda x: F.floor(F.col("_start") + x * F.col("_rate") + F.col("_offset"))
    return F.least(F.lit(math.ceil(cap)), reached(place) - reached(place - 1)).cast("long")


def draw(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    slices: int = SLICES,
) -> DataFrame:
    """id, source, size, source_size, target, copies and taken (copies x size), one row for each row of docs."""
    sized = _sized(docs, seed, id_col, text_col, source_col, slices)
    earlier = Window.partitionBy(*CELL).orderBy("size", "_tie", "id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.withColumn("_row", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    each = numbered.join(_starts(sized, weights, cap, seed), CELL).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return (
        each.withColumn("copies", _copies(F.col("_before") + F.col("_row") + F.col("_i"), cap))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")
    )


def systematic_copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    slices: int = SLICES,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies x size); documents with no copies included."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    columns = (seed, id_col, text_col, source_col, slices)
    starts = _starts(_sized(docs, *columns), weights, cap, seed)
    order = Window.partitionBy(*CELL).orderBy("size", "_tie", id_col)
    numbered = _placed(docs, *columns).withColumn("_row", F.row_number().over(order))
    return (
        numbered.join(starts, CELL)
        .withColumn("copies", _copies(F.col("_before") + F.col("_row"), cap))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*CELL, "_tie", "_row", "_before", "_start", "_offset", "_rate")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it was drawn."""
    drawn = systematic_copies(docs, **options)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return drawn.where("copies > 0").withColumn("_copy", copies).select(*docs.columns)
