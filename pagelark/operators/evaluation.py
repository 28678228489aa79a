"""Evaluation: precision and recall, hits at k, text density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_DENSITY = 800
SCAN_SHARE = 0.8


def precision_recall(found: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """precision, recall and f1 of two sets of keys; 0 where a denominator is."""
    side = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    joined = side(found, "_f").join(side(gold, "_g"), list(keys), "full")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = joined.agg(
        F.count("_f").alias("n_found"), F.count("_g").alias("n_gold"), F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("n_hit")
    )
    p, r = ratio(F.col("n_hit"), F.col("n_found")), ratio(F.col("n_hit"), F.col("n_gold"))
    return counts.select("n_found", "n_gold", "n_hit", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def hit(gold: Column, ranked: Column, k: int) -> Column:
    """Whether one of the gold items is among the first k."""
    return F.arrays_overlap(gold, F.slice(ranked, 1, k))


def best_rank(gold: Column, ranked: Column) -> Column:
    """Best place, from 1, of a gold item; null if none is there."""
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    return F.array_min(places)


def hit_rate(rows: DataFrame, gold: str, ranked: str, k: int, applicable: str | None = None) -> DataFrame:
    """n, hits and hit_rate over the applicable rows; page lists are joined by bars."""
    pages = lambda c: F.filter(F.split(F.col(c), r"\|"), lambda x: x != "")
    used = rows.where(F.col(applicable) == "true") if applicable else rows
    hits = F.count_if(hit(pages(gold), pages(ranked), k))
    return used.agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"))


def text_density(chunks: DataFrame, pages: Column, group: str, text: str = "text") -> DataFrame:
    """Of each group: nonblank pages, share of pages without text, mean characters, and two flags.

    pages: the number of physical pages as an aggregate. Halves are rounded to even.
    """
    chars = F.length(F.col(text))
    there = F.count_if(chars > 0)
    share = F.coalesce(F.try_divide(pages - there, pages), F.lit(1.0))
    mean = F.coalesce(F.try_divide(F.sum(chars), there), F.lit(0.0))
    return (
        chunks.groupBy(group)
        .agg(there.alias("nonblank_page_count"), share.alias("_share"), mean.alias("_mean"))
        .select(
            group,
            "nonblank_page_count",
            F.bround("_share", 6).alias("empty_text_ratio"),
            F.bround("_mean", 2).alias("average_text_chars"),
            (F.col("_mean") < LOW_DENSITY).alias("low_text_density"),
            (F.col("_share") >= SCAN_SHARE).alias("suspected_scan"),
        )
    )
