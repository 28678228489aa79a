"""Merging and reducing records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_best(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each group the kept columns of its best row, the earliest of the best, and merged_count.

    min_by over (-score, order) aggregates map-side, so a hot group sends one row for each task.
    """
    place = F.struct((-F.col(score)).alias("s"), *order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, place).alias(c) for c in keep], F.count(F.lit(1)).alias("merged_count")
    )


def merge_risks(risks: DataFrame, seq: str = "seq") -> DataFrame:
    """One risk for each (risk_code, category): the first with the greatest score, with the evidence of all.

    Evidence keeps its order of encounter and the first of those with the same evidence_id.
    """
    best = first_best(risks, ["risk_code", "category"], "score", [seq], [c for c in risks.columns if c not in ("risk_code", "category", "evidence")])
    each = risks.select("risk_code", "category", F.col(seq).alias("_seq"), F.posexplode("evidence").alias("_pos", "_e"))
    firsts = each.groupBy("risk_code", "category", F.col("_e.evidence_id").alias("_id")).agg(F.min(F.struct("_seq", "_pos", "_e")).alias("_f"))
    gathered = firsts.groupBy("risk_code", "category").agg(F.transform(F.array_sort(F.collect_list("_f")), lambda f: f["_e"]).alias("evidence"))
    none = F.array().cast(risks.schema["evidence"].dataType)
    return best.join(gathered, ["risk_code", "category"], "left").withColumn("evidence", F.coalesce("evidence", none)).select(*risks.columns, "merged_count")


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, with first_seq: where the key stood first, which stays its place."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"), F.min(seq).alias("first_seq"))
        .select(key, "_r.*", "first_seq")
        .select(*df.columns, "first_seq")
    )


def merged_maps(first: Column, second: Column) -> Column:
    """Entries of both maps; those of the second win."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def log_steps(logs: DataFrame, task: str = "task_id", seq: str = "stage_seq") -> DataFrame:
    """logs with step, counted within a task."""
    return logs.withColumn("step", F.row_number().over(Window.partitionBy(task).orderBy(seq)))
