"""Running sums over rows in a global order, without a task that sees all rows or all rows of a group.

The rows are range-partitioned by the order and sorted within their partitions; one pass over each partition adds up what
it has and the outcome is written. What a partition must add from those before it is one row for each partition, a table
whose size is bounded by the number of partitions; it is computed from the last row of each and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace


def _accumulated(group: str | None, adds: list[str], xors: list[str]):
    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, carry, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield held
            keys = batch[group].to_numpy() if group else np.zeros(len(batch), np.int64)
            starts = np.concatenate(([True], keys[1:] != keys[:-1]))
            at = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            more = carry is not None and carry[0] == keys[0]
            out = {}
            for name in adds + xors:
                x = batch[name].to_numpy(np.int64)
                total = np.cumsum(x) if name in adds else np.bitwise_xor.accumulate(x)
                # what stood before the group's first row is taken off again
                total = total - (total - x)[at] if name in adds else total ^ (total ^ x)[at]
                if more:
                    of = at == 0
                    total = np.where(of, total + carry[1][name] if name in adds else total ^ carry[1][name], total)
                out["run_" + name] = total
            first = keys[0] if first is None else first
            carry = (keys[-1], {name: out["run_" + name][-1] for name in adds + xors})
            held = batch.assign(**out, part=part, last=False, whole=bool(first == keys[-1]))
        if held is not None:
            held.iloc[-1, held.columns.get_loc("last")] = True
            yield held

    return accumulate


def scan(df: DataFrame, order: list[Column | str], scratch: Workspace, group: str | None = None, adds: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """df with run_x for each column x of adds and xors, the sum (or exclusive or) up to and with the row, within its
    group if one is named; and the table that it reads, for dropping. The order must begin with the group."""
    spark, both = df.sparkSession, [*adds, *xors]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"run_{x} long" for x in both] + ["part int", "last boolean", "whole boolean"])
    kept = scratch.keep(spread.mapInPandas(_accumulated(group, list(adds), list(xors)), schema), "scan")
    key = F.col(group) if group else F.lit(0).cast("long")
    ends = {r["part"]: r for r in kept.where("last").select("part", "whole", key.alias("key"), *[f"run_{x}" for x in both]).collect()}  # one row a partition
    before, rows = None, []
    for part in sorted(ends):
        end = ends[part]
        rows.append((part, *(before or (None, *[0] * len(both)))))
        mine = [end[f"run_{x}"] for x in both]
        if before and end["whole"] and before[0] == end["key"]:
            mine = [a + b if x in adds else a ^ b for x, a, b in zip(both, before[1:], mine)]
        before = (end["key"], *mine)
    kind = kept.schema[group].dataType.simpleString() if group else "long"
    carried = spark.createDataFrame(rows, f"part int, _key {kind}, " + ", ".join(f"_{x} long" for x in both))
    joined = kept.join(F.broadcast(carried), "part")
    same = F.coalesce(F.col("_key") == key, F.lit(False))
    more = {x: F.when(same, F.col(f"_{x}")).otherwise(F.lit(0)) for x in both}
    runs = [(F.col(f"run_{x}") + more[x] if x in adds else F.col(f"run_{x}").bitwiseXOR(more[x])).alias(f"run_{x}") for x in both]
    return joined.select(*df.columns, *runs), kept
