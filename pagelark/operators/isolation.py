"""Errors as values: what fails on one request costs that request's rows only.

Two kinds of code can fail on single requests. A function of one request (`guarded`) is called within a batch with each
request's errors caught beside it; its outcome is one row for each request, with rows or an error in it. A plan over all
requests (`bisected`) can't say which one failed it: Spark ends the job. It is run again on groups of the requests, split
by a hash until the ones that fail are alone; all others keep their rows. With p failing ones among n that takes at most
about p x FAN x log(n) / log(FAN) further jobs over ever fewer requests, and none where nothing fails. A plan that can't even be
analysed, or that fails on HOPELESS groups before it runs on any, or on PATIENCE groups in all, fails as a whole: then its
fault isn't that of a few requests, and the caller has to stand in for the stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

#: Rows of one request from its columns.
RowAgent = Callable[[dict], Iterable[Mapping]]
#: The outcome frames of a group of requests.
Plan = Callable[[DataFrame], Mapping[str, DataFrame]]

FAILURES = "task_id string, stage string, error_code string, message string, recoverable boolean"

#: Groups into which requests are split where a plan fails.
FAN = 8
HOPELESS = 12
PATIENCE = 200


def told(error: BaseException) -> str:
    """The first line of an error, after the name of its kind."""
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"[:500]


def guarded(requests: DataFrame, agent: RowAgent, schema: str) -> DataFrame:
    """task_id, rows (null where the agent failed) and error (null where it didn't) of each request.

    schema: names and types of a row's fields; what a row lacks is null. A row that doesn't fit fails its request. An agent
    that ends its whole process can't be caught: Spark runs the task again and then fails the job.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for request in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                try:
                    rows = [dict(r) for r in agent(request)]
                    if odd := {k for r in rows for k in r} - set(names):
                        raise KeyError(f"unknown fields: {sorted(odd)}")
                    out.append((request["task_id"], [{n: r.get(n) for n in names} for r in rows], None))
                except Exception as error:  # whatever the agent's code raises
                    out.append((request["task_id"], None, told(error)))
            yield pd.DataFrame(out, columns=["task_id", "rows", "error"]).astype(object)

    fields = ", ".join(":".join(f.split(" ", 1)) for f in schema.split(", "))
    return requests.mapInPandas(called, f"task_id string, rows array<struct<{fields}>>, error string")


def parted(outcome: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all requests that went well, and FAILURES of the others."""
    rows = outcome.where("error IS NULL").select(F.inline("rows"))
    lost = outcome.where("error IS NOT NULL").select("task_id", F.lit(stage).alias("stage"), F.lit(f"{stage}_failure").alias("error_code"), F.col("error").alias("message"), F.lit(True).alias("recoverable"))
    return rows, lost


def bisected(tasks: DataFrame, plan: Plan, stage: str, work: Workspace) -> tuple[dict[str, DataFrame], list[tuple]]:
    """The plan's frames over all tasks (task_id) on which it runs, kept, and FAILURES rows of those on which it doesn't.

    Tasks that share an id are one. A null id is a task of its own.
    """
    spark = tasks.sparkSession
    ids = work.keep(tasks.select("task_id").distinct(), f"{stage}-tasks")
    key = F.coalesce("task_id", F.lit("\u0000"))
    found: dict[str, DataFrame] = {}
    lost: list[tuple] = []
    groups, failed = [(ids, 0)], 0
    while groups:
        group, level = groups.pop()
        try:
            made = {name: work.keep(df, f"{stage}-{name}") for name, df in plan(group).items()}
        except AnalysisException:
            raise
        except Exception as error:  # the plan may fail in any way its code or its data allow
            failed += 1
            if failed >= PATIENCE or (failed >= HOPELESS and not found):
                raise
            first = group.select("task_id").limit(2).collect()
            if len(first) == 1:
                lost.append((first[0]["task_id"], stage, f"{stage}_failure", told(error), True))
                continue
            digit = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(FAN)).cast("int")
            there = sorted(r[0] for r in group.select(digit.alias("d")).distinct().collect())  # FAN numbers at most
            groups += [(group.where(digit == d), level + 1) for d in there]
            continue
        for name, df in made.items():
            found[name] = found[name].unionByName(df) if name in found else df
    if not found:
        # every task failed; the plan of none tells what its frames look like
        found = {name: spark.createDataFrame([], df.schema) for name, df in plan(ids.limit(0)).items()}
    return found, lost
