"""Stages by name, with errors and logs as rows.

A stage is a function from the state's DataFrames to more of them. Its outcome is kept in the shared folder before the
next one starts; a stage that fails leaves its fallback and an error row, and the rest goes on. A stage that can be run on
some of its tasks is run so where it fails, and then only the tasks that fail it lose their rows. What a stage says of single
documents (an error code on a page, an issue on a metric) stays in its rows and fails nothing; what it says of single tasks
it returns as `failures`, which join the errors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.isolation import FAILURES, bisected, told
from ..sources.scratch import Workspace

ERRORS = FAILURES
LOGS = "task_id string, step int, stage string, status string"


class ConfigurationError(ValueError):
    """An unknown component."""


class Stage(Protocol):
    def __call__(self, state: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]: ...


class Registry:
    """Factories by (kind, name)."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Callable[..., object]] = {}

    def register(self, kind: str, name: str, factory: Callable[..., object]) -> None:
        self._made[kind, name] = factory

    def create(self, kind: str, name: str, **options):
        if (kind, name) not in self._made:
            raise ConfigurationError(f"unknown {kind}: {name}")
        return self._made[kind, name](**options)

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._made if k == kind)


@dataclass(frozen=True)
class Step:
    name: str
    run: Stage
    #: What stands in for the outcome of a stage that fails, given as frames or made from the state before it.
    fallback: Mapping[str, DataFrame] | Stage = field(default_factory=dict)
    recoverable: bool = True
    #: The tasks (task_id) of a state, and the state of some of them: with both, a failing stage is run task by task.
    tasks: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    only: Callable[[Mapping[str, DataFrame], DataFrame], Mapping[str, DataFrame]] | None = None


@dataclass(frozen=True)
class Outcome:
    state: Mapping[str, DataFrame]
    status: str  # completed, partial or failed
    errors: DataFrame
    logs: DataFrame


def run(spark: SparkSession, task_id: str, steps: Sequence[Step], state: Mapping[str, DataFrame]) -> Outcome:
    """Run the steps in order. completed without errors, failed after one that can't be recovered, else partial."""
    work, now = Workspace(spark), dict(state)
    errors, logs, status, failures = [], [], "completed", []

    def taken(step: Step, made: Mapping[str, DataFrame]) -> None:
        now.update({name: df for name, df in made.items() if name != "failures"})
        if "failures" in made and not made["failures"].isEmpty():
            failures.append(made["failures"].select(*[f.split()[0] for f in FAILURES.split(", ")]))

    for number, step in enumerate(steps, 1):
        before = len(failures) + len(errors)
        try:
            taken(step, {name: work.keep(df, f"{step.name}-{name}") for name, df in step.run(now).items()})
        except Exception as e:  # a stage may fail in any way its code or its data allow
            lost = None
            if step.tasks and step.only:
                try:
                    made, lost = bisected(step.tasks(now), lambda some, step=step: step.run({**now, **step.only(now, some)}), step.name, work)
                    taken(step, made)
                    errors += lost
                except Exception:
                    lost = None  # it fails without any task as well
            if not lost:
                errors.append((task_id, step.name, f"{step.name}_failure", told(e), step.recoverable))
                now |= step.fallback(now) if callable(step.fallback) else step.fallback
                logs.append((task_id, number, step.name, "failed"))
                status = "partial"
                if not step.recoverable:
                    status = "failed"
                    break
                continue
        clean = len(failures) + len(errors) == before
        logs.append((task_id, number, step.name, "success" if clean else "partial"))
        status = status if clean else "partial"
    rows = spark.createDataFrame(errors, ERRORS)
    for some in failures:
        rows = rows.unionByName(some)
    return Outcome(now, status, rows, spark.createDataFrame(logs, LOGS))


def task_states(tasks: DataFrame, outcome: Outcome, run_id: str) -> DataFrame:
    """task_id, status and errors (codes, sorted) of each task: failed with an error that can't be recovered, partial with
    others, its own or the run's, else completed."""
    of_run = [r for r in outcome.errors.where(F.col("task_id") == run_id).select("error_code", "recoverable").distinct().collect()]  # one a stage at most
    common = F.array(*[F.lit(r["error_code"]) for r in of_run]).cast("array<string>")
    fatal = any(not r["recoverable"] for r in of_run)
    own = outcome.errors.where(F.col("task_id") != run_id).groupBy("task_id").agg(F.collect_set("error_code").alias("_codes"), F.max(~F.col("recoverable")).alias("_fatal"))
    codes = F.array_sort(F.array_union(F.coalesce("_codes", F.array().cast("array<string>")), common))
    failed = F.coalesce("_fatal", F.lit(False)) | F.lit(fatal)
    status = F.when(failed, "failed").when(F.size(codes) > 0, "partial").otherwise("completed")
    return tasks.select("task_id").join(own, "task_id", "left").select("task_id", status.alias("status"), codes.alias("errors"))
