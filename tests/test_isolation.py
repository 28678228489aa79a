"""Faults of single requests cost the rows of these requests only."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pagelark.operators import agents, isolation
from pagelark.plans import analysis, checks, pipeline
from pagelark.sources.scratch import Workspace

ROW = "task_id string, n int, words array<string>"


def test_guarded_rows_and_errors(spark):
    requests = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "0"), (None, "5"), ("e", "-1")], "task_id string, code string")

    def agent(request):
        n = int(request["code"]) if request["code"] is not None else 0
        if n < 0:
            return [{"task_id": request["task_id"], "unknown": 1}]
        return [{"task_id": request["task_id"], "n": 10 // n if n else None, "words": ["w"] * n} for _ in range(n)]

    outcome = isolation.guarded(requests.repartition(3), agent, ROW)
    rows, lost = isolation.parted(outcome, "legal_agent")
    assert sorted((str(r.task_id), r.n, len(r.words)) for r in rows.collect()) == [("None", 2, 5)] * 5 + [("a", 10, 1)]
    assert {r.task_id: (r.error_code, r.message.split(":")[0], r.recoverable) for r in lost.collect()} == {"b": ("legal_agent_failure", "ValueError", True), "e": ("legal_agent_failure", "KeyError", True)}
    assert outcome.count() == 6
    assert isolation.guarded(requests.limit(0), agent, ROW).count() == 0


def _poisoned(bad):
    """A plan over tasks that fails at run time on some of them."""

    def plan(tasks):
        hurt = F.when(F.col("task_id").isin(*bad) | F.col("task_id").isNull(), F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.lit(1.0))
        return {"risks": agents.trial_risks(tasks, "legal").withColumn("score", hurt)}

    return plan


def test_bisecting_finds_the_poisoned_tasks(spark):
    tasks = spark.createDataFrame([(str(i),) for i in [*range(300), 5, 5]] + [(None,)], "task_id string")
    found, lost = isolation.bisected(tasks, _poisoned(["5", "77", "200"]), "legal", Workspace(spark))
    assert sorted((str(x[0]), *x[1:3]) for x in lost) == [(i, "legal", "legal_failure") for i in ("200", "5", "77", "None")] and all("bad row" in x[3] for x in lost)
    assert {r.task_id for r in found["risks"].collect()} == {str(i) for i in range(300)} - {"5", "77", "200"}


def test_hopeless_plans_fail_as_a_whole(spark):
    tasks = spark.range(2000).select(F.col("id").cast("string").alias("task_id"))
    with pytest.raises(Exception, match="injected fault"):
        isolation.bisected(tasks, lambda t: {"risks": agents.failing(t)}, "legal", Workspace(spark))
    with pytest.raises(AnalysisException):
        isolation.bisected(tasks, lambda t: {"risks": t.select("nothing")}, "legal", Workspace(spark))
    alone = tasks.where("task_id = '1'")
    found, lost = isolation.bisected(alone, lambda t: {"risks": agents.failing(t)}, "legal", Workspace(spark))
    assert len(lost) == 1 and found["risks"].count() == 0


def test_the_chain_keeps_what_other_requests_find(spark, monkeypatch):
    """Both kinds of faults: a plan that fails on one request, and a function that fails on another."""
    monkeypatch.setitem(analysis.COMPONENTS._made, ("agent", "poisoned"), lambda agent: lambda s: analysis._plain(_poisoned(["11"])(s["profiles"])["risks"]))
    customers = spark.createDataFrame([(k, 5000.0) for k in (10, 11, 12, 13)], "c_custkey long, c_acctbal double")
    requests = customers.select(F.col("c_custkey").cast("string").alias("task_id"), F.lit("n").alias("company_name"), F.lit(None).cast("string").alias("stock_code"))
    evidence = spark.createDataFrame([], f"task_id string, risk_code string, evidence {analysis.EVIDENCE}, error string")
    one = lambda r: [{"task_id": r["task_id"], "risk_code": "x", "category": "business", "score": 1.0 / (int(r["task_id"]) - 13)}]
    steps = analysis.steps(functions={"business": one}, legal="poisoned", financial="disabled", market="disabled")
    found = pipeline.run(spark, "run", steps, {"requests": requests, "pages": checks.statement_pages(customers), "evidence": evidence})
    assert found.status == "partial"
    assert {(r.task_id, r.stage) for r in found.errors.collect()} == {("11", "legal_agent"), ("13", "business_agent")}
    assert {r.stage: r.status for r in found.logs.collect() if r.status != "success"} == {"legal_agent": "partial", "business_agent": "partial"}
    kept = {(r.task_id, r.category) for r in found.state["verified"].collect()}
    assert kept == {(t, "legal") for t in ("10", "12", "13")} | {(t, "business") for t in ("10", "11", "12")}
    states = {r.task_id: (r.status, r.errors) for r in pipeline.task_states(requests, found, "run").collect()}
    assert states == {"10": ("completed", []), "12": ("completed", []), "11": ("partial", ["legal_agent_failure"]), "13": ("partial", ["business_agent_failure"])}


def test_states_of_a_run_that_failed(spark):
    requests = spark.createDataFrame([("a",)], "task_id string")
    lost = pipeline.run(spark, "run", [pipeline.Step("profile", lambda s: {"x": s["none"]}, recoverable=False)], {"requests": requests})
    assert [(r.status, r.errors) for r in pipeline.task_states(requests, lost, "run").collect()] == [("failed", ["profile_failure"])]
