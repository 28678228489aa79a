"""The whole analysis of any number of requests at once, from profiles to the report.

Every part is a named component; the chain runs them one after another, and a part that fails costs its own rows only: an
agent leaves no risks, the verifier leaves all of them pending, the predictor leaves no predictions. An agent that fails on
some requests loses the rows of these alone. The requests are the tasks, and a task's document bears its id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..operators import agents, isolation, merge, scoring, verify
from .evidence_chain import runway_chain
from .pipeline import Registry, Step

State = Mapping[str, DataFrame]

AGENTS = ("financial", "legal", "business", "market")
EVIDENCE = "array<struct<evidence_id:string>>"
#: Risks as the chain passes them on; own_status is what an agent's own suite of checks says, else null.
RISKS = f"task_id string, risk_id string, seq long, risk_code string, category string, level string, score double, conclusion string, evidence {EVIDENCE}, own_status string"
#: What a function of one request gives for each risk that it finds.
FINDING = "task_id string, risk_code string, category string, level string, score double, conclusion string"
PREDICTIONS = "task_id string, risk_score double, risk_level string, degraded_mode boolean"


def _trial(agent: str) -> Callable[[State], DataFrame]:
    return lambda state: _plain(agents.trial_risks(state["profiles"], agent))


def _failing(agent: str) -> Callable[[State], DataFrame]:
    return lambda state: _plain(agents.failing(state["profiles"]))


def _guarded(agent: str, function: isolation.RowAgent) -> Callable[[State], Mapping[str, DataFrame]]:
    """An agent that is a function of one request; what it raises for a request becomes a failure of that one."""

    def risks_of(state: State) -> Mapping[str, DataFrame]:
        outcome = isolation.guarded(state["requests"], function, FINDING)
        rows, lost = isolation.parted(outcome, f"{agent}_agent")
        return {f"{agent}_risks": _plain(rows), "failures": lost}

    return risks_of


def _disabled(agent: str) -> Callable[[State], DataFrame]:
    return lambda state: state["profiles"].sparkSession.createDataFrame([], RISKS).drop("seq")


def _runway(agent: str) -> Callable[[State], DataFrame]:
    """Cash-runway risks of the documents, verified by their own checks."""

    def risks_of(state: State) -> DataFrame:
        found = runway_chain(state["chunks"]).risks
        ids = F.transform("evidence", lambda e: F.struct(e["evidence_id"].alias("evidence_id")))
        return found.select(
            F.col("document_id").alias("task_id"), "risk_id", "risk_code", "category", "level", F.col("score").cast("double").alias("score"),
            "conclusion", ids.alias("evidence"), F.col("verification_status").alias("own_status"),
        )

    return risks_of


def _plain(risks: DataFrame) -> DataFrame:
    """Risks without evidence and checks of their own."""
    return risks.select(
        "task_id", uuid5(F.concat_ws("|", "task_id", "risk_code")).alias("risk_id"), "risk_code", "category", "level", "score", "conclusion",
        F.array().cast(EVIDENCE).alias("evidence"), F.lit(None).cast("string").alias("own_status"),
    )


def _rule_based(risks: DataFrame, market: DataFrame) -> DataFrame:
    return scoring.predict(risks, market).select(*[f.split()[0] for f in PREDICTIONS.split(", ")])


def _failing_prediction(risks: DataFrame, market: DataFrame) -> DataFrame:
    return _rule_based(risks, market).withColumn("risk_score", F.raise_error(F.lit("injected fault")).cast("double"))


COMPONENTS = Registry()
for _name, _agent in {"trial": _trial, "failing": _failing, "disabled": _disabled, "runway": _runway, "guarded": _guarded}.items():
    COMPONENTS.register("agent", _name, _agent)
COMPONENTS.register("predictor", "rule_based", lambda: _rule_based)
COMPONENTS.register("predictor", "failing", lambda: _failing_prediction)


def _all_risks(state: State) -> DataFrame:
    risks = None
    for place, name in enumerate(AGENTS):
        one = state[f"{name}_risks"].withColumn("seq", F.lit(place).cast("long"))
        risks = one if risks is None else risks.unionByName(one)
    return risks


def verified(state: State) -> DataFrame:
    """Risks with the evidence found for them and verification_status.

    A search that failed for one risk (an error beside its evidence rows) leaves that risk pending and no other.
    """
    evidence = state["evidence"]
    lost = evidence.where(F.col("error").isNotNull()).select("task_id", "risk_code").distinct().withColumn("_lost", F.lit(True))
    risks = verify.with_external_evidence(_all_risks(state), evidence.where(F.col("error").isNull()))
    known = verify.with_requirements(risks).join(lost, ["task_id", "risk_code"], "left")
    ladder = verify.ladder(F.size("evidence"), F.col("requires_evidence"), F.col("requires_calculation"), F.lit(False), F.col("score"))
    status = F.when(F.col("own_status").isNotNull(), F.col("own_status")).when(F.col("_lost"), "pending").otherwise(ladder)
    return known.withColumn("verification_status", status).select(*risks.columns, "verification_status")


def steps(predictor: str = "rule_based", functions: Mapping[str, isolation.RowAgent] | None = None, **kinds: str) -> list[Step]:
    """The chain; kinds names the component of each agent, a trial one by default; functions has those of guarded ones.

    It reads the frames requests (task_id, company_name, stock_code), pages (document_id, chunk_id, page, text), evidence
    (task_id, risk_code, evidence, error) and, where there is one, market.
    """
    if unknown := set(kinds) - set(AGENTS):
        raise ValueError(f"unknown agents: {sorted(unknown)}")
    options = {name: {"function": f} for name, f in (functions or {}).items()}
    made = {name: COMPONENTS.create("agent", kinds.get(name, "guarded" if name in options else "trial"), agent=name, **options.get(name, {})) for name in AGENTS}
    predict = COMPONENTS.create("predictor", predictor)
    empty = lambda schema: lambda state: state["requests"].sparkSession.createDataFrame([], schema)
    no_risks = empty(RISKS)

    def documents(state: State) -> State:
        asked = state["requests"].select(F.col("task_id").alias("document_id")).distinct()
        return {"chunks": state["pages"].join(asked, "document_id", "left_semi")}

    def agent(name: str) -> Step:
        def run(state: State) -> Mapping[str, DataFrame]:
            found = made[name](state)
            return found if isinstance(found, Mapping) else {f"{name}_risks": found}

        def only(state: State, some: DataFrame) -> State:
            documents = some.withColumnRenamed("task_id", "document_id")
            by_task = {x: state[x].join(some, "task_id", "left_semi") for x in ("profiles", "requests")}
            return {**by_task, "chunks": state["chunks"].join(documents, "document_id", "left_semi")}

        return Step(f"{name}_agent", run, lambda s: {f"{name}_risks": no_risks(s).drop("seq")}, tasks=lambda s: s["requests"], only=only)

    best = ["risk_id", "level", "score", "conclusion"]
    return [
        Step("profile", lambda s: {"profiles": agents.profiles(s["requests"])}, recoverable=False),
        Step("market", lambda s: {"snapshots": agents.snapshots(s["requests"], s.get("market"))}, lambda s: {"snapshots": agents.snapshots(s["requests"])}),
        Step("documents", documents, lambda s: {"chunks": s["pages"].limit(0)}),
        *[agent(name) for name in AGENTS],
        Step("verifier", lambda s: {"verified": verified(s)}, lambda s: {"verified": _all_risks(s).withColumn("verification_status", F.lit("pending"))}),
        Step("supervisor", lambda s: {"merged": merge.first_best(s["verified"].where("verification_status = 'verified'"), ["task_id", "risk_code", "category"], "score", ["seq", "risk_id"], best)}),
        Step("predictor", lambda s: {"predictions": predict(s["verified"], s["snapshots"])}, lambda s: {"predictions": empty(PREDICTIONS)(s)}),
        Step("report", lambda s: {"report": scoring.report_section(s["verified"])}),
    ]
