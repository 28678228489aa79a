"""Agents that stand in for absent or trial components, providers of profiles and markets, and isolation of agents.

An agent is a function from the documents of a task to risk rows. What one of them does wrong must not cost the others
their rows: agents are run and kept one by one, and a failing one leaves a diagnostic row instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

Agent = Callable[[DataFrame], DataFrame]

DIAGNOSTICS = "agent_name string, status string, available boolean, reason string"
RISKS = "task_id string, risk_code string, category string, risk_type string, level string, score double, conclusion string, agent_name string, confidence double"

# The findings of trial agents, and why real ones are absent.
TRIAL = (
    ("continuous_loss", "financial", "Continuous loss", 78.0),
    ("redemption_rights", "legal", "Redemption rights", 72.0),
    ("precommercial_product", "business", "Pre-commercial core product", 66.0),
    ("weak_ipo_market", "market", "Weak IPO market", 60.0),
)
NOT_IMPLEMENTED, NOT_IMPLEMENTED_REASON = "component_not_implemented", "professional_module_not_implemented_in_v0.2"
NO_MARKET_REASON = "real_market_data_not_integrated_in_v0.2"
TRIAL_MARKET = {"hsi_return_5d": -0.04, "recent_ipo_break_rate": 0.42, "market_volatility": 0.31, "sentiment_score": 35.0}


def trial_risks(tasks: DataFrame, agent: str | None = None) -> DataFrame:
    """The fixed finding of each trial agent, or of one, for every task (column task_id)."""
    rows = [r for r in TRIAL if agent in (None, r[1])]
    found = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("risk_code", "category", "risk_type", "score"), r)]) for r in rows]))
    return tasks.select("task_id", found.alias("r")).select(
        "task_id", "r.risk_code", "r.category", "r.risk_type", F.when(F.col("r.score") >= 70, "high").otherwise("medium").alias("level"), "r.score",
        F.concat(F.lit("Mock finding: "), "r.risk_type", F.lit(".")).alias("conclusion"), F.col("r.category").alias("agent_name"), F.lit(0.8).alias("confidence"),
    )


def unavailable(tasks: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """No risks, and a diagnostic that says why: an absent agent doesn't mean that there is no risk."""
    spark = tasks.sparkSession
    return spark.createDataFrame([], RISKS), spark.createDataFrame([(agent, NOT_IMPLEMENTED, False, NOT_IMPLEMENTED_REASON)], DIAGNOSTICS)


def failing(tasks: DataFrame) -> DataFrame:
    """An agent that fails when its rows are read, for trials of the isolation."""
    kept = F.when(F.raise_error(F.lit("injected fault")).isNull(), F.lit(0.0))
    return trial_risks(tasks).withColumn("score", kept)


def isolated(tasks: DataFrame, agents: Mapping[str, Agent]) -> tuple[DataFrame, DataFrame]:
    """Risks of all agents that succeed, and a diagnostic row for each.

    Building a plan and running it can both fail, so each agent's rows are written before the next one starts.
    """
    spark, scratch = tasks.sparkSession, Workspace(tasks.sparkSession)
    risks, states = spark.createDataFrame([], RISKS), []
    for name, agent in agents.items():
        try:
            found = scratch.keep(agent(tasks).select(*[f.split()[0] for f in RISKS.split(", ")]), name)
        except Exception as error:
            states.append((name, "failed", True, str(error).splitlines()[0][:500]))
            continue
        risks = risks.unionByName(found)
        states.append((name, "completed", True, ""))
    return risks, spark.createDataFrame(states, DIAGNOSTICS)


def profiles(requests: DataFrame, trial: bool = False) -> DataFrame:
    """company_name, stock_code, industry and source of each request: what it says itself, nothing made up."""
    industry = F.lit("mock") if trial else F.lit(None).cast("string")
    return requests.select("task_id", "company_name", F.coalesce("stock_code", F.lit("")).alias("stock_code"), industry.alias("industry"), F.lit("mock" if trial else "request").alias("source"))


def snapshots(requests: DataFrame, market: DataFrame | None = None, trial: bool = False) -> DataFrame:
    """A market snapshot for each request by stock_code; without one the values are null and `reason` says why."""
    kinds = {k: F.lit(v) if trial else F.lit(None).cast("double") for k, v in TRIAL_MARKET.items()}
    if trial or market is None:
        out = requests.select("task_id", *[v.alias(k) for k, v in kinds.items()])
        there: Column = F.lit(trial)
    else:
        side = market.select("stock_code", *TRIAL_MARKET, F.lit(True).alias("_there"))
        out = requests.select("task_id", "stock_code").join(side, "stock_code", "left")
        there = F.coalesce("_there", F.lit(False))
    source = F.when(there, "mock" if trial else "market").otherwise("unavailable")
    return out.select("task_id", *TRIAL_MARKET, source.alias("source"), there.alias("available"), F.when(~there, NO_MARKET_REASON).alias("reason"))
