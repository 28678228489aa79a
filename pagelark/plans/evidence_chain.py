"""Pages to verified, scored risks: the chain of the financial agent over any number of documents at once.

Each stage's outcome is kept in the shared folder before the next one reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from ..operators import extraction, merge, retrieval, risks, scoring, verify

CASH_QUERY = "現金流量表期末現金及現金等價物"
FLOW_QUERY = "經營活動所用現金淨額"
EVIDENCE_ROWS = 5


@dataclass(frozen=True)
class Chain:
    """What the stages give."""

    evidence: DataFrame
    metrics: DataFrame
    built: DataFrame
    statuses: DataFrame
    risks: DataFrame


def metrics_of(chunks: DataFrame, cash_query: str = CASH_QUERY, flow_query: str = FLOW_QUERY, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """evidence rows of both queries and one metric row for each document and metric."""
    work = work or Workspace(chunks.sparkSession)
    # dealt by document at once, so that the windows over a document's pages need no shuffle of their own
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = work.keep(retrieval.prepare(chunks.repartition(parts, "document_id")), "prepared")
    evidence = work.keep(retrieval.search_many(prepared, {extraction.CASH: cash_query, extraction.FLOW: flow_query}, EVIDENCE_ROWS), "evidence")
    # only pages with evidence and those beside them are ever read
    near = evidence.select("document_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    pages = work.keep(extraction.prepare_pages(prepared.select(*chunks.columns).join(near, ["document_id", "page"], "left_semi")), "pages")
    both = lambda make: make(extraction.CASH).unionByName(make(extraction.FLOW))
    candidates = work.keep(both(lambda name: extraction.candidates(evidence.where(F.col("query_id") == name), pages, name).withColumn("_metric", F.lit(name))), "candidates")
    work.drop(pages)
    chosen = lambda name: extraction.select(candidates.where(F.col("_metric") == name).drop("_metric"), prepared, name)
    metrics = work.keep(both(chosen), "metrics")
    work.drop(candidates, prepared)
    return evidence, metrics


def runway_chain(chunks: DataFrame, **queries: str) -> Chain:
    """Retrieve, extract, build, verify."""
    work = Workspace(chunks.sparkSession)
    evidence, metrics = metrics_of(chunks, work=work, **queries)
    built = work.keep(risks.build(metrics, evidence), "built")
    verified = work.keep(verify.verify_runway(built.where("build_status = 'built'").select("document_id", "risk.*")), "verified")
    hits = evidence.groupBy("document_id").agg(
        F.count_if(F.col("query_id") == extraction.CASH).alias("n_cash"), F.count_if(F.col("query_id") == extraction.FLOW).alias("n_flow")
    )
    states = metrics.groupBy("document_id").agg(
        F.max(F.when(F.col("metric_name") == extraction.CASH, F.col("status"))).alias("cash_status"),
        F.max(F.when(F.col("metric_name") == extraction.FLOW, F.col("status"))).alias("flow_status"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    statuses = (
        states.join(hits, "document_id", "left")
        .join(built.select("document_id", "build_status"), "document_id", "left")
        .select("document_id", risks.agent_status(zero("n_cash"), zero("n_flow"), F.col("cash_status"), F.col("flow_status"), F.col("build_status")).alias("agent_status"))
    )
    return Chain(evidence, metrics, built, statuses, verified)


def scored(verified: DataFrame, market: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged risks and the prediction of each document; market has task_id and sentiment_score.

    The document is the task. Only verified rows are merged; what waits for review is passed to the prediction beside them.
    """
    rows = verified.withColumn("task_id", F.col("document_id")).withColumn("seq", F.lit(0).cast("long"))
    predictions = scoring.predict(rows.select("task_id", "risk_id", "risk_code", "score", "conclusion", "verification_status", "seq"), market)
    merged = merge.first_best(rows.where("verification_status = 'verified'"), ["task_id", "risk_code", "category"], "score", ["risk_id"], ["risk_id", "level", "score", "conclusion", "evidence"])
    return merged, predictions
