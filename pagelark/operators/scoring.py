"""Rule score of a task's risks. Only verified risks count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import score_level

WEAK_MARKET, WEAK_MARKET_POINTS = 50, 15.0
TOP = 3


def rule_score(mean: Column, sentiment: Column) -> Column:
    """Mean score of verified risks, 0 without any, plus the weak-market points, at most 100."""
    weak = F.when(sentiment < WEAK_MARKET, F.lit(WEAK_MARKET_POINTS)).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), F.coalesce(mean, F.lit(0.0)) + weak)


def predict(risks: DataFrame, market: DataFrame, task: str = "task_id", seq: str = "seq") -> DataFrame:
    """One prediction for each task of market (task and sentiment_score, null if unknown).

    risks has task, risk_id, risk_code, score, conclusion, verification_status and an order within the task.
    """
    status = F.col("verification_status")

    def ids(state: str, field: str = "risk_id") -> Column:
        found = F.collect_list(F.when(status == state, F.struct(F.col(seq).alias("s"), F.col(field).alias("v"))))
        return F.transform(F.array_sort(found), lambda x: x["v"])

    ranked = F.collect_list(F.when(status == "verified", F.struct((-F.col("score")).alias("n"), F.col(seq).alias("s"), "risk_code", "score", "conclusion")))
    gathered = risks.groupBy(task).agg(
        F.avg(F.when(status == "verified", F.col("score"))).alias("mean"),
        F.slice(F.array_sort(ranked), 1, TOP).alias("top"),
        ids("verified").alias("used_verified_risk_ids"),
        ids("pending").alias("excluded_pending_risk_ids"),
        ids("needs_review").alias("excluded_needs_review_risk_ids"),
        ids("rejected").alias("excluded_rejected_risk_ids"),
        ids("verified", "risk_code").alias("_codes"),
    )
    none = F.expr("cast(array() as array<string>)")
    lists = ("used_verified_risk_ids", "excluded_pending_risk_ids", "excluded_needs_review_risk_ids", "excluded_rejected_risk_ids", "_codes")
    sentiment = F.col("sentiment_score")
    factor = "struct<feature_name:string,feature_value:double,contribution:double,direction:string,explanation:string,source:string>"
    from_risks = F.transform(
        F.coalesce("top", F.expr("cast(array() as array<struct<n:double,s:bigint,risk_code:string,score:double,conclusion:string>>)")),
        lambda t: F.struct(
            t["risk_code"].alias("feature_name"), t["score"].cast("double").alias("feature_value"), (t["score"] / 100).cast("double").alias("contribution"),
            F.lit("increase").alias("direction"), t["conclusion"].alias("explanation"), F.lit("verified_risk_item").alias("source"),
        ),
    )
    weak = F.struct(
        F.lit("market_sentiment_below_50").alias("feature_name"), sentiment.cast("double").alias("feature_value"), F.lit(WEAK_MARKET_POINTS / 100).alias("contribution"),
        F.lit("increase").alias("direction"), F.lit("A deterministic weak-market adjustment was applied.").alias("explanation"), F.lit("market_snapshot_rule").alias("source"),
    )
    absent = F.size("used_verified_risk_ids") == 0
    named = lambda *pairs: F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())
    out = market.join(gathered, task, "left").withColumns({c: F.coalesce(c, none) for c in lists})
    out = out.withColumn("risk_score", rule_score(F.col("mean"), sentiment)).withColumn("risk_level", score_level(F.col("risk_score")))
    return out.select(
        task,
        "risk_score",
        "risk_level",
        F.when(sentiment < WEAK_MARKET, F.concat(from_risks, F.array(weak))).otherwise(from_risks).cast(f"array<{factor}>").alias("top_factors"),
        *lists[:4],
        F.concat(F.transform("_codes", lambda c: F.concat(F.lit("verified_risk:"), c)), named((sentiment.isNotNull(), "market_sentiment_score"))).alias("available_features"),
        named((absent, "verified_risks"), (sentiment.isNull(), "market_sentiment_score")).alias("missing_features"),
        named((absent, "verified_risks_missing"), (sentiment.isNull(), "market_sentiment_score_missing")).alias("degradation_reasons"),
    ).withColumn("degraded_mode", F.size("degradation_reasons") > 0)


def report_section(risks: DataFrame, task: str = "task_id", seq: str = "seq") -> DataFrame:
    """risk_count and the evidence ids of all risks, in order, of each task."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.transform("evidence", lambda e: e["evidence_id"]).alias("e"))))
    return risks.groupBy(task).agg(F.count(F.lit(1)).alias("risk_count"), F.flatten(F.transform(ordered, lambda x: x["e"])).alias("evidence_ids"))
