"""Cash-runway risks from extracted metrics, and the requirements of every risk code.

A document with two sound metrics and a negative flow gets a risk row; others get the issues that stand against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.policy import FORMULA, PERIOD_MONTHS, monthly_burn, runway_level, runway_months
from .extraction import CASH, FLOW

# Owner, whether evidence and a calculation are required, and whether the code is evaluated.
REQUIREMENTS = (
    ("cash_runway", "financial", True, True, True),
    ("continuous_loss", "financial", True, False, True),
    ("revenue_growth", "financial", True, True, True),
    ("customer_concentration", "financial", True, True, True),
    ("supplier_concentration", "financial", True, True, True),
    ("redemption_rights", "legal", True, False, True),
    ("material_litigation_compliance", "legal", True, False, True),
    ("precommercial_product", "business", True, False, True),
    ("weak_ipo_market", None, True, False, False),
)
ENABLED = tuple(code for code, *_, enabled in REQUIREMENTS if enabled)
SKILL, SKILL_VERSION, POLICY, CANONICAL = "cash_runway", "1.1", "cash_runway_rule_v1", "FIN_CASH_RUNWAY"


def requirements(spark: SparkSession) -> DataFrame:
    """risk_code, owner, requires_evidence, requires_calculation, enabled."""
    return spark.createDataFrame(list(REQUIREMENTS), "risk_code string, owner string, requires_evidence boolean, requires_calculation boolean, enabled boolean")


def with_requirements(risks: DataFrame) -> DataFrame:
    """risks with owner and requirements; an unknown code requires evidence only."""
    known = requirements(risks.sparkSession).drop("enabled")
    return risks.join(known, "risk_code", "left").withColumns(
        {"requires_evidence": F.coalesce("requires_evidence", F.lit(True)), "requires_calculation": F.coalesce("requires_calculation", F.lit(False))}
    )


def written(x: Column) -> Column:
    """A decimal without trailing zeros."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def issue_list(*pairs: tuple[str | Column, Column]) -> Column:
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(i) if isinstance(i, str) else i) for i, bad in pairs]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def _metric_issues() -> Column:
    c, f = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"f.{n}"))
    either = lambda n: c(n).isNull() | f(n).isNull()
    differ = lambda n: ~either(n) & (c(n) != f(n))
    blank = lambda x: x.isNull() | (x == "")
    return issue_list(
        ("cash_metric_name_invalid", c("metric_name") != CASH),
        ("operating_cash_flow_metric_name_invalid", f("metric_name") != FLOW),
        ("cash_status_not_extracted", c("status") != "extracted"),
        ("operating_cash_flow_status_not_extracted", f("status") != "extracted"),
        ("cash_extraction_has_issues", F.size(c("issues")) > 0),
        ("operating_cash_flow_extraction_has_issues", F.size(f("issues")) > 0),
        ("cash_value_missing", c("normalized_value").isNull()),
        ("cash_value_negative", c("normalized_value") < 0),
        ("operating_cash_flow_value_missing", f("normalized_value").isNull()),
        ("operating_cash_flow_period_months_invalid", f("period_months").isNull() | ~f("period_months").isin(*PERIOD_MONTHS)),
        ("cash_period_months_should_be_none", c("period_months").isNotNull()),
        ("source_document_missing", blank(c("document_id")) | blank(f("document_id"))),
        ("source_document_mismatch", ~blank(c("document_id")) & ~blank(f("document_id")) & (c("document_id") != f("document_id"))),
        ("currency_missing", either("currency")),
        ("currency_mismatch", differ("currency")),
        ("unit_missing", either("unit")),
        ("unit_mismatch", differ("unit")),
        ("period_end_missing", either("period_end")),
        ("period_end_mismatch", differ("period_end")),
        ("cash_evidence_id_missing", blank(c("evidence_id"))),
        ("operating_cash_flow_evidence_id_missing", blank(f("evidence_id"))),
    )


def _evidence_issues(label: str, metric: str, evidence: str) -> Column:
    m, e = (lambda n: F.col(f"{metric}.{n}")), (lambda n: F.col(f"{evidence}.{n}"))
    asked = m("evidence_id").isNotNull() & (m("evidence_id") != "")
    there = asked & F.col(evidence).isNotNull()
    fields = ("document_id", "chunk_id", "page")
    wrong = {n: there & ~e(n).eqNullSafe(m(n)) for n in fields}
    clean = there
    for bad in wrong.values():
        clean = clean & ~bad
    return issue_list(
        (f"{label}_evidence_not_found", asked & F.col(evidence).isNull()),
        *[(f"{label}_evidence_{n}_mismatch", bad) for n, bad in wrong.items()],
        ("evidence_source_type_invalid", clean & ~e("source_type").eqNullSafe("prospectus")),
    )


def build(metrics: DataFrame, evidence: DataFrame) -> DataFrame:
    """document_id, build_status, issues and risk of each document with both metrics.

    metrics has one row for each document and metric_name; evidence one for each evidence_id. build_status is built,
    needs_review or not_applicable; only built rows have a risk.
    """
    each = lambda name, alias: metrics.where(F.col("metric_name") == name).select("document_id", F.struct(*metrics.columns).alias(alias))
    known = ["evidence_id", "document_id", "chunk_id", "page", "text", "source_type", "relevance_score"]
    by_id = evidence.select(*known).dropDuplicates(["evidence_id"])
    side = lambda alias: by_id.select(F.col("evidence_id").alias(f"_{alias}"), F.struct(*known).alias(alias))
    paired = (
        each(CASH, "c")
        .join(each(FLOW, "f"), "document_id")
        .join(side("ce"), F.col("c.evidence_id") == F.col("_ce"), "left")
        .join(side("fe"), F.col("f.evidence_id") == F.col("_fe"), "left")
    )
    apart = F.col("ce").isNotNull() & F.col("fe").isNotNull() & (F.col("ce.document_id") != F.col("fe.document_id"))
    gate = F.array_distinct(
        F.concat(
            _metric_issues(),
            _evidence_issues("cash", "c", "ce"),
            _evidence_issues("operating_cash_flow", "f", "fe"),
            issue_list(("evidence_document_mismatch", apart)),
        )
    )
    cash, flow, months = F.col("c.normalized_value"), F.col("f.normalized_value"), F.col("f.period_months")
    rounded = runway_months(cash, flow, months)
    burn = monthly_burn(flow, months)
    level = runway_level(cash, flow, months)
    amounts = lambda x: F.concat_ws(" ", written(x), F.col("c.currency"), F.col("c.unit"))
    # fixed values: the words of the conclusion
    conclusion = F.concat(
        F.lit("Based on reported cash of "), amounts(cash), F.lit(" and "), months.cast("string"), F.lit("-month operating cash outflow of "), amounts(F.abs(flow)),
        F.lit(", the estimated cash runway is approximately "), rounded.cast("string"),
        F.lit(" months. This is a deterministic rule calculation, not a probability of post-listing price decline."),
    )
    inputs = F.create_map(
        *[
            x
            for k, v in {
                "cash": written(cash), "operating_cash_flow": written(flow), "period_months": months.cast("string"), "monthly_burn": written(burn), "currency": F.col("c.currency"),
                "source_unit": F.col("c.unit"), "cash_period_end": F.col("c.period_end").cast("string"), "operating_cash_flow_period_end": F.col("f.period_end").cast("string"),
            }.items()
            for x in (F.lit(k), v)
        ]
    )
    ids = F.array("c.evidence_id", "f.evidence_id")
    metadata = F.create_map(
        *[
            x
            for k, v in {
                "canonical_code": F.lit(CANONICAL), "policy_version": F.lit(POLICY), "score_is_rule_based": F.lit("true"), "score_is_probability": F.lit("false"),
                "runway_months_rounded": rounded.cast("string"), "monthly_burn": written(burn), "currency": F.col("c.currency"), "source_unit": F.col("c.unit"),
                "period_months": months.cast("string"), "cash_extraction_method": F.col("c.extraction_method"), "operating_cash_flow_extraction_method": F.col("f.extraction_method"),
            }.items()
            for x in (F.lit(k), v)
        ]
    )
    risk = F.struct(
        uuid5(F.concat(F.lit("cash-runway:"), F.concat_ws(":", "c.evidence_id", "f.evidence_id", written(cash), written(flow), months.cast("string")))).alias("risk_id"),
        F.lit("cash_runway").alias("risk_code"), F.lit("financial").alias("category"), F.lit("Insufficient cash runway").alias("risk_type"),
        level["level"].alias("level"), level["score"].cast("double").alias("score"), conclusion.alias("conclusion"), F.array("ce", "fe").alias("evidence"),
        F.struct(
            F.lit(SKILL).alias("skill_name"), F.lit(SKILL_VERSION).alias("skill_version"), inputs.alias("inputs"), F.lit(FORMULA).alias("formula"), rounded.cast("string").alias("result"),
            F.lit("months").alias("unit"), ids.alias("evidence_ids"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
        ).alias("calculation"),
        F.lit("financial").alias("agent_name"), F.lit(0.90).alias("confidence"), F.lit("pending").alias("verification_status"), F.lit("").alias("verification_notes"), metadata.alias("metadata"),
    )
    status = F.when(F.size("gate") > 0, "needs_review").when(flow >= 0, "not_applicable").otherwise("built")
    return (
        paired.withColumn("gate", gate)
        .withColumn("build_status", status)
        .select(
            "document_id",
            "build_status",
            F.when(F.col("build_status") == "not_applicable", F.array(F.lit("operating_cash_flow_does_not_represent_cash_burn"))).otherwise(F.col("gate")).alias("issues"),
            F.when(F.col("build_status") == "built", risk).alias("risk"),
        )
    )


def agent_status(retrieved_cash: Column, retrieved_flow: Column, cash_status: Column, flow_status: Column, build_status: Column) -> Column:
    """Outcome of the financial agent for a document, from what each of its steps gave."""
    return (
        F.when((retrieved_cash == 0) | (retrieved_flow == 0), "retriever_no_result")
        .when((cash_status != "extracted") | (flow_status != "extracted"), "extraction_needs_review")
        .when(build_status.isNull(), "component_failure")
        .when(build_status == "not_applicable", "not_applicable")
        .when(build_status != "built", "builder_needs_review")
        .otherwise("built")
    )


# Contract rules: the reference only freezes their thresholds; they are evaluated here from candidate tables.
def loss_runs(periods: DataFrame, entity: str, period: str, result: str) -> DataFrame:
    """The longest run of consecutive periods with a loss of each entity: gaps and islands on the period number."""
    from pyspark.sql import Window

    losses = periods.where(F.col(result) < 0)
    island = F.col(period) - F.row_number().over(Window.partitionBy(entity).orderBy(period))
    runs = losses.withColumn("_island", island).groupBy(entity, "_island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(entity).agg(F.max("n").alias("loss_periods"))


def growth(periods: DataFrame, entity: list[str], period: str, value: str) -> DataFrame:
    """periods with previous value (of the period before, exactly) and growth_pct."""
    from pyspark.sql import Window

    w = Window.partitionBy(*entity).orderBy(period)
    gap = F.col(period) - F.lag(period).over(w)
    previous = F.when(gap == 1, F.lag(value).over(w))
    return periods.withColumn("previous", previous).withColumn("growth_pct", F.when(F.col("previous") > 0, (F.col(value) / F.col("previous") - 1) * 100))


def concentration(sales: DataFrame, entity: str, partner: str, value: str) -> DataFrame:
    """largest_pct and top_five_pct of each entity's partners."""
    from pyspark.sql import Window

    totals = sales.groupBy(entity, partner).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(entity).orderBy(F.desc("_v"), partner)
    whole = totals.groupBy(entity).agg(F.sum("_v").alias("_all"))
    top = totals.withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    shares = top.groupBy(entity).agg(F.max("_v").alias("_first"), F.sum("_v").alias("_five")).join(whole, entity)
    pct = lambda part: F.when(F.col("_all") > 0, F.try_divide(F.col(part) * 100, F.col("_all")))
    return shares.select(entity, pct("_first").alias("largest_pct"), pct("_five").alias("top_five_pct"))
