"""Independent verification of risk rows.

Checks are an array of (name, passed, issue) in a fixed order: issues and the bucket follow from it, and nothing raises.
The bucket is verified, pending, needs_review or rejected; what consumers call pending holds pending and needs_review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import decimal_of, states_amount
from ..functions.policy import FORMULA, PERIOD_MONTHS, monthly_burn, runway_level, runway_months
from ..functions.text import one_spaced, stripped
from .risks import CANONICAL, POLICY, SKILL, SKILL_VERSION, with_requirements, written

INPUTS = ("cash", "operating_cash_flow", "period_months", "monthly_burn", "currency", "source_unit", "cash_period_end", "operating_cash_flow_period_end")
# Claims that a conclusion must not make.
BANNED = ("必然破产", "必然下跌", "股价必跌", "will go bankrupt", "will decline", "guaranteed decline")
IMPLAUSIBLE = 95


def ladder(n_evidence: Column, requires_evidence: Column, requires_calculation: Column, calculation_ok: Column, score: Column) -> Column:
    """Bucket of a risk without a check suite of its own."""
    return (
        F.when(requires_evidence & (n_evidence == 0), "pending")
        .when(requires_calculation & ~F.coalesce(calculation_ok, F.lit(False)), "needs_review")
        .when(score > IMPLAUSIBLE, "rejected")
        .otherwise("verified")
    )


def with_external_evidence(risks: DataFrame, external: DataFrame) -> DataFrame:
    """risks with the evidence found for their code in place of their own, where there is any.

    external has task_id, risk_code and evidence, and seq where its rows have an order; risks of one code share it.
    """
    order = F.col("seq") if "seq" in external.columns else F.element_at("evidence", 1)["evidence_id"]
    found = external.where(F.size("evidence") > 0)
    gathered = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.transform("evidence", lambda e: e["evidence_id"]).alias("i"), F.col("evidence").alias("e"))))
    side = found.groupBy("task_id", "risk_code").agg(F.flatten(F.transform(gathered, lambda g: g["e"])).alias("_external"))
    joined = risks.join(side, ["task_id", "risk_code"], "left")
    return joined.withColumn("evidence", F.when(F.size("_external") > 0, F.col("_external")).otherwise(F.col("evidence"))).drop("_external")


def verify_generic(risks: DataFrame) -> DataFrame:
    """risks with verification_status of the ladder."""
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    calculation = F.col("calculation")
    ok = calculation.isNotNull() & calculation["success"] & (F.size(F.array_except(calculation["evidence_ids"], ids)) == 0)
    known = with_requirements(risks)
    status = ladder(F.size("evidence"), F.col("requires_evidence"), F.col("requires_calculation"), ok, F.col("score"))
    return known.withColumn("verification_status", status).select(*risks.columns)


def _check(name: str, passed: Column, issue: str | None, when: Column | None = None) -> tuple[str, str | None, Column]:
    """A rule: its name, what it is called where it fails, and its outcome, null where `when` doesn't hold."""
    made = F.coalesce(passed, F.lit(False))
    return name, issue, made if when is None else F.when(F.coalesce(when, F.lit(False)), made)


def _available(risks: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """risks with `available`: for each embedded evidence the known row of its id, null where there is none.

    Rows of `evidence` replace embedded ones of the same id; without them a risk's own evidence is all there is.
    """
    if evidence is None:
        return risks.withColumn("available", F.col("evidence"))
    kind = risks.schema["evidence"].dataType.elementType
    known = evidence.select(*kind.names).dropDuplicates(["evidence_id"])
    side = known.select(F.col("evidence_id").alias("_id"), F.struct(*kind.names).cast(kind).alias("_found"))
    each = risks.select("risk_id", F.posexplode("evidence").alias("_pos", "_own"))
    looked = each.join(side, F.col("_own.evidence_id") == F.col("_id"), "left")
    gathered = looked.groupBy("risk_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_found"))).alias("_a"))
    none = F.array().cast(risks.schema["evidence"].dataType)
    return risks.join(gathered, "risk_id", "left").withColumn("available", F.coalesce(F.transform("_a", lambda a: a["_found"]), none)).drop("_a")


def known_evidence(risks: DataFrame, external: DataFrame) -> DataFrame:
    """What a check may rely on: the risks' own evidence rows, with external ones in place of those of the same id."""
    kind = risks.schema["evidence"].dataType.elementType
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]
    other = external.select(*fields).dropDuplicates(["evidence_id"])
    own = risks.select(F.explode("evidence").alias("e")).select("e.*").dropDuplicates(["evidence_id"])
    return own.join(other.select("evidence_id"), "evidence_id", "left_anti").select(*kind.names).unionByName(other)


def verify_runway(risks: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """risks with checks (map), verification_issues, verification_status and verification_notes.

    evidence: all rows that are known. None means that a risk's own evidence is what it is checked against.
    """
    own, calc, meta = F.col("evidence"), F.col("calculation"), F.col("metadata")
    n = F.size(own)
    ids = F.transform(own, lambda e: e["evidence_id"])
    has_calc = calc.isNotNull()
    at = lambda array, i: F.get(array, F.lit(i))
    given = lambda name: calc["inputs"][name]
    blank = lambda x: x.isNull() | (stripped(x) == "")
    held = has_calc
    for name in INPUTS:
        held = held & F.array_contains(F.map_keys(calc["inputs"]), name)

    # inputs are parsed into columns of their own, so that no rule parses them again
    df = _available(risks, evidence).withColumns(
        {f"_{x}": decimal_of(given(x)) for x in ("cash", "operating_cash_flow", "monthly_burn")}
        | {"_months": F.trim(given("period_months")).try_cast("int"), "_complete": F.coalesce(held, F.lit(False))}
        | {f"_end{i}": given(x).try_cast("date") for i, x in enumerate(("cash_period_end", "operating_cash_flow_period_end"))}
        | {f"_spaced{i}": F.array(one_spaced(at(own, i)["text"]), one_spaced(at(F.col("available"), i)["text"])) for i in range(2)}
    )
    cash, flow, burn, months, complete = (F.col(c) for c in ("_cash", "_operating_cash_flow", "_monthly_burn", "_months", "_complete"))
    ends = [F.col("_end0"), F.col("_end1")]
    able = complete & cash.isNotNull() & flow.isNotNull() & months.isin(*PERIOD_MONTHS) & (cash >= 0) & (flow < 0)
    df = df.withColumn("_countable", F.coalesce(able, F.lit(False)))
    countable = F.col("_countable")
    # the recalculation may divide by the inputs, so it is made only where they allow it
    df = df.withColumns(
        {"_rounded": F.when(countable, runway_months(cash, flow, months)), "_burn": F.when(countable, monthly_burn(flow, months)), "_level": F.when(countable, runway_level(cash, flow, months))}
    )
    rounded, true_burn, level = F.col("_rounded"), F.col("_burn"), F.col("_level")

    checks = [
        _check("risk_code", F.col("risk_code") == "cash_runway", "risk_code_invalid"),
        _check("category", F.col("category") == "financial", "risk_category_invalid"),
        _check("canonical_code", meta["canonical_code"] == CANONICAL, "canonical_code_invalid"),
        _check("agent_name", F.col("agent_name") == "financial", "agent_name_invalid"),
        _check("calculation_present", has_calc, "calculation_missing"),
        _check("evidence_count", n == 2, "risk_evidence_count_invalid"),
        _check("evidence_ids_nonempty", F.forall(ids, lambda i: ~blank(i)), "evidence_id_missing"),
        _check("evidence_ids_unique", F.size(F.array_distinct(ids)) == n, "duplicate_evidence_id"),
        _check("calculation_evidence_order", calc["evidence_ids"] == ids, "calculation_evidence_ids_mismatch", has_calc),
    ]
    resolved = []
    for i, label in enumerate(("cash", "operating_cash_flow")):
        e, a = at(own, i), at(F.col("available"), i)
        there, known = n > i, (n > i) & a.isNotNull()
        same = F.lit(True)
        for field in ("evidence_id", "document_id", "chunk_id", "page", "source_type"):
            same = same & e[field].eqNullSafe(a[field])
        texts = ~blank(e["text"]) & ~blank(a["text"])
        equal = texts & (F.col(f"_spaced{i}")[0] == F.col(f"_spaced{i}")[1])
        source = (e["source_type"] == "prospectus") & (a["source_type"] == "prospectus")
        resolved.append(F.coalesce(known & same & equal & source, F.lit(False)))
        checks += [
            _check(f"{label}_available", known, f"{label}_evidence_unavailable", there),
            _check(f"{label}_identity", same, f"{label}_evidence_identity_mismatch", known),
            _check(f"{label}_text", texts, f"{label}_evidence_text_empty", known),
            _check(f"{label}_text_identity", equal, f"{label}_evidence_text_mismatch", known),
            _check(f"{label}_source_type", source, "evidence_source_type_invalid", known),
        ]
    one_document = ~blank(at(own, 0)["document_id"]) & F.forall(own, lambda e: e["document_id"] == at(own, 0)["document_id"])
    checks += [
        _check("evidence_same_document", one_document, "evidence_document_mismatch", n >= 2),
        _check("skill_name", calc["skill_name"] == SKILL, "skill_name_invalid", has_calc),
        _check("skill_version", calc["skill_version"] == SKILL_VERSION, "skill_version_invalid", has_calc),
        _check("calculation_success", calc["success"], "calculation_not_successful", has_calc),
        _check("calculation_error", calc["error"].isNull(), "calculation_error_present", has_calc),
        _check("calculation_unit", calc["unit"] == "months", "calculation_unit_invalid", has_calc),
        _check("formula", calc["formula"] == FORMULA, "calculation_formula_invalid", has_calc),
        _check("required_inputs", complete, "calculation_inputs_missing", has_calc),
        _check("cash_finite", cash.isNotNull(), "cash_invalid", complete),
        _check("operating_cash_flow_finite", flow.isNotNull(), "operating_cash_flow_invalid", complete),
        _check("monthly_burn_finite", burn.isNotNull(), "monthly_burn_invalid", complete),
        _check("period_months", months.isin(*PERIOD_MONTHS), "period_months_invalid", complete),
        _check("cash_non_negative", cash >= 0, "cash_negative", complete),
        _check("operating_cash_flow_negative", flow < 0, "operating_cash_flow_not_negative", complete),
        _check("currency", ~blank(given("currency")), "currency_missing", complete),
        _check("source_unit", ~blank(given("source_unit")), "source_unit_missing", complete),
        _check("period_ends", ends[0].isNotNull() & (ends[0] == ends[1]), "period_end_mismatch", complete),
        # no issue of its own: whatever prevents it has one already
        _check("skill_recalculation", countable, None),
        _check("calculation_result", decimal_of(calc["result"]) == rounded, "calculation_result_mismatch", countable),
        _check("monthly_burn", given("monthly_burn") == written(true_burn), "monthly_burn_mismatch", countable),
    ]
    both = countable & resolved[0] & resolved[1]
    stated = lambda key, value: meta[key].eqNullSafe(value)
    conclusion = F.lower("conclusion")
    fair = conclusion.contains(rounded.cast("string")) & conclusion.contains("deterministic") & conclusion.contains("rule") & conclusion.contains("not a probability")
    for claim in BANNED:
        fair = fair & ~conclusion.contains(claim)
    checks += [
        _check("cash_evidence_value", states_amount(at(own, 0)["text"], cash), "cash_evidence_value_mismatch", both),
        _check("operating_cash_flow_evidence_value", states_amount(at(own, 1)["text"], flow), "operating_cash_flow_evidence_value_mismatch", both),
        _check("policy_version", stated("policy_version", F.lit(POLICY)), "policy_version_mismatch", countable),
        _check("score_is_rule_based", stated("score_is_rule_based", F.lit("true")), "score_is_rule_based_mismatch", countable),
        _check("score_is_probability", stated("score_is_probability", F.lit("false")), "score_is_probability_mismatch", countable),
        _check("runway_months_rounded", decimal_of(meta["runway_months_rounded"]) == rounded, "runway_months_rounded_mismatch", countable),
        _check("metadata_monthly_burn", stated("monthly_burn", written(true_burn)), "metadata_monthly_burn_mismatch", countable),
        _check("metadata_currency", stated("currency", given("currency")), "metadata_currency_mismatch", countable),
        _check("metadata_source_unit", stated("source_unit", given("source_unit")), "metadata_source_unit_mismatch", countable),
        _check("metadata_period_months", stated("period_months", given("period_months")), "metadata_period_months_mismatch", countable),
        _check("risk_level", F.col("level") == level["level"], "risk_level_mismatch", countable),
        _check("risk_score", F.col("score") == level["score"], "risk_score_mismatch", countable),
        _check("conclusion", fair, "risk_conclusion_invalid", countable),
    ]
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(issue).cast("string").alias("issue")) for name, issue, _ in checks])
    zipped = F.zip_with("_outcomes", table, lambda passed, rule: F.struct(rule["name"].alias("name"), passed.alias("passed"), rule["issue"].alias("issue")))
    made = F.filter(zipped, lambda c: c["passed"].isNotNull())
    failed = F.filter("_checks", lambda c: ~c["passed"])
    few = (n < 2) & F.array_contains("verification_issues", "risk_evidence_count_invalid")
    waits = lambda i: (i == "evidence_id_missing") | i.endswith("_evidence_unavailable") | (few & i.isin("risk_evidence_count_invalid", "calculation_evidence_ids_mismatch"))
    status = (
        F.when((F.size("verification_issues") == 0) & (F.size(failed) == 0), "verified")
        .when((F.size("verification_issues") > 0) & F.forall("verification_issues", waits), "pending")
        .otherwise("needs_review")
    )
    # fixed values: the texts of the notes
    notes = F.when(
        F.col("verification_status") == "verified",
        "Evidence passed; Calculation was independently recalculated; risk level and deterministic rule score matched policy. The score is not a probability.",
    ).otherwise(F.concat(F.lit("Cash runway verification failed: "), F.array_join("verification_issues", ", ")))
    return (
        df.withColumn("_outcomes", F.array(*[outcome for _, _, outcome in checks]))
        .withColumn("_checks", made)
        .withColumn("verification_issues", F.array_distinct(F.filter(F.transform(failed, lambda c: c["issue"]), lambda i: i.isNotNull())))
        .withColumn("verification_status", status)
        .withColumn("verification_notes", notes)
        .withColumn("checks", F.map_from_entries(F.transform("_checks", lambda c: F.struct(c["name"], c["passed"]))))
        .drop("_checks", "_outcomes", "_level", "_rounded", "_countable", *[c for c in df.columns if c.startswith("_")], "available")
    )


def split_by_ids(risks: DataFrame, failed: DataFrame, key: str = "risk_id") -> tuple[DataFrame, DataFrame]:
    """risks whose id isn't among the failed ones, and those whose id is."""
    ids = failed.select(key).distinct()
    return risks.join(ids, key, "left_anti"), risks.join(ids, key, "left_semi")
