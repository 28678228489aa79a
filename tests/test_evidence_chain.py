import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagelark.operators import extraction, retrieval, risks, verify
from pagelark.plans import evidence_chain

HEADER = "截至12月31日止年度\n截至3月31日止三個月\n2022年\n2023年\n2023年\n2024年\n人民幣千元\n"
FLOW_PAGE = "附錄一\n會計師報告\n綜合現金流量表\n" + HEADER + "經營活動所用淨現金流量\n(220,053)\n(200,944)\n(56,986)\n(83,918)"
CASH_PAGE = HEADER + "現金流量表所述現金及現金等價物\n90,762\n186,830\n111,745\n77,208"
CHUNK = "document_id string, chunk_id string, page int, section string, text string"


def chunks_of(spark, *pages, doc="doc"):
    return spark.createDataFrame([(doc, f"{doc}:page:{i}", i, "unknown", t) for i, t in enumerate(pages, 1)], CHUNK)


VARIANTS = {
    "doc": (FLOW_PAGE, CASH_PAGE),
    "other": ("nothing here",),
    "short_row": (FLOW_PAGE.replace("\n(83,918)", ""), CASH_PAGE),
    "scale_beside": (FLOW_PAGE, CASH_PAGE.replace("人民幣千元\n", "")),
    "scale_conflict": (FLOW_PAGE.replace("人民幣千元", "港幣千元"), CASH_PAGE.replace("人民幣千元", "人民幣")),
    "value_conflict": (FLOW_PAGE, CASH_PAGE, CASH_PAGE.replace("77,208", "77,209")),
    "newer_unclear": (FLOW_PAGE, CASH_PAGE, "x", CASH_PAGE.replace("2024年\n", "2025年\n").replace("人民幣千元", "人民幣千元 港幣千元")),
    "inflow": (FLOW_PAGE.replace("(83,918)", "83,918"), CASH_PAGE),
}


@pytest.fixture(scope="module")
def chain(spark):
    chunks = None
    for doc, pages in VARIANTS.items():
        one = chunks_of(spark, *pages, doc=doc)
        chunks = one if chunks is None else chunks.unionByName(one)
    return evidence_chain.runway_chain(chunks.repartition(3))


@pytest.fixture(scope="module")
def metrics(chain):
    return {(r["document_id"], r["metric_name"]): r for r in chain.metrics.collect()}


@pytest.fixture(scope="module")
def risk(spark, chain):
    row = chain.built.where("document_id = 'doc'").select("document_id", "risk.*")
    return spark.createDataFrame(row.collect(), row.schema)


def test_two_pages_give_a_verified_critical_runway(chain):
    (row,) = chain.risks.where("document_id = 'doc'").collect()
    assert row["verification_issues"] == []
    assert (row["verification_status"], row["level"], row["score"]) == ("verified", "critical", 90.0)
    assert row["calculation"]["result"] == "2.76"
    assert row["calculation"]["inputs"]["cash"] == "77208" and row["calculation"]["inputs"]["operating_cash_flow"] == "-83918"
    assert [e["page"] for e in row["evidence"]] == [2, 1]
    assert all(row["checks"].values()) and len(row["checks"]) > 45


def test_metrics_carry_period_scale_and_provenance(metrics):
    cash, flow = metrics["doc", extraction.CASH], metrics["doc", extraction.FLOW]
    assert cash["normalized_value"] == Decimal(77208) and flow["normalized_value"] == Decimal(-83918)
    assert cash["period_end"] == flow["period_end"] == datetime.date(2024, 3, 31)
    assert cash["period_months"] is None and flow["period_months"] == 3
    assert (cash["currency"], cash["unit"]) == ("CNY", "thousand")
    assert cash["extraction_method"] == "page_text_rule" and cash["context_pages"] == [2]


def test_document_without_evidence_ends_without_a_risk(chain):
    states = {r["document_id"]: r["agent_status"] for r in chain.statuses.collect()}
    assert (states["doc"], states["other"], states["inflow"], states["short_row"]) == ("built", "retriever_no_result", "not_applicable", "extraction_needs_review")


def test_prediction_is_degraded_without_a_market(spark, chain):
    market = spark.createDataFrame([("doc", None), ("other", 40.0)], "task_id string, sentiment_score double")
    merged, predictions = evidence_chain.scored(chain.risks.where("document_id = 'doc'"), market)
    by = {r["task_id"]: r for r in predictions.collect()}
    assert by["doc"]["risk_score"] == 90.0 and by["doc"]["risk_level"] == "critical"
    assert by["doc"]["degradation_reasons"] == ["market_sentiment_score_missing"]
    assert by["other"]["risk_score"] == 15.0 and by["other"]["degradation_reasons"] == ["verified_risks_missing"]
    assert merged.count() == 1


def test_scores_are_those_of_the_terms(spark):
    plain = "綜合現金流量表 經營活動所用淨現金流量 人民幣千元 (83,918)"
    prepared = retrieval.prepare(chunks_of(spark, plain, doc="a").unionByName(chunks_of(spark, "附錄一 會計師報告 " + plain, doc="b")))
    rows = {r["document_id"]: r["relevance_score"] for r in retrieval.search(prepared, "经营活动现金流").collect()}
    assert rows["a"] == pytest.approx(0.64) and rows["b"] == pytest.approx(0.94)


def test_contexts_look_at_the_spaced_form_only(spark):
    prepared = retrieval.prepare(chunks_of(spark, "概 要 license", doc="a").unionByName(chunks_of(spark, "概要 license", doc="b")))
    found = {r["document_id"]: r["summary_context"] for r in prepared.select("document_id", "summary_context").collect()}
    assert found == {"a": [], "b": ["概要"]}


def test_keywords_match_across_breaks_and_map_back(spark):
    (row,) = retrieval.search(retrieval.prepare(chunks_of(spark, "xx Cash\nand cash · equi-\nvalents yy")), "cash equivalents").collect()
    assert row["text"] == "xx Cash\nand cash · equi-\nvalents yy"
    assert row["metadata"]["query_intent"] == "cash_and_cash_equivalents" and row["metadata"]["match_type"] == "exact_query"


@pytest.mark.parametrize(("query", "limit"), [("", 3), ("  ", 3), ("cash", 0)])
def test_blank_queries_and_no_limit_give_nothing(spark, query, limit):
    assert retrieval.search(retrieval.prepare(chunks_of(spark, "cash")), query, limit).count() == 0


def test_limit_and_ties_follow_the_page(spark):
    prepared = retrieval.prepare(chunks_of(spark, "license", "license", "license", "license"))
    assert [(r["rank"], r["page"]) for r in retrieval.search(prepared, "license", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_column_count_mismatch_needs_review(metrics):
    row = metrics["short_row", extraction.FLOW]
    assert row["status"] == "needs_review" and "period_value_column_count_mismatch" in row["issues"] and row["normalized_value"] is None


def test_scale_comes_from_the_neighbour(metrics):
    row = metrics["scale_beside", extraction.CASH]
    assert (row["currency"], row["unit"], row["status"]) == ("CNY", "thousand", "extracted")
    assert row["context_pages"] == [1, 2] and row["extraction_method"] == "page_text_with_adjacent_context"


def test_conflicting_neighbour_scale(metrics):
    row = metrics["scale_conflict", extraction.CASH]
    assert row["status"] == "needs_review" and "context_currency_conflict" in row["issues"] and "unit_missing_or_ambiguous" in row["issues"]


def test_conflicting_values_of_one_period(metrics):
    row = metrics["value_conflict", extraction.CASH]
    assert row["status"] == "needs_review" and "conflicting_values_for_same_period" in row["issues"]


def test_newer_unresolved_row_blocks_an_older_clean_one(metrics):
    row = metrics["newer_unclear", extraction.CASH]
    assert row["period_end"] == datetime.date(2025, 3, 31) and row["issues"][-1] == "newer_period_candidate_unresolved"


def test_positive_flow_is_not_applicable(chain):
    row = chain.built.where("document_id = 'inflow'").first()
    assert row["build_status"] == "not_applicable" and row["issues"] == ["operating_cash_flow_does_not_represent_cash_burn"]


TAMPERED = {
    "risk_level_mismatch": lambda: {"level": F.lit("low")},
    "risk_score_mismatch": lambda: {"score": F.lit(91.0)},
    "agent_name_invalid": lambda: {"agent_name": F.lit("legal")},
    "risk_conclusion_invalid": lambda: {"conclusion": F.concat("conclusion", F.lit(" It will decline."))},
    "calculation_result_mismatch": lambda: {"calculation": F.col("calculation").withField("result", F.lit("2.77"))},
    "calculation_formula_invalid": lambda: {"calculation": F.col("calculation").withField("formula", F.lit("cash"))},
    "cash_evidence_value_mismatch": lambda: {"evidence": F.transform("evidence", lambda e: e.withField("text", F.lit("1,000")))},
    "calculation_evidence_ids_mismatch": lambda: {"evidence": F.reverse("evidence")},
}


@pytest.mark.parametrize("issue", TAMPERED)
def test_tampering_needs_review(risk, issue):
    row = verify.verify_runway(risk.withColumns(TAMPERED[issue]())).select("verification_status", "verification_issues").first()
    assert row["verification_status"] == "needs_review" and issue in row["verification_issues"]


def test_missing_evidence_is_pending(risk):
    none = risk.select(F.explode("evidence").alias("e")).select("e.*").where(F.lit(False))
    row = verify.verify_runway(risk, none).select("verification_status", "verification_issues").first()
    assert row["verification_status"] == "pending"
    assert row["verification_issues"] == ["cash_evidence_unavailable", "operating_cash_flow_evidence_unavailable"]


def test_generic_ladder(spark):
    kind = "risk_id string, risk_code string, score double, evidence array<struct<evidence_id:string>>, calculation struct<success:boolean,evidence_ids:array<string>>, verification_status string"
    e = [("e1",)]
    rows = [
        ("1", "redemption_rights", 50.0, [], None, ""),
        ("2", "customer_concentration", 50.0, e, None, ""),
        ("3", "customer_concentration", 50.0, e, (True, ["e1"]), ""),
        ("4", "customer_concentration", 50.0, e, (True, ["e2"]), ""),
        ("5", "anything", 96.0, e, None, ""),
        ("6", "anything", 95.0, e, None, ""),
    ]
    got = {r["risk_id"]: r["verification_status"] for r in verify.verify_generic(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"1": "pending", "2": "needs_review", "3": "verified", "4": "needs_review", "5": "rejected", "6": "verified"}


def test_requirement_table(spark):
    assert risks.requirements(spark).where("requires_calculation").count() == 4 and len(risks.ENABLED) == 8


def test_many_queries_give_what_each_gives_alone(spark):
    texts = ["cash and cash equivalents at end of year", "net cash used in operating activities", "license License li-cense", "", "現金及現金等價物 期末現金 ＣＡＳＨ and cash equi- valents", "經營活動所用現金淨額 (1,234)", "aa aaa", None]
    prepared = retrieval.prepare(chunks_of(spark, *[t for t in texts if t is not None]))
    asked = {"cash": "cash and cash equivalents", "flow": "經營活動所用現金淨額", "word": "license", "again": "License", "blank": "  ", "overlap": "aa", "none": "nothing of the kind"}
    key = lambda r: (r["document_id"], r["rank"], r["chunk_id"], r["text"], r["relevance_score"], r["metadata"]["matched_keywords"], r["metadata"]["match_type"])
    together = {}
    for r in retrieval.search_many(prepared, asked, 4).collect():
        together.setdefault(r["query_id"], []).append(key(r))
    assert set(together) == {"cash", "flow", "word", "again", "overlap"}
    for name, text in asked.items():
        assert sorted(together.get(name, [])) == sorted(key(r) for r in retrieval.search(prepared, text, 4).collect())
    assert retrieval.search_many(prepared, {}, 4).count() == 0


def test_matching_forms_of_batches_equal_the_walk():
    import random

    from pagelark.functions import forms
    from pagelark.functions.text import normal_form

    rng = random.Random(2)
    pool = "abXY 1\t\n　（），。ＡＢ１㎏½ﬁ現金é́ÅİßΣς·•…-_/()  가가😀𝔸"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(5000)] + ["", " ", "-" * 50, "x" * 100_000]
    forms.CHARACTERS, before = 500, forms.CHARACTERS
    try:
        got = [(form, places.tolist()) for form, places in forms.normal_forms(texts)]
    finally:
        forms.CHARACTERS = before
    assert got == [normal_form(t) for t in texts]
