"""The whole chain, its components, settings and domains on small inputs."""

import pytest

from pagelark.operators import quality
from pagelark.plans import analysis, checks, pipeline, settings


def test_settings_of_a_file():
    text = "# mock\nuse_mock: false  # off\nparser: \"text: #1\"\nretrieval_limit: 7\nempty:\nrules:\n  - a: 1\nunknown: x\n"
    values = settings.file_values(text)
    assert values == {"use_mock": False, "parser": "text: #1", "retrieval_limit": "7", "unknown": "x"}
    found = settings.load(values, {"PAGELARK_USE_MOCK": "Yes", "PAGELARK_RETRIEVER": "keyword"})
    assert (found.use_mock, found.parser, found.retrieval_limit, found.retriever) == (True, "text: #1", 7, "keyword")


def test_domains_of_pages_evidence_risks_and_metrics(spark):
    page = spark.createDataFrame([("d", "c", 1, "x"), (None, "c", 0, ""), ("d", "c", None, None)], "document_id string, chunk_id string, page int, text string")
    found = [r[0] for r in page.select(quality.page_messages()).collect()]
    assert found == [[], ["document_id is required", "page must be at least 1", "text must not be empty"], ["page is required", "text must not be empty"]]
    evidence = spark.createDataFrame([(None, "x", 1.0), (0, "x", float("nan"))], "page int, text string, relevance_score double")
    assert [len(r[0]) for r in evidence.select(quality.evidence_messages()).collect()] == [0, 2]
    risk = spark.createDataFrame([("r", "legal", "low", 0.0, 1.0), (None, "other", "none", -1.0, None)], "risk_code string, category string, level string, score double, confidence double")
    assert [len(r[0]) for r in risk.select(quality.risk_messages()).collect()] == [0, 5]
    metric = spark.createDataFrame([("m", None, None), ("m", 0, 2)], "metric_name string, period_months int, page int")
    assert [r[0] for r in metric.select(quality.metric_messages()).collect()] == [[], ["period_months must lie in 1 to 12"]]
    assert quality.header_messages(page) and not quality.header_messages(spark.createDataFrame([], ", ".join(f"{c} string" for c in quality.MANIFEST_COLUMNS)))


def _requests(spark):
    customers = spark.createDataFrame([(12, 5000.0), (11, 20.0), (10, 90.0)], "c_custkey long, c_acctbal double")
    requests = spark.createDataFrame([("12", "a", None), ("11", "b", None)], "task_id string, company_name string, stock_code string")
    evidence = spark.createDataFrame([("12", "redemption_rights", [("e1",)], None), ("11", "redemption_rights", [], "search_failed")], f"task_id string, risk_code string, evidence {analysis.EVIDENCE}, error string")
    return {"requests": requests, "pages": checks.statement_pages(customers), "evidence": evidence}


def test_the_whole_chain_with_the_runway_agent(spark):
    found = pipeline.run(spark, "t", analysis.steps(financial="runway", business="disabled", market="disabled"), _requests(spark))
    assert found.status == "completed" and found.errors.count() == 0 and found.logs.count() == 11
    got = {(r.task_id, r.risk_code): (r.verification_status, [e.evidence_id for e in r.evidence]) for r in found.state["verified"].collect()}
    assert got["12", "redemption_rights"] == ("verified", ["e1"]) and got["11", "redemption_rights"] == ("pending", [])
    # the balance of 5,000 against 85 in three months, stated on two pages
    assert got["12", "cash_runway"][0] == "verified" and len(got["12", "cash_runway"][1]) == 2 and set(got) == {("12", "redemption_rights"), ("11", "redemption_rights"), ("12", "cash_runway")}
    assert {r.document_id for r in found.state["chunks"].collect()} == {"12", "11"}
    assert {r.task_id: r.risk_score for r in found.state["predictions"].collect()} == {"12": 46.0, "11": 0.0}


def test_what_fails_costs_its_own_rows_only(spark):
    state = _requests(spark)
    found = pipeline.run(spark, "t", analysis.steps(predictor="failing", financial="failing"), state)
    assert found.status == "partial" and {r.stage for r in found.errors.collect()} == {"financial_agent", "predictor"}
    assert found.state["predictions"].count() == 0 and found.state["verified"].count() == 6 and found.state["report"].count() == 2
    pending = pipeline.run(spark, "t", analysis.steps(), {**state, "evidence": state["requests"]})
    assert pending.status == "partial" and {r.verification_status for r in pending.state["verified"].collect()} == {"pending"}
    lost = pipeline.run(spark, "t", analysis.steps(), {k: v for k, v in state.items() if k != "requests"})
    assert lost.status == "failed" and lost.logs.count() == 1
    with pytest.raises(pipeline.ConfigurationError):
        analysis.steps(predictor="unheard of")
    with pytest.raises(ValueError):
        analysis.steps(finance="trial")
