"""Sources, sinks, settings, providers and the corrected joins on small inputs."""

import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagelark.functions.ids import uuid5
from pagelark.functions.text import normal_form, normalise, normalised
from pagelark.operators import acceptance, agents, catalog, extraction, verify
from pagelark.plans import queries
from pagelark.sources import pages, sinks, tables
from pagelark.sources.scratch import Workspace


def test_pages_of_files_and_their_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\f \fthree ".encode())
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b" \f ")
    # Spark's reader passes over files of no bytes, so such a row comes from elsewhere, an archive for one
    empty = spark.createDataFrame([("b.txt", 0, bytearray())], "path string, length long, content binary")
    rows = pages.pages(pages.read_files(spark, str(tmp_path)).unionByName(empty)).collect()
    good = [(r["document_id"], r["chunk_id"], r["page"], r["text"]) for r in rows if r["error_code"] is None]
    assert good == [("a", "a:page:1", 1, "one"), ("a", "a:page:3", 3, "three")]
    assert {(r["document_id"], r["error_code"], r["recoverable"]) for r in rows if r["error_code"]} == {("b", "empty_pdf", False), ("c", "pdf_open_failure", False), ("d", "empty_pdf", False)}
    facts = {r["path"][-5:]: r["file_size_bytes"] for r in pages.file_facts(pages.read_files(spark, str(tmp_path))).collect()}
    assert facts["a.txt"] == 12


def test_a_failed_page_costs_itself_only(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    rows = pages.pages(pages.read_files(spark, str(tmp_path)), lambda content: ["first", None, "last"]).collect()
    assert [(r["page"], r["error_code"]) for r in rows] == [(1, None), (2, "page_parse_failure"), (3, None)]


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.pdf", b"%PDF-1")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    wanted = spark.createDataFrame([("1", "z.zip", "a.pdf"), ("2", "z.zip", "b.pdf"), ("3", "q.zip", "a.pdf"), ("4", "bad.zip", "a.pdf")], "case_id string, archive string, member string")
    got = {r["case_id"]: (bytes(r["content"]) if r["content"] else None, r["failure_code"]) for r in pages.zip_members(pages.read_files(spark, str(tmp_path), "*.zip"), wanted).collect()}
    assert got == {"1": (b"%PDF-1", None), "2": (None, "member_missing"), "3": (None, "archive_missing"), "4": (None, "archive_unreadable")}


def test_discovery_reads_names(spark, tmp_path):
    folder = tmp_path / "2023_2份"
    folder.mkdir()
    (folder / "02410_30-03-2023_Some_Company_Global.pdf").write_bytes(b"%PDF-")
    (folder / "odd.pdf").write_bytes(b"%PDF-")
    got = {r["source_filename"]: r for r in pages.discover(pages.read_files(spark, str(tmp_path))).collect()}
    row = got["02410_30-03-2023_Some_Company_Global.pdf"]
    assert (row["case_id"], row["source_year"], row["disclosure_date"], row["company_short_name"], row["offering_type"]) == ("ipo_2023_02410", 2023, "2023-03-30", "Some_Company", "Global")
    assert got["odd.pdf"]["name_issue"] == "unexpected_prospectus_filename" and pages.mock_pages(spark).count() == 3


def test_csv_with_mark_and_gb18030(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,note\n1,"two\nlines"\n2,\n'.encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [("1", "two\nlines"), ("2", "")]
    (tmp_path / "g.csv").write_bytes("代码,名称\n1,公司\n2\n3,x,y\n".encode("gb18030"))
    rows = tables.read_gb18030(spark, str(tmp_path / "g.csv"), ["code", "name"]).cache()
    assert rows.where("_corrupt_record is null").select("code", "name").collect() == [("1", "公司")] and rows.where("_corrupt_record is not null").count() == 2


def test_sheet_rows(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row>{cell("A1", "a")}{cell("C1", "b")}</row><row>{cell("A2", "x")}</row><row/><row>{cell("C4", "y")}</row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(data.getvalue())
    assert [tuple(r) for r in tables.read_sheet(spark, str(tmp_path / "w.xlsx"), "S", ["a", "b"]).collect()] == [("x", ""), ("", "y")]
    with pytest.raises(Exception, match="lacks"):
        tables.read_sheet(spark, str(tmp_path / "w.xlsx"), "S", ["c"]).collect()


def test_results_are_read_from_their_folder_alone(spark, tmp_path):
    results = spark.createDataFrame([("007", 1), ("8", 2)], "analysis_id string, n int")
    sinks.write_results(results, str(tmp_path / "r"))
    found = sinks.read_result(spark, str(tmp_path / "r"), "007", "analysis_id string, n int")
    assert [tuple(r) for r in found.collect()] == [("007", 1)] and found.columns == ["analysis_id", "n"]
    assert "PartitionFilters: [isnotnull(_key" in found._jdf.queryExecution().toString()
    both = spark.read.schema("analysis_id string, n int").json(str(tmp_path / "r")).select("analysis_id", "n")
    assert sinks.differences(results, both).count() == 0 and sinks.differences(results, both.where("n = 1")).collect()[0]["side"] == "written_only"


def test_catalog_files_begin_with_a_mark(spark, tmp_path):
    sinks.write_catalog(spark.createDataFrame([("b", None), ("a", 1)], "k string, n int"), str(tmp_path / "c"), ["k", "n", "gone"], ["k"])
    (part,) = [p for p in sorted((tmp_path / "c").glob("*.csv")) if p.stat().st_size][:1]
    assert part.read_bytes().startswith("﻿k,n,gone\n".encode())
    assert [r["k"] for r in tables.read_csv(spark, str(tmp_path / "c")).collect()] == ["a", "b"]


def test_payload_and_redaction(spark):
    df = spark.createDataFrame([("1", {"path": "/x", "a": "b"})], "analysis_id string, context map<string,string>").withColumn("context", sinks.redacted(F.col("context")))
    assert sinks.payload(df, ["context", "prediction"]).first()["payload"] == '{"context":{"a":"b"},"prediction":null}'


def test_workspace_deletes_what_is_spent(spark):
    scratch = Workspace(spark)
    kept = scratch.keep(spark.range(3), "t")
    path = scratch.kept[id(kept)][1]
    scratch.drop(kept, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_names_give_the_library_uuids(spark):
    names = ["", "a", "現金 🙂", "x" * 5000]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_normal_forms_agree(spark):
    texts = ["", " A-b_c/(d)\x1f.e\x0b\x1c ", "Ｃａｓｈ　現金・及び", "ﬁne Café  x", "KK ſ İ", "--", None, "tab\tnew\nline"]
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalise(F.col("t")).alias("n")).collect()}
    assert got == {t: None if t is None else normal_form(t)[0] for t in texts} and all(normalised(t) == normal_form(t)[0] for t in texts if t)


def test_signs_never_hide_a_name(spark):
    texts = ["rmb", "us$ 5", "uſd", "hK$", "hKd 3", "千元", "'000", "thouſand", "mıllion", "mİllion", "unıt", "百萬元", "元", "萬元", "nothing", "Million UNIT usd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {**extraction.CURRENCIES, **extraction.UNITS, "unit": extraction.PLAIN_UNIT}
    for name, pattern in plain.items():
        lost = df.where(F.col("t").rlike(pattern) & ~extraction._signed(F.col("t"), name)).collect()
        assert not lost, (name, lost)


def test_external_evidence_overrides_own(spark):
    kind = "risk_id string, evidence array<struct<evidence_id:string,text:string>>"
    risks = spark.createDataFrame([("r", [("e1", "own"), ("e2", "own")])], kind)
    external = spark.createDataFrame([("e2", "found"), ("e3", "found")], "evidence_id string, text string")
    assert {tuple(r) for r in verify.known_evidence(risks, external).collect()} == {("e1", "own"), ("e2", "found"), ("e3", "found")}


def test_a_repeated_master_key_is_flagged(spark):
    cases = spark.createDataFrame([("1",), ("2",)], "case_id string")
    matches = spark.createDataFrame([("1", "a", "matched"), ("2", "b", "matched")], "case_id string, k string, status string")
    master = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "m string, v string")
    got = {r["case_id"]: (r["v"], r["bridge_issue"]) for r in catalog.bridge(cases, matches, master, "case_id", ["k"], ["m"]).collect()}
    assert got == {"1": ("x", "master_key_repeated"), "2": ("z", None)}


def test_a_failing_agent_leaves_a_diagnostic(spark):
    tasks = spark.createDataFrame([("t",)], "task_id string")
    risks, states = agents.isolated(tasks, {"legal": lambda t: agents.trial_risks(t, "legal"), "market": agents.failing, "broken": lambda t: t.missing})
    assert [r["risk_code"] for r in risks.collect()] == ["redemption_rights"]
    assert {r["agent_name"]: r["status"] for r in states.collect()} == {"legal": "completed", "market": "failed", "broken": "failed"}
    none, why = agents.unavailable(tasks, "legal")
    assert none.count() == 0 and why.first()["status"] == "component_not_implemented"
    assert agents.snapshots(tasks.withColumn("stock_code", F.lit("1"))).first()["source"] == "unavailable" and agents.snapshots(tasks, trial=True).first()["sentiment_score"] == 35.0


def test_a_sound_sample_has_no_failures(spark):
    columns = "case_id string, archive_filename string, source_filename string, source_year string, stock_code_raw string, manual_review string, selection_tags string"
    rows = [(str(i), f"{y}_a.zip", f"{i}.pdf", str(y), f"0000{i}", "true" if i < 2 else "false", "low_text_density|x") for i, y in enumerate([2020, 2021, 2022, 2023])]
    quotas = {str(y): 1 for y in range(2020, 2024)}
    assert acceptance.sample_failures(spark.createDataFrame(rows, columns), quotas, 2, 2).count() == 0
    bad = [*rows[:3], ("3", "2025_a.zip", "3.pdf", "2025", "02410", "true", "")]
    got = {r["check"] for r in acceptance.sample_failures(spark.createDataFrame(bad, columns), quotas, 2, 4).collect()}
    assert got == {"year_quotas", "manual_reviews", "blind_year_in_sample", "development_case_in_sample", "too_few_sparse_documents"}


def test_every_query_is_callable_and_named():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(queries.queries()) <= set(found)


def test_files_that_are_missing_give_error_rows(spark):
    files = spark.createDataFrame([("file:/a/b/x.pdf",), ("file:/a/y.pdf",)], "path string")
    wanted = spark.createDataFrame([("file:/a/b/x.pdf",), ("file:/a/b/",), ("file:/a/z.pdf",), ("file:/a/z.pdf",), (None,)], "path string")
    found = {(r.error, r.error_code, r.recoverable) for r in pages.missing_files(wanted, files).collect()}
    assert found == {("file:/a/b", "not_a_file", False), ("file:/a/z.pdf", "file_not_found", False), (None, "file_not_found", False)}


def test_inspection_folds_errors_into_the_row(spark):
    rows = [("a", 1, "text", None, None, None), ("a", 2, None, "page_parse_failure", "page 2", True), ("b", None, None, "encrypted_pdf", "locked", False), ("c", 2, "text", None, None, None), ("c", 9, None, "page_parse_failure", "page 9", True)]
    decoded = spark.createDataFrame(rows, "document_id string, page int, text string, error_code string, error string, recoverable boolean")
    found = {r.document_id: (r.page_count, r.is_text, r.parser_status, r.error_count, r.parser_message) for r in pages.inspected(decoded).collect()}
    assert found == {"a": (2, True, "not_run", 0, ""), "b": (0, False, "pdf_metadata_failed", 1, "encrypted_pdf: locked"), "c": (9, False, "not_run", 0, "")}


def test_results_that_come_back_otherwise_are_partial(spark):
    results = spark.createDataFrame([("a", "completed", 1), ("b", "completed", 2), ("c", "failed", 3), (None, "completed", 4)], "analysis_id string, status string, n int")
    read = spark.createDataFrame([("a", "completed", 1), ("b", "completed", 9), ("c", "failed", 3)], "analysis_id string, status string, n int")
    found = {r.analysis_id: (r.status, r.save_error) for r in sinks.save_outcomes(results, read).collect()}
    assert found == {"a": ("completed", None), "b": ("partial", "save_failure"), "c": ("failed", None), None: ("partial", "save_failure")}


def test_dataset_issues_name_a_cut_master(spark):
    shapes = spark.createDataFrame([(262_144, 10, 0), (5, 10, 1), (5, 10, 0)], "size long, rows long, malformed long")
    codes = [[r.issue_code for r in catalog.dataset_issues(shapes.where(c)).collect()] for c in ("size > 5", "malformed = 1", "size = 5 and malformed = 0")]
    assert codes == [["SECURITY_MASTER_TRUNCATED", "EOD_AMOUNT_UNIT_UNCONFIRMED"]] * 2 + [["EOD_AMOUNT_UNIT_UNCONFIRMED"]]
