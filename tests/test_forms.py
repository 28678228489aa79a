"""Matching forms and what a search finds by them, held against plain Python and the queries' SQL."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from pagelark.functions import text as forms
from pagelark.operators import retrieval
from pagelark.plans import queries, services


def _documents(spark, folder, *texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_registered_searches_take_no_word_out_of_the_ends_of_others(spark, tmp_path):
    data = _documents(spark, tmp_path, "Eau repa che la.\nUnder apache terms", "li cense\nLicense copy right copyright")
    found = {(r["query_id"], r["document_id"], r["page"]) for r in services.many_searches(spark, data).collect()}
    assert found == {("apache", "0", 2), ("license", "1", 2), ("copyright", "1", 2)}
    assert [(r["document_id"], r["page"]) for r in queries.QUERIES["keyword_topk"](spark, data).collect()] == [("1", 2)]


def test_the_operator_still_finds_terms_across_spaces(spark):
    pages = spark.createDataFrame([("a", "a:page:1", 1, "現 金 流")], "document_id string, chunk_id string, page int, text string")
    prepared = retrieval.prepare(pages)
    assert retrieval.search(prepared, "現金流").count() == 1 and retrieval.search(prepared, "現金流", across_spaces=False).count() == 0


def test_built_in_forms_are_those_of_plain_python(spark):
    own = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[\\x00-\\x7f{"".join(forms.OWN_FORMS)}]", c)]
    odd = ["\u0130", "\u00aa", "\u017f", "\u00b7", "\uff21", "\uff08x\uff09", "\u00a0", "\u0085", "\u0149", "\u2026"]
    texts = [f"X{c}y {c}" for c in own + odd] + ["Ä ß\tÉ", " (Ça) . ñ ", "經營\n活動 (1,000)", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", forms.normalise(F.col("t")).alias("n"))
    assert not [(r.t, r.n) for r in got.collect() if r.n != (None if r.t is None else forms.normal_form(r.t)[0])]


def test_common_letters_need_no_python(spark, monkeypatch):
    def never(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            assert not texts.notna().any()
            yield texts

    monkeypatch.setattr(forms, "_normalise_batches", never)
    got = spark.createDataFrame([("Ééaux ÑÜß",), ("綜合現金流量表 (1)",)], "t string").select(forms.normalise(F.col("t")))
    assert [r[0] for r in got.collect()] == ["ééaux ñüß", "綜合現金流量表 1"]


def test_lines_without_a_year_are_not_scanned_for_dates(monkeypatch):
    from pagelark.functions import periods

    class Never:
        def search(self, *_):
            raise AssertionError("scanned")

    assert [d.year for d in periods.dates_in("31 December 2023, 2024-06-30")] == [2023, 2024]
    monkeypatch.setattr(periods, "_DATE", Never())
    assert periods.read_header(["(219,053)", "人民幣千元", "nothing of the kind"]) == ([], [])
