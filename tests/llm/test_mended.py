"""Ids that are texts in the n-gram join, source forms that the secret lexer reads, rows that are repeated often."""

import pytest
from pyspark.sql import functions as F

from pagelark.llm import exact_dedup, ngram_join, queries, secret_scan, topk_hamming

TOKEN = "aB3xK9qLm2Zt8Wp4"


@pytest.mark.parametrize(
    "text",
    [
        f'cfg["db_password"] = "{TOKEN}"', f"os.environ['API_SECRET'] = '{TOKEN}'", f'x = 1\nsettings["auth"]["secret_key"] := "{TOKEN}"',
        f"api_secret: |\n  {TOKEN}\n", f"db_password: >-\n\n    {TOKEN}\nnext: 1", f"secret_key: |2+\n  {TOKEN}",
    ],
)
def test_targets_by_key_and_block_scalars(text):
    base, added = secret_scan.scan_text(text)
    assert base == [] and [text[s:e] for s, _, e in added] == [TOKEN]


@pytest.mark.parametrize("text", ["a[0] = 'x'", 'cfg["color"] = "aB3xK9qLm2Zt8Wp4"', "db_password: |", "db_password: |\n", 'x["db_password"] == "aB3xK9qLm2Zt8Wp4"', "[", '["password"]', "a: > b\n"])
def test_what_is_no_target(text):
    assert secret_scan.scan_text(text)[1] == []


def test_text_ids_join(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [("z9", " ".join(base)), ("a10", " ".join(base)), ("a2", " ".join([*base, "more"])), ("c", "something else altogether"), (None, " ".join(base)), ("d", None), ("e", "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "name string, body string, component_id string")
    got = {r["name"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.components(docs, 4, 85, "name", "body").collect()}
    assert got == {"z9": (37, "a10", 2), "a10": (37, "a10", 2), "a2": (38, "a10", 2), "c": (1, "c", 0), None: (37, None, 0), "d": (0, "d", 0), "e": (0, "e", 0)}
    stay = ngram_join.representatives(docs, 4, 85, "name", "body")
    assert stay.columns == docs.columns and sorted(str(r["name"]) for r in stay.collect()) == ["None", "a10", "c", "d", "e"]


def test_radii_close_every_query_of_the_given_tables(spark, monkeypatch):
    """No query is answered by comparing it with all codes."""

    def scanned(*_):
        raise AssertionError("compared with all codes")

    monkeypatch.setattr(topk_hamming, "_scanned", scanned)
    assert queries.op10_topk_hamming(spark, "/root/testdata/sf0.01").count() == 50


def test_a_row_repeated_often_leaves_one(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 15_000, "Same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    null_ids = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("null "), (F.col("id") % 5)).alias("text"))
    kept = exact_dedup.distinct_documents(rows.unionByName(null_ids).repartition(4)).cache()
    assert kept.count() == 5_000 + 1 + 5 and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id is null").select("text").distinct().count() == 5
