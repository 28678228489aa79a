"""Registered queries of catalogs, samples, agents and reducers, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, policy
from ..functions.amounts import amount
from ..functions.text import joined_scores, joined_texts
from ..operators import acceptance, agents, catalog, extraction, merge, quality, retrieval, scoring
from ..sources import pages, sinks, tables
from . import analysis, evidence_chain, pipeline
from .queries import LINES, line_chunks_of, query, table

SHA = "repeat('a', 64)"


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS industry,
       CASE WHEN c_nationkey % 4 IN (0, 1) THEN 'true' ELSE 'false' END AS has_info,
       concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'even' END, CASE WHEN c_acctbal < 0 THEN 'negative' END) AS notes
FROM customer
"""
)
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = F.element_at(F.array(F.lit(" TRUE "), F.lit("yes"), F.lit("no"), F.lit("")), (c("c_nationkey") % 4 + 1).cast("int"))
    notes = catalog.notes(F.when(c("c_custkey") % 2 == 0, "even"), F.when(c("c_acctbal") < 0, "negative"))
    name = catalog.first_non_blank(F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_name")), c("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("industry"), catalog.truth(raw).alias("has_info"), notes.alias("notes"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "o_custkey", "day")


@query("SELECT count(*) AS rows, count(DISTINCT CASE WHEN l_linenumber <> 7 THEN l_partkey END) AS unique_codes, count(*) FILTER (WHERE l_linenumber = 7) AS malformed_rows FROM lineitem")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").withColumn("_corrupt_record", F.when(F.col("l_linenumber") == 7, "bad"))
    return catalog.dataset_shape(facts, "l_partkey")


@query(
    """
SELECT doc_id, concat_ws('|', CASE WHEN quality <> CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END THEN 'quality' END, CASE WHEN toxic <> 0 THEN 'toxic' END) AS differing
FROM (SELECT DISTINCT * FROM labels) WHERE quality <> CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END OR toxic <> 0
"""
)
def attribute_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    other = labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    return quality.attribute_differences(labels, other, "doc_id", ["quality", "toxic"]).select("doc_id", F.array_join("differing", "|").alias("differing"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS step FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def log_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.log_steps(table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct(), "conv_id", "turn")


@query(
    """
WITH risk AS (
  SELECT o_custkey AS g, o_orderpriority AS category, o_orderkey AS seq, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS score,
         [concat('e', o_orderkey % 5), concat('e', o_orderkey % 7)] AS ev FROM orders
), best AS (
  SELECT g, category, arg_min(score, (-score, seq)) AS score, arg_min(seq, (-score, seq)) AS seq, count(*) AS merged_count FROM risk GROUP BY g, category
), item AS (SELECT g, category, seq, i, ev[i] AS e FROM risk, unnest([1, 2]) AS t(i)
), firsts AS (SELECT g, category, e, min((seq, i)) AS place FROM item GROUP BY g, category, e
), joined AS (SELECT g, category, string_agg(e, '|' ORDER BY place) AS evidence FROM firsts GROUP BY g, category)
SELECT CAST(g AS VARCHAR) AS risk_code, category, score, seq, evidence, merged_count FROM best JOIN joined USING (g, category)
"""
)
def merge_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    one = lambda n: F.struct(F.concat(F.lit("e"), (key % n).cast("string")).alias("evidence_id"))
    risks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("risk_code"), F.col("o_orderpriority").alias("category"), key.alias("seq"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score"), F.array(one(5), one(7)).alias("evidence"),
    )
    return merge.merge_risks(risks).withColumn("evidence", F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), "|"))


@query(
    """
SELECT CAST(o_custkey AS VARCHAR) AS task_id, count(*) AS risk_count, string_agg(concat('a', o_orderkey, '|b', o_orderkey), '|' ORDER BY o_orderkey) AS evidence_ids
FROM orders GROUP BY o_custkey
"""
)
def report_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    evidence = F.array(*[F.struct(F.concat(F.lit(p), key).alias("evidence_id")) for p in "ab"])
    risks = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderkey").alias("seq"), evidence.alias("evidence"))
    return scoring.report_section(risks).withColumn("evidence_ids", F.array_join("evidence_ids", "|"))


@query(
    """
WITH item AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey % 3 = 0 AS dash, CAST(l_quantity AS DOUBLE) AS v FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_quantity FROM lineitem)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, v) AS r FROM item WHERE NOT dash)
SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS period_end, v AS value FROM ranked WHERE r = 1
"""
)
def latest_period_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest complete column of an order's lines: ship dates as periods, quantities as printed cells."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity").distinct()
    cell = F.when(F.col("l_partkey") % 3 == 0, "—").otherwise(F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    columns = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("q"), F.col("l_shipdate").cast("date").alias("end"), cell.alias("cell"))))
    orders = items.groupBy("l_orderkey").agg(columns.alias("c"))
    period = F.transform("c", lambda x: F.struct(x["end"].alias("end"), F.lit(None).cast("int").alias("months")))
    found = orders.select("l_orderkey", extraction.latest_complete(period, F.transform("c", lambda x: x["cell"])).alias("b")).where("b is not null")
    return found.select("l_orderkey", F.col("b.end").cast("string").alias("period_end"), F.col("b.value").cast("double").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / (o_orderkey % 3), 6) END AS share, CASE WHEN o_custkey % 5 > 0 THEN round(o_totalprice / (o_custkey % 5), 6) END AS runway FROM orders")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    share, runway = policy.share_of(price, F.col("o_orderkey") % 3), policy.monthly_runway(price, F.col("o_custkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(share, 6).alias("share"), F.round(runway, 6).alias("runway"))


@query(
    """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'needs_review' WHEN quality = 1 AND toxic = 1 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'none' END AS level
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
"""
)
def presence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return docs.select("doc_id", policy.presence_level(F.col("q") == 1, F.col("t") == 1).alias("level"))


@query(
    """
SELECT doc_id, array_to_string(list_sort(list_distinct([0, n // 4, n // 2, n * 3 // 4, n - 1])), '|') AS places
FROM (SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents) WHERE n > 0
"""
)
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    return docs.select("doc_id", F.array_join(pages.page_sample(F.col("n_chars").cast("long")).cast("array<string>"), "|").alias("places"))


@query(
    LINES
    + """, words AS (SELECT *, len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['license', 'the'])) > 0 AS hit FROM chunk),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY hit DESC, page, chunk_id) AS INTEGER) AS rank FROM words)
SELECT document_id, page, rank, CAST(1.0 AS DOUBLE) AS relevance_score FROM ranked WHERE (hit AND rank <= 3) OR rank = 1
"""
)
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.token_search(line_chunks_of(table(spark, sf_dir, "documents")), "License the", 3)
    return found.select("document_id", "page", "rank", "relevance_score")


@query(
    """
SELECT o_custkey, string_agg(printf('%.4f', (o_orderkey % 10000) / 10000.0), '|' ORDER BY o_orderkey) AS scores, string_agg(concat(o_orderstatus, ' ', o_orderpriority), ' || ' ORDER BY o_orderkey) AS texts
FROM orders GROUP BY o_custkey
"""
)
def serialised_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("o_orderkey", (F.col("o_orderkey") % 10000 / 10000.0).alias("s"), F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority").alias("t"))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return grouped.select("o_custkey", joined_scores(F.transform("r", lambda x: x["s"])).alias("scores"), joined_texts(F.transform("r", lambda x: x["t"])).alias("texts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('a=', c_name, ';b=new') ELSE concat('a=', c_name, ';b=old') END AS entries FROM customer")
def map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.lit("old"), F.lit("path"), F.lit("/x"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    shown = F.map_entries(sinks.redacted(merge.merged_maps(first, second)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(shown), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.when(F.col("c_custkey") % 5 == 0, "股票代码").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, symbol).alias("c_name"))
    return catalog.without_header_noise(tables.has_content(rows), "c_name")


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'provisional_gold' WHEN m IS NULL THEN 'unreviewed' WHEN m THEN 'shadow_manual_reviewed' ELSE 'shadow_automatic' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
"""
)
def annotation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").cast("string").alias("manual_review"))
    found = catalog.with_annotation_status(table(spark, sf_dir, "customer").select("c_custkey"), sample, "c_custkey", 7)
    return found.select("c_custkey", F.col("annotation_status").alias("status"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a manifest with faults of every kind."""
    k, year = F.col("c_custkey"), (F.col("c_nationkey") % 6 + 2020).cast("string")
    return table(spark, sf_dir, "customer").select(
        (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string").alias("case_id"), k.cast("string").alias("stock_code_raw"), year.alias("source_year"),
        F.when(k % 11 == 0, F.concat(F.lit("/"), k.cast("string"))).otherwise(F.concat(year, F.lit("/"), k.cast("string"), F.lit(".pdf"))).alias("relative_path"),
        F.when(k % 13 == 0, "short").otherwise(F.repeat(F.lit("a"), 64)).alias("sha256"), F.when(k % 17 == 0, "done").otherwise("not_run").alias("parser_status"),
        F.when((year == "2025") & (k % 3 == 0), "development").when(year == "2025", "blind_test").when(year == "2024", "validation").otherwise("development").alias("dataset_split"),
        F.concat(k.cast("string"), F.lit(".pdf")).alias("source_filename"), F.concat(k.cast("string"), F.lit(".HK")).alias("stock_code_wind"),
    )


MANIFEST_SQL = f"""
WITH m AS (
  SELECT CAST(c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS case_id, c_custkey AS k, CAST(c_nationkey % 6 + 2020 AS VARCHAR) AS y,
         CASE WHEN c_custkey % 13 = 0 THEN 'short' ELSE {SHA} END AS sha FROM customer
)
"""


@query(
    MANIFEST_SQL
    + """
SELECT 'case_id_repeated' AS "check", case_id AS detail FROM m GROUP BY case_id HAVING count(*) > 1
UNION ALL SELECT 'manifest_rows', concat('expected 600, got ', count(*)) FROM m HAVING count(*) <> 600
UNION ALL SELECT 'year_counts', concat(y, ': expected 100, got ', count(*)) FROM m GROUP BY y HAVING count(*) <> 100
UNION ALL SELECT 'non_portable_relative_path', case_id FROM m WHERE k % 11 = 0
UNION ALL SELECT 'invalid_sha256', case_id FROM m WHERE length(sha) <> 64
UNION ALL SELECT 'blind_year_escaped', case_id FROM m WHERE y = '2025' AND k % 3 = 0
UNION ALL SELECT 'unexpected_parser_status', case_id FROM m WHERE k % 17 = 0
"""
)
def manifest_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.manifest_failures(_manifest(spark, sf_dir), {str(y): 100 for y in range(2020, 2026)})


@query(
    MANIFEST_SQL
    + """, s AS (
  SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END AS k, o_orderkey % 4 = 0 AS other, CAST(c_nationkey % 6 + 2020 AS VARCHAR) AS y FROM orders JOIN customer ON c_custkey = o_custkey
), one AS (
  SELECT y, k, arg_min(other, CAST(o_orderkey AS VARCHAR)) AS other, min(CAST(o_orderkey AS VARCHAR)) AS case_id FROM s GROUP BY y, k
), j AS (SELECT one.*, m.k IS NOT NULL AS there, m.sha, CASE WHEN m.y = '2025' THEN CASE WHEN m.k % 3 = 0 THEN 'development' ELSE 'blind_test' END WHEN m.y = '2024' THEN 'validation' ELSE 'development' END AS split, m.k % 11 = 0 AS rooted FROM one LEFT JOIN m ON m.k = one.k AND m.y = one.y)
SELECT 'sample_key_repeated' AS "check", concat(y, '/', k) AS detail FROM s GROUP BY y, k HAVING count(*) > 1
UNION ALL SELECT 'missing_from_manifest', case_id FROM j WHERE NOT there
UNION ALL SELECT 'filename_differs', case_id FROM j WHERE there AND other
UNION ALL SELECT 'relative_path_differs', case_id FROM j WHERE there AND (other OR rooted)
UNION ALL SELECT 'manifest_sha256_invalid', case_id FROM j WHERE there AND length(sha) <> 64
UNION ALL SELECT 'disallowed_split', case_id FROM j WHERE there AND split = 'blind_test'
UNION ALL SELECT 'frozen_exclusion', case_id FROM j WHERE there AND y = '2025'
"""
)
def sample_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 9 == 0, 1000000).otherwise(0)).cast("string")
    sample = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("case_id"), k.alias("stock_code_raw"), (F.col("c_nationkey") % 6 + 2020).cast("string").alias("source_year"),
        F.concat(k, F.when(F.col("o_orderkey") % 4 == 0, ".txt").otherwise(".pdf")).alias("source_filename"), F.concat(k, F.lit(".HK")).alias("stock_code_wind"),
    )
    return acceptance.sample_alignment(sample, _manifest(spark, sf_dir))


@query(
    """
SELECT CAST(c_custkey AS VARCHAR) AS task_id, risk_code, level, score, agent_name FROM customer,
  (VALUES ('continuous_loss', 'high', 78.0::DOUBLE, 'financial'), ('redemption_rights', 'high', 72.0::DOUBLE, 'legal'), ('precommercial_product', 'medium', 66.0::DOUBLE, 'business')) v(risk_code, level, score, agent_name)
"""
)
def isolated_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trial agents beside one that fails; the failure costs its own rows only."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id"))
    of = lambda name: lambda t: agents.trial_risks(t, name)
    risks, _ = agents.isolated(tasks, {"financial": of("financial"), "legal": of("legal"), "market": agents.failing, "business": of("business")})
    return risks.select("task_id", "risk_code", "level", "score", "agent_name")


@query(
    """
SELECT CAST(c_custkey AS VARCHAR) AS task_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS sentiment_score,
       CASE WHEN c_custkey % 2 = 0 THEN 'market' ELSE 'unavailable' END AS source, c_custkey % 2 = 0 AS available
FROM customer
"""
)
def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    requests = agents.profiles(customer.select(F.col("c_custkey").cast("string").alias("task_id"), F.col("c_name").alias("company_name"), F.col("c_custkey").cast("string").alias("stock_code")))
    nothing = F.lit(None).cast("double")
    market = customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").cast("string").alias("stock_code"), nothing.alias("hsi_return_5d"), nothing.alias("recent_ipo_break_rate"), nothing.alias("market_volatility"), F.col("c_nationkey").cast("double").alias("sentiment_score")
    )
    return agents.snapshots(requests, market).select("task_id", "sentiment_score", "source", "available")


@query(
    """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'completed' END AS parser_status,
       CASE WHEN o_orderkey % 7 = 0 THEN 'P-01' WHEN o_orderkey % 5 = 0 THEN 'P-02' WHEN o_orderkey % 3 = 0 THEN 'P-01' WHEN o_orderkey % 2 = 0 THEN 'P-05' ELSE '' END AS failure_code,
       CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS nonblank_page_count
FROM orders
"""
)
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    cases = orders.select(k.cast("string").alias("case_id"), F.when(k % 7 == 0, "archive_missing").alias("failure_code"))
    page = F.explode(F.sequence(F.lit(1), F.lit(3)))
    scanned = orders.where("o_orderkey % 3 <> 0 or o_orderkey % 5 = 0").withColumn("p", page).where("o_orderkey % 5 <> 0 or p = 1")
    code = F.when(k % 5 == 0, "empty_pdf").when((k % 2 == 0) & (F.col("p") == 3), "page_parse_failure")
    rows = scanned.where("p < 3 or o_orderkey % 2 = 0").select(k.cast("string").alias("document_id"), "p", code.alias("error_code"), F.when(code.isNotNull(), k % 5 != 0).alias("recoverable"))
    found = acceptance.batch_outcomes(cases, rows)
    return found.select("case_id", "parser_status", "failure_code", F.col("nonblank_page_count").cast("int").alias("nonblank_page_count"))


@query(
    """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'not_a_pdf_name' WHEN 1 THEN 'empty_file' WHEN 2 THEN 'not_pdf_content' WHEN 3 THEN 'file_too_large' END AS issue,
       c_custkey % 2 = 0 AS truncated
FROM customer
"""
)
def upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    path = F.when(k == 0, "a.txt").otherwise("A.PDF")
    content = F.when(k == 1, "").when(k == 2, "hello").when(k == 3, "%PDF-1.4 long enough").otherwise("%PDF-1.4").cast("binary")
    cut = catalog.truncated(F.when(F.col("c_custkey") % 4 == 0, 262_144).otherwise(5), F.when(F.col("c_custkey") % 4 == 2, 3).otherwise(0))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.upload_issue(path, content, 12).alias("issue"), cut.alias("truncated"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 < 3 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders")
def amount_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six printed forms of an amount: three for negative ones and three for positive ones."""
    price = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    wide = F.translate(price, ",0123456789", "，０１２３４５６７８９")
    forms = [F.concat(F.lit("（"), wide, F.lit("）")), F.concat(F.lit("( "), price, F.lit(" )")), F.concat(F.lit("− "), price), F.concat(F.lit("+"), price), F.translate(price, ",", " "), F.concat(F.lit(" "), wide)]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amount(text).cast("double").alias("amount"))


@query(
    """
SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN strftime(o_orderdate, '%Y-%m-%d') END AS period_end,
       CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN CAST(CASE WHEN o_orderkey % 3 = 2 THEN 12 ELSE 6 END AS INTEGER) END AS months
FROM orders
"""
)
def period_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three printed forms of a period; only years 20xx are read, others give null."""
    d = F.col("o_orderdate")
    forms = [F.concat(F.lit("six months ended "), F.date_format(d, "d MMMM yyyy")), F.concat(F.lit("6 months ended "), F.date_format(d, "MMMM d, yyyy")), F.concat(F.lit("year ended "), F.date_format(d, "yyyy-MM-dd"))]
    line = F.element_at(F.array(*forms), (F.col("o_orderkey") % 3 + 1).cast("int"))
    read = table(spark, sf_dir, "orders").select("o_orderkey", F.get(periods.header(F.array(line))["periods"], F.lit(0)).alias("first"))
    return read.select("o_orderkey", F.col("first.end").cast("string").alias("period_end"), F.col("first.months").alias("months"))


HEAD = "截至12月31日止年度\n截至3月31日止三個月\n2022年\n2023年\n2023年\n2024年\n人民幣千元\n"


def statement_pages(customer: DataFrame) -> DataFrame:
    """Two statement pages for each customer: the balance as cash, the key as outflow (or inflow) of three months."""
    k = F.col("c_custkey")
    cash, burn = F.format_number(F.floor(F.abs("c_acctbal")), 0), F.format_number(k * 7 + 1, 0)
    flow = F.when(k % 10 == 0, burn).otherwise(F.concat(F.lit("("), burn, F.lit(")")))
    first = F.concat(F.lit("附錄一\n會計師報告\n綜合現金流量表\n" + HEAD + "經營活動所用淨現金流量\n(220,053)\n(200,944)\n(56,986)\n"), flow)
    second = F.when(k % 10 != 1, F.concat(F.lit(HEAD + "現金流量表所述現金及現金等價物\n90,762\n186,830\n111,745\n"), cash)).otherwise(F.lit("nothing of the kind"))
    placed = customer.select(k.cast("string").alias("document_id"), F.posexplode(F.array(first, second)).alias("i", "text"))
    page = (F.col("i") + 1).cast("int")
    return placed.select("document_id", F.concat_ws(":", "document_id", F.lit("page"), page).alias("chunk_id"), page.alias("page"), F.lit("unknown").alias("section"), "text")


CHAIN_SQL = """
WITH c AS (SELECT c_custkey AS k, CAST(floor(abs(c_acctbal)) AS HUGEINT) AS cash, CAST(c_custkey * 7 + 1 AS HUGEINT) AS burn FROM customer),
judged AS (
  SELECT k, CASE WHEN k % 10 = 1 THEN 'retriever_no_result' WHEN k % 10 = 0 THEN 'not_applicable' ELSE 'built' END AS agent_status,
         CASE WHEN 3 * cash < 3 * burn THEN 'critical' WHEN 3 * cash < 6 * burn THEN 'high' WHEN 3 * cash < 12 * burn THEN 'medium' ELSE 'low' END AS level,
         CAST((600 * cash + burn) // (2 * burn) AS BIGINT) AS hundredths, cash FROM c
), chain AS (
SELECT CAST(k AS VARCHAR) AS document_id, agent_status, CASE WHEN agent_status = 'built' THEN level END AS level,
       CASE WHEN agent_status = 'built' THEN CASE level WHEN 'critical' THEN 90.0::DOUBLE WHEN 'high' THEN 80.0 WHEN 'medium' THEN 60.0 ELSE 20.0 END END AS score,
       CASE WHEN agent_status = 'built' THEN concat(hundredths // 100, '.', lpad(CAST(hundredths % 100 AS VARCHAR), 2, '0')) END AS runway,
       CASE WHEN agent_status = 'built' THEN CASE WHEN cash BETWEEN 100 AND 999 THEN 'needs_review' ELSE 'verified' END END AS verification_status
FROM judged
)"""


@query(CHAIN_SQL + "SELECT * FROM chain")
def runway_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, extraction, risk building and verification over the pages of all customers.

    A cell of three digits reads as the end of the number on the line above it, so its page doesn't state it by itself.
    """
    chain = evidence_chain.runway_chain(statement_pages(table(spark, sf_dir, "customer")))
    risks = chain.risks.select("document_id", "level", F.col("score").cast("double").alias("score"), F.col("calculation.result").alias("runway"), "verification_status")
    return chain.statuses.select("document_id", "agent_status").join(risks, "document_id", "left")


@query(
    """
WITH found AS (SELECT o_custkey AS k, o_orderkey % 4 AS i, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS n, bool_or(o_orderkey % 50 = 0) AS lost FROM orders GROUP BY o_custkey, o_orderkey % 4),
risk AS (
  SELECT c_custkey, c_nationkey, score, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AND NOT coalesce(lost, false) AS ok
  FROM customer, (VALUES (0, 78.0::DOUBLE), (1, 72.0::DOUBLE), (2, 66.0::DOUBLE)) v(i, score) LEFT JOIN found ON found.k = c_custkey AND found.i = v.i
)
SELECT CAST(c_custkey AS VARCHAR) AS task_id, 'partial' AS status, count(*) FILTER (WHERE ok) AS verified, count(*) FILTER (WHERE NOT ok) AS pending, CAST(sum(n) AS BIGINT) AS evidence_count,
       round(least(100, coalesce(avg(score) FILTER (WHERE ok), 0) + CASE WHEN c_custkey % 2 = 0 AND c_nationkey * 4 < 50 THEN 15 ELSE 0 END), 6) AS risk_score,
       c_custkey % 2 <> 0 OR count(*) FILTER (WHERE ok) = 0 AS degraded_mode
FROM risk GROUP BY c_custkey, c_nationkey
"""
)
def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with trial agents, one of which fails: customers ask, orders are the evidence found."""
    customer, key = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    task, nothing = F.col("c_custkey").cast("string"), F.lit(None).cast("double")
    codes = F.array(*[F.lit(c) for c in ("continuous_loss", "redemption_rights", "precommercial_product", "weak_ipo_market")])
    state = {
        "requests": customer.select(task.alias("task_id"), F.col("c_name").alias("company_name"), task.alias("stock_code")),
        "pages": statement_pages(customer),
        "market": customer.where("c_custkey % 2 = 0").select(
            task.alias("stock_code"), nothing.alias("hsi_return_5d"), nothing.alias("recent_ipo_break_rate"), nothing.alias("market_volatility"), (F.col("c_nationkey") * 4.0).alias("sentiment_score")
        ),
        "evidence": table(spark, sf_dir, "orders").select(
            F.col("o_custkey").cast("string").alias("task_id"), F.element_at(codes, (key % 4 + 1).cast("int")).alias("risk_code"),
            F.array(F.struct(F.concat(F.lit("e"), key.cast("string")).alias("evidence_id"))).alias("evidence"), F.when(key % 50 == 0, "search_failed").alias("error"),
        ),
    }
    found = pipeline.run(spark, "all", analysis.steps(market="failing"), state)
    of = lambda status: F.count_if(F.col("verification_status") == status).alias(status)
    counts = found.state["verified"].groupBy("task_id").agg(of("verified"), of("pending"), F.sum(F.size("evidence")).alias("evidence_count"))
    predictions = found.state["predictions"].select("task_id", F.round("risk_score", 6).alias("risk_score"), "degraded_mode")
    return counts.join(predictions, "task_id").withColumn("status", F.lit(found.status))


@query(
    """
WITH row AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS page, o_orderkey % 3 = 0 AS blank, o_orderkey % 7 = 0 AS high, o_orderkey % 11 = 0 AS sure, o_orderkey % 13 = 0 AS months FROM orders)
SELECT k, concat_ws('|', CASE WHEN page THEN 'page must be at least 1' END, CASE WHEN blank THEN 'text must not be empty' END) AS page_issues,
       concat_ws('|', CASE WHEN high THEN 'score must lie in 0 to 100' END, CASE WHEN sure THEN 'confidence must lie in 0 to 1' END) AS risk_issues,
       concat_ws('|', CASE WHEN months THEN 'period_months must lie in 1 to 12' END, CASE WHEN page THEN 'page must be at least 1' END) AS metric_issues
FROM row WHERE page OR blank OR high OR sure OR months
"""
)
def domain_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.lit("d").alias("document_id"), F.lit("c").alias("chunk_id"), F.when(k % 5 == 0, 0).otherwise(1).alias("page"), F.when(k % 3 == 0, "").otherwise("x").alias("text"),
        F.lit("cash_runway").alias("risk_code"), F.lit("financial").alias("category"), F.lit("high").alias("level"), F.when(k % 7 == 0, 100.5).otherwise(100.0).alias("score"),
        F.when(k % 11 == 0, -0.1).otherwise(0.0).alias("confidence"), F.lit("cash").alias("metric_name"), F.when(k % 13 == 0, 13).when(k % 2 == 0, 12).alias("period_months"),
    )
    told = {"page_issues": quality.page_messages(), "risk_issues": quality.risk_messages(), "metric_issues": quality.metric_messages()}
    found = rows.select("k", *[F.array_join(m, "|").alias(n) for n, m in told.items()])
    return found.where(" OR ".join(f"{n} <> ''" for n in told))


@query(
    MANIFEST_SQL
    + """, c AS (SELECT CAST(k AS VARCHAR) AS id, k, y, sha, y = '2025' AND k % 3 <> 0 AS blind FROM m)
SELECT 'manifest_rows' AS "check", concat('expected 600, got ', count(*)) AS detail FROM c HAVING count(*) <> 600
UNION ALL SELECT 'year_counts', concat(y, ': expected 100, got ', count(*)) FROM c GROUP BY y HAVING count(*) <> 100
UNION ALL SELECT 'non_portable_relative_path', id FROM c WHERE k % 11 = 0
UNION ALL SELECT 'invalid_sha256', id FROM c WHERE length(sha) <> 64
UNION ALL SELECT 'blind_year_escaped', id FROM c WHERE y = '2025' AND NOT blind
UNION ALL SELECT 'unexpected_parser_status', id FROM c WHERE k % 17 = 0
UNION ALL SELECT 'coverage_left_only', id FROM c WHERE k % 19 = 0
UNION ALL SELECT 'coverage_differs_eod_available', id FROM c WHERE k % 19 <> 0 AND k % 29 = 0
UNION ALL SELECT 'split_differs_dataset_split', id FROM c WHERE k % 31 = 0
UNION ALL SELECT 'development_exception', 'expected 1, got 0'
UNION ALL SELECT 'blind_year_not_marked', id FROM c WHERE y = '2025' AND NOT blind
UNION ALL SELECT 'bridge_repeated', id FROM c WHERE k % 47 = 0
UNION ALL SELECT 'bridge_status_counts', concat(CASE WHEN k % 2 = 0 THEN 'matched' ELSE 'unmatched' END, ': expected 1, got ', count(*)) FROM (SELECT k FROM c UNION ALL SELECT k FROM c WHERE k % 47 = 0) GROUP BY k % 2 HAVING count(*) <> 1
UNION ALL SELECT 'unexpected_source_workbook', id FROM c WHERE k % 37 = 0
UNION ALL SELECT 'unexpected_source_workbook', id FROM c WHERE k % 37 = 0 AND k % 47 = 0
UNION ALL SELECT 'invalid_listed_date_relation', id FROM c WHERE k % 43 = 0
UNION ALL SELECT 'invalid_listed_date_relation', id FROM c WHERE k % 43 = 0 AND k % 47 = 0
UNION ALL SELECT 'matched_row_lacks_listed_date', id FROM c WHERE k % 46 = 0
UNION ALL SELECT 'matched_row_lacks_listed_date', id FROM c WHERE k % 46 = 0 AND k % 47 = 0
"""
)
def catalog_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with the tables that go with it, each with faults of its own."""
    k = F.col("stock_code_raw").cast("long")
    manifest = _manifest(spark, sf_dir).withColumns({"case_id": F.col("stock_code_raw"), "eod_available": (k % 4 == 0).cast("string")})
    coverage = manifest.where(k % 19 != 0).select("case_id", F.when(k % 29 == 0, "unknown").otherwise(F.col("eod_available")).alias("eod_available"))
    marked = (F.col("dataset_split") == "blind_test").cast("string")
    splits = manifest.select("case_id", "stock_code_raw", "source_year", F.when(k % 31 == 0, "other").otherwise(F.col("dataset_split")).alias("dataset_split"), marked.alias("is_blind_test"))
    bridge = manifest.withColumn("copy", F.explode(F.when(k % 47 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "case_id", F.when(k % 37 == 0, "other.xlsx").otherwise("w.xlsx").alias("source_workbook"), F.repeat(F.lit("b"), 64).alias("source_workbook_sha256"),
        F.when(k % 43 == 0, "bogus").otherwise("no_eod_coverage").alias("listed_date_eod_relation"), F.when(k % 2 == 0, "matched").otherwise("unmatched").alias("official_match_status"),
        F.when(k % 46 != 0, "2024-01-01").alias("official_listed_date"),
    )
    return acceptance.catalog_failures(manifest, coverage, splits, bridge, {str(y): 100 for y in range(2020, 2026)}, "w.xlsx", {"matched": 1, "unmatched": 1})


@query(
    """
WITH shape AS (SELECT 262144 AS size, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS bad FROM customer)
SELECT 'SECURITY_MASTER_TRUNCATED' AS issue_code, 'critical' AS severity, 'quarantined' AS status,
       concat('Security master is ', size, ' bytes with ', n, ' records and ', bad, ' malformed rows; truncation is suspected') AS description FROM shape
UNION ALL SELECT 'EOD_AMOUNT_UNIT_UNCONFIRMED', 'warning', 'open', 'The unit of S_DQ_AMOUNT is not confirmed for feature engineering'
"""
)
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_acctbal") < 0).alias("malformed")).withColumn("size", F.lit(262_144))
    return catalog.dataset_issues(shape).select("issue_code", "severity", "status", "description")


@query(
    """
WITH kept AS (SELECT o_custkey, CAST(o_orderkey % 16 AS INTEGER) + 1 AS page, o_orderkey % 3 = 0 AS failed FROM orders),
counted AS (SELECT o_custkey, max(page) AS n, list(page - 1) FILTER (WHERE NOT failed) AS texts FROM kept GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS document_id, n AS page_count,
       coalesce(list_has_any(texts, [0, n // 4, n // 2, n * 3 // 4, n - 1]), false) AS is_text, 'not_run' AS parser_status
FROM counted
"""
)
def inspected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer's document; a third of them could not be read."""
    failed = F.col("o_orderkey") % 3 == 0
    decoded = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 16 + 1).cast("int").alias("page"), F.when(~failed, "text").alias("text"),
        F.when(failed, "page_parse_failure").alias("error_code"), F.when(failed, "page").alias("error"), F.when(failed, F.lit(True)).alias("recoverable"),
    )
    return pages.inspected(decoded).select("document_id", "page_count", "is_text", "parser_status")


@query(
    """
SELECT o_orderkey AS analysis_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'partial' ELSE 'completed' END AS status,
       CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'save_failure' END AS save_error
FROM orders
"""
)
def save_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the results doesn't come back, another comes back with a different total."""
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.lit("completed").alias("status"), F.col("o_totalprice").alias("total"))
    read = results.where("analysis_id % 4 <> 0").withColumn("total", F.when(F.col("analysis_id") % 4 == 1, F.col("total") + 1).otherwise(F.col("total")))
    return sinks.save_outcomes(results, read)
