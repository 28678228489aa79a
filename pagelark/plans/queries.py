"""Registered queries: each applies an operator to provided tables of the right shape, whole tables always.

Next to each stands the SQL it is compared with, where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, ids, periods, policy
from ..functions.text import lines
from ..operators import catalog, evaluation, extraction, merge, quality, retrieval, risks, scoring, verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_chunks_of(docs: DataFrame) -> DataFrame:
    """Each non-blank line of a document as a page of it."""
    numbered = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(lines(F.col("text"))).alias("_i", "text"))
    page = (F.col("_i") + 1).cast("int")
    return numbered.select("document_id", F.concat_ws(":", "document_id", F.lit("page"), page).alias("chunk_id"), page.alias("page"), "text")


LINES = r"""
WITH split AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls
  FROM documents
), chunk AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, concat(doc_id, ':page:', i) AS chunk_id, CAST(i AS INTEGER) AS page, ls[i] AS text
  FROM split, unnest(range(1, len(ls) + 1)) AS t(i)
)
"""


@query(
    """
SELECT user_id, count(*) AS row_count, min(nullif(strftime(ts, '%Y%m%d'), '')) AS first_trade_date,
       max(nullif(strftime(ts, '%Y%m%d'), '')) AS last_trade_date
FROM events GROUP BY user_id
"""
)
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"))
    return catalog.coverage_stats(events, "user_id", "day")


@query(
    """
WITH stats AS (
  SELECT o_custkey, count(*) AS row_count, min(strftime(o_orderdate, '%Y%m%d')) AS first_trade_date
  FROM orders GROUP BY o_custkey
)
SELECT c_custkey, coalesce(row_count, 0) AS row_count, first_trade_date,
       CASE WHEN row_count IS NULL THEN 'false' ELSE 'true' END AS available
FROM customer LEFT JOIN stats ON c_custkey = o_custkey
"""
)
def coverage_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    stats = catalog.coverage_stats(orders, "c_custkey", "day")
    covered = catalog.with_coverage(table(spark, sf_dir, "customer").select("c_custkey"), stats, "c_custkey")
    return covered.select("c_custkey", "row_count", "first_trade_date", (F.col("row_count") > 0).cast("string").alias("available"))


@query(
    """
SELECT o_orderkey,
       CASE WHEN y = 2024 AND code = '00410' THEN 'development_exception' WHEN y BETWEEN 2020 AND 2023 THEN 'development'
            WHEN y = 2024 THEN 'validation' WHEN y = 2025 THEN 'blind_test' ELSE 'quarantined' END AS split,
       CASE WHEN y = 2024 AND code = '00410' THEN 'used_by_v0.2_real_case_001' WHEN y BETWEEN 2020 AND 2023 THEN 'chronological_2020_2023'
            WHEN y = 2024 THEN 'chronological_2024' WHEN y = 2025 THEN 'chronological_2025_holdout' ELSE 'outside_frozen_year_range' END AS reason
FROM (SELECT o_orderkey, year(o_orderdate) + 25 AS y, lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS code FROM orders)
"""
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    split = catalog.chronological_split(F.year("o_orderdate") + 25, F.lpad(F.col("o_custkey").cast("string"), 5, "0"), (2024, "00410"))
    return orders.select("o_orderkey", split.alias("s")).select("o_orderkey", "s.split", "s.reason")


@query(
    """
SELECT c_custkey, CASE WHEN code <> '00000' THEN concat(regexp_replace(code, '^0', ''), '.HK') ELSE '' END AS code,
       CASE WHEN code <> '00000' THEN 'filename_5digit_to_wind_hk_equity' ELSE 'unmatched_invalid_filename_code' END AS method
FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code FROM customer)
"""
)
def code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.listed_code(raw).alias("code"), catalog.code_method(raw).alias("method"))


@query(
    """
WITH item AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'unmatched' ELSE 'matched' END AS status FROM lineitem
), master AS (
  SELECT p_partkey, s_suppkey, p_brand, s_name FROM part JOIN supplier ON s_suppkey = p_partkey % 10
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, status, p_brand AS brand, s_name AS supplier,
       CASE WHEN status = 'matched' AND p_partkey IS NULL THEN 'master_row_missing' END AS bridge_issue
FROM item LEFT JOIN master ON status = 'matched' AND l_partkey = p_partkey AND l_suppkey = s_suppkey
"""
)
def bridge_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "unmatched").otherwise("matched")
    items = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("case_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    master = part.join(supplier, F.col("s_suppkey") == F.col("p_partkey") % 10).select("p_partkey", "s_suppkey", F.col("p_brand").alias("brand"), F.col("s_name").alias("supplier"))
    cases = items.select("case_id", "l_orderkey", "l_linenumber")
    matches = items.select("case_id", "l_partkey", "l_suppkey", "status")
    return catalog.bridge(cases, matches, master, "case_id", ["l_partkey", "l_suppkey"], ["p_partkey", "s_suppkey"]).drop("case_id")


@query(
    """
WITH first AS (SELECT l_orderkey, min(strftime(l_shipdate, '%Y%m%d')) AS d FROM lineitem GROUP BY l_orderkey), pair AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unmatched' ELSE 'matched' END AS status,
         CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS listed,
         CASE WHEN length(d) = 8 THEN concat(d[1:4], '-', d[5:6], '-', d[7:8]) END AS d
  FROM orders LEFT JOIN first ON l_orderkey = o_orderkey
)
SELECT o_orderkey, CASE WHEN status <> 'matched' THEN 'not_applicable_unmatched' WHEN listed = '' THEN 'not_comparable_missing_listed_date'
  WHEN d IS NULL THEN 'no_eod_coverage' WHEN d = listed THEN 'eod_starts_on_listed_date' WHEN d > listed THEN 'eod_starts_after_listed_date'
  ELSE 'eod_starts_before_listed_date' END AS relation
FROM pair
"""
)
def date_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyyMMdd").alias("day"))
    stats = catalog.coverage_stats(items, "o_orderkey", "day")
    listed = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    status = F.when(F.col("o_orderstatus") == "P", "unmatched").otherwise("matched")
    orders = table(spark, sf_dir, "orders").join(stats, "o_orderkey", "left")
    return orders.select("o_orderkey", catalog.listing_relation(status, listed, F.col("first_trade_date")).alias("relation"))


@query(
    """
SELECT CAST(o_custkey AS VARCHAR) AS issue_code, count(*) AS issue_count, arg_max(severity, array_position(['info','warning','error','critical'], severity)) AS max_severity,
       string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses
FROM (SELECT o_custkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity FROM orders)
GROUP BY o_custkey
"""
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "error").when(p == "3-MEDIUM", "warning").otherwise("info")
    issues = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("issue_code"), severity.alias("severity"), F.col("o_orderstatus").alias("status"))
    return catalog.severity_rollup(issues)


@query(
    """
SELECT user_id, event_type, value, event_id, merged_count FROM (
  SELECT user_id, event_type, value, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS merged_count,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r
  FROM events) WHERE r = 1
"""
)
def merge_best_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return merge.first_best(events, ["user_id", "event_type"], "value", ["event_id"], ["value", "event_id"])


@query(
    """
WITH banded AS (
  SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN least(100, CAST(floor(c_acctbal / 100) AS INTEGER)) END AS score FROM customer
), scored AS (
  SELECT c_nationkey, coalesce(avg(score), 0) + CASE WHEN c_nationkey % 3 = 0 THEN 15.0 ELSE 0.0 END AS s, count(score) AS n FROM banded GROUP BY c_nationkey
)
SELECT c_nationkey, round(least(100.0, s), 6) AS risk_score,
       CASE WHEN least(100.0, s) >= 85 THEN 'critical' WHEN least(100.0, s) >= 70 THEN 'high' WHEN least(100.0, s) >= 40 THEN 'medium' ELSE 'low' END AS risk_level,
       n AS verified_count
FROM scored
"""
)
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = F.when(F.col("c_acctbal") > 0, F.least(F.lit(100), F.floor(F.col("c_acctbal") / 100).cast("int")))
    means = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg(verified).alias("mean"), F.count(verified).alias("verified_count"))
    score = scoring.rule_score(F.col("mean"), F.when(F.col("c_nationkey") % 3 == 0, F.lit(40)))
    return means.select("c_nationkey", F.round(score, 6).alias("risk_score"), policy.score_level(score).alias("risk_level"), "verified_count")


RUNWAY_SQL = """
WITH sums AS (
  SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS cash,
         -sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS flow,
         CASE o_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 12 END AS months
  FROM orders GROUP BY o_custkey
), cents AS (SELECT *, CAST(cash * 100 AS HUGEINT) AS c, CAST(-flow * 100 AS HUGEINT) AS b FROM sums)
SELECT o_custkey, CAST(cash AS DOUBLE) AS cash, CAST(flow AS DOUBLE) AS flow, CAST(months AS INTEGER) AS months,
       CASE WHEN b > 0 THEN CAST((200 * c * months + b) // (2 * b) AS DOUBLE) / 100 ELSE -1.0 END AS runway_months,
       CASE WHEN b <= 0 THEN 'not_applicable' WHEN c * months < 3 * b THEN 'critical' WHEN c * months < 6 * b THEN 'high'
            WHEN c * months < 12 * b THEN 'medium' ELSE 'low' END AS level,
       CAST(CASE WHEN b <= 0 THEN 0 WHEN c * months < 3 * b THEN 90 WHEN c * months < 6 * b THEN 80 WHEN c * months < 12 * b THEN 60 ELSE 20 END AS INTEGER) AS score
FROM cents
"""


@query(RUNWAY_SQL)
def runway_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    total = lambda status: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == status, price)), F.lit(0)).cast("decimal(18,2)")
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(total("F").alias("cash"), (-total("O")).cast("decimal(18,2)").alias("flow"))
    months = F.element_at(F.array(*[F.lit(m) for m in policy.PERIOD_MONTHS]), (F.col("o_custkey") % 4 + 1).cast("int"))
    wide = sums.withColumn("months", months)
    cash, flow = (F.col(c).cast(amounts.DECIMAL) for c in ("cash", "flow"))
    ok = policy.runway_failure(cash, flow, F.col("months")).isNull()
    level = policy.runway_level(cash, flow, F.col("months"))
    return wide.select(
        "o_custkey", F.col("cash").cast("double").alias("cash"), F.col("flow").cast("double").alias("flow"), "months",
        F.when(ok, policy.runway_months(cash, flow, F.col("months")).cast("double")).otherwise(-1.0).alias("runway_months"),
        F.when(ok, level["level"]).otherwise("not_applicable").alias("level"),
        F.when(ok, level["score"]).otherwise(0).alias("score"),
    )


@query(LINES + "SELECT document_id, chunk_id, page, length(text) AS n_chars FROM chunk")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = line_chunks_of(table(spark, sf_dir, "documents"))
    return chunks.select("document_id", "chunk_id", "page", F.length("text").cast("long").alias("n_chars"))


@query(
    LINES
    + """, hit AS (
  SELECT *, strpos(lower(text), 'license') AS spot FROM chunk WHERE contains(lower(text), 'license')
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, chunk_id) AS INTEGER) AS rank FROM hit
)
SELECT document_id, rank, page, chunk_id, CAST(0.24 AS DOUBLE) AS relevance_score,
       substring(text, greatest(spot - 450, 1), least(length(text), spot + 6 + 450) - greatest(spot - 450, 1) + 1) AS text
FROM ranked WHERE rank <= 3
"""
)
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = retrieval.prepare(line_chunks_of(table(spark, sf_dir, "documents")))
    found = retrieval.search(prepared, "license", limit=3, across_spaces=False)
    return found.select("document_id", "rank", "page", "chunk_id", F.round("relevance_score", 6).alias("relevance_score"), "text")


@query(
    LINES
    + """, title AS (SELECT document_id, page AS title_page, NOT regexp_matches(text, '[0-9]') AS not_audited FROM chunk WHERE contains(lower(text), 'license')),
near AS (
  SELECT c.document_id, c.page, t.not_audited, c.page - t.title_page AS distance, t.title_page,
         row_number() OVER (PARTITION BY c.document_id, c.page ORDER BY t.not_audited, c.page - t.title_page, t.title_page) AS r
  FROM chunk c JOIN title t ON c.document_id = t.document_id AND c.page - t.title_page BETWEEN 0 AND 4
)
SELECT document_id, page, not_audited, distance, title_page FROM near WHERE r = 1
"""
)
def title_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = line_chunks_of(table(spark, sf_dir, "documents"))
    placed = retrieval.statement_neighborhood(chunks, F.lower("text").contains("license"), F.col("text").rlike("[0-9]"))
    return placed.where("neighborhood IS NOT NULL").select("document_id", "page", "neighborhood.not_audited", "neighborhood.distance", "neighborhood.title_page")


@query(
    LINES
    + """
SELECT a.document_id, a.page, string_agg(b.page, '|' ORDER BY abs(b.page - a.page), b.page) AS context_pages
FROM chunk a JOIN chunk b ON a.document_id = b.document_id AND a.page <> b.page AND abs(a.page - b.page) <= 1
GROUP BY a.document_id, a.page
"""
)
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = extraction.neighbours(line_chunks_of(table(spark, sf_dir, "documents")), ())
    return near.where(F.size("neighbours") > 0).select("document_id", "page", F.array_join(F.transform("neighbours", lambda n: n["page"].cast("string")), "|").alias("context_pages"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM customer")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.format_number(F.abs(F.col("c_acctbal").cast("decimal(18,2)")), 2)
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(printed)
    return table(spark, sf_dir, "customer").select("c_custkey", amounts.amount(text).cast("double").alias("amount"))


@query(
    """
SELECT o_orderkey, CAST(make_date(year(o_orderdate) + 20, month(o_orderdate), day(o_orderdate)) AS VARCHAR) AS period_end,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 12 END AS INTEGER) AS period_months
FROM orders
"""
)
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, word = F.col("o_orderdate"), F.element_at(F.array(*[F.lit(w) for w in ("三", "六", "九", "十二")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.concat(F.lit("截至"), (F.year(d) + 20).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日止"), word, F.lit("個月"))
    read = table(spark, sf_dir, "orders").select("o_orderkey", periods.header(F.array(line)).alias("h"))
    return read.select("o_orderkey", F.col("h.periods")[0]["end"].cast("string").alias("period_end"), F.col("h.periods")[0]["months"].alias("period_months"))


@query(
    """
SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1
"""
)
def latest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"), "l_linenumber", "l_partkey", "l_extendedprice", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    keep = ["ship_date", "l_linenumber", "l_partkey", "l_extendedprice"]
    return merge.first_best(items, ["l_orderkey"], "at", ["l_linenumber", "l_partkey", "l_extendedprice"], keep).drop("merged_count")


@query(
    """
WITH ranked AS (
  SELECT *, row_number() OVER w AS r, first_value(l_returnflag) OVER w AS flag, first_value(l_quantity) OVER w AS quantity FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice)
)
SELECT l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, min(l_orderkey) AS l_orderkey,
       concat_ws('|', CASE WHEN bool_or(r > 1 AND l_returnflag <> flag) THEN 'flag' END, CASE WHEN bool_or(r > 1 AND l_quantity <> quantity) THEN 'quantity' END) AS conflicts
FROM ranked GROUP BY l_partkey, l_shipdate
"""
)
def conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity")
    judged = extraction.conflicts(items, ["l_partkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], {"l_returnflag": "flag", "l_quantity": "quantity"})
    return judged.where("place = 1").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"), "l_orderkey", F.array_join("conflicts", "|").alias("conflicts"))


@query(
    r"""
SELECT doc_id,
       concat_ws('|', CASE WHEN regexp_matches(text, '(?i)\bRMB\b|\bCNY\b') THEN 'CNY' END, CASE WHEN regexp_matches(text, '(?i)HK\$|\bHKD\b') THEN 'HKD' END,
                 CASE WHEN regexp_matches(text, '(?i)US\$|\bUSD\b') THEN 'USD' END) AS currencies,
       concat_ws('|', CASE WHEN regexp_matches(text, '(?i)[''’]000|\bthousand\b') THEN 'thousand' END, CASE WHEN regexp_matches(text, '(?i)\bmillion\b') THEN 'million' END,
                 CASE WHEN regexp_matches(text, '(?i)\bunit\b') THEN 'unit' END) AS units
FROM documents
"""
)
def unit_currency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extraction.currencies(text), "|").alias("currencies"), F.array_join(extraction.units(text), "|").alias("units"))


@query(
    """
WITH found AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 300 AND doc_id IN (SELECT doc_id FROM labels)),
     gold AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
     n AS (SELECT (SELECT count(*) FROM found) AS f, (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM found JOIN gold USING (doc_id)) AS h)
SELECT f AS n_found, g AS n_gold, h AS n_hit, round(h / f, 9) AS precision, round(h / g, 9) AS recall, round(2 * (h / f) * (h / g) / (h / f + h / g), 9) AS f1 FROM n
"""
)
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = table(spark, sf_dir, "documents").where("n_chars >= 300").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    out = evaluation.precision_recall(found, labels.where("quality = 1"), ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    LINES
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY length(text) DESC, page) AS r FROM chunk
), gold AS (SELECT document_id, min(r) AS best, bool_or(r <= 3) AS hit FROM ranked WHERE contains(lower(text), 'license') GROUP BY document_id)
SELECT document_id, hit, CAST(CASE WHEN best <= 3 THEN best ELSE 0 END AS BIGINT) AS best_rank FROM gold
"""
)
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = line_chunks_of(table(spark, sf_dir, "documents"))
    by_length = F.slice(F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("n"), F.col("page").alias("page")))), 1, 3)
    grouped = chunks.groupBy("document_id").agg(
        F.transform(by_length, lambda x: x["page"]).alias("ranked"), F.collect_list(F.when(F.lower("text").contains("license"), F.col("page"))).alias("gold")
    )
    return grouped.where(F.size("gold") > 0).select("document_id", evaluation.hit(F.col("gold"), F.col("ranked"), 3).alias("hit"), F.coalesce(evaluation.best_rank(F.col("gold"), F.col("ranked")), F.lit(0)).alias("best_rank"))


@query(
    """
SELECT source, count(*) FILTER (WHERE length(text) > 0) AS nonblank_page_count,
       round((count(*) - count(*) FILTER (WHERE length(text) > 0)) / count(*), 6) AS empty_text_ratio,
       round_even(sum(length(text)) / count(*) FILTER (WHERE length(text) > 0), 2) AS average_text_chars,
       sum(length(text)) / count(*) FILTER (WHERE length(text) > 0) < 800 AS low_text_density,
       (count(*) - count(*) FILTER (WHERE length(text) > 0)) / count(*) >= 0.8 AS suspected_scan
FROM documents GROUP BY source
"""
)
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.text_density(table(spark, sf_dir, "documents"), F.count(F.lit(1)), "source")


@query(
    """
SELECT conv_id, turn, role, text, first_seq FROM (
  SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1
"""
)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_wins(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query(
    """
WITH risk AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'cash_runway' WHEN 1 THEN 'redemption_rights' ELSE 'unknown_code' END AS risk_code,
         quality AS n_evidence, n_chars % 2 = 0 AS calculated, 60 + 40 * toxic AS score
  FROM labels JOIN documents USING (doc_id)
)
SELECT doc_id, risk_code, CASE WHEN n_evidence = 0 THEN 'pending' WHEN risk_code = 'cash_runway' AND NOT calculated THEN 'needs_review'
  WHEN score > 95 THEN 'rejected' ELSE 'verified' END AS status
FROM risk
"""
)
def verify_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("cash_runway"), F.lit("redemption_rights"), F.lit("unknown_code")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("risk_code", code)
    status = verify.ladder(F.col("quality"), F.col("requires_evidence"), F.col("requires_calculation"), F.col("n_chars") % 2 == 0, 60 + 40 * F.col("toxic"))
    return risks.with_requirements(rows).select("doc_id", "risk_code", status.alias("status"))


@query(
    """
SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right_only' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
"""
)
def keyset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


EXPECTED_SEGMENTS = {"BUILDING": 300, "MACHINERY": 300, "HOUSEHOLD": 300, "AVIATION": 1}


@query(
    """
WITH have AS (SELECT c_mktsegment, count(*) AS actual FROM customer GROUP BY c_mktsegment),
     want AS (SELECT * FROM (VALUES ('BUILDING', 300), ('MACHINERY', 300), ('HOUSEHOLD', 300), ('AVIATION', 1)) v(c_mktsegment, expected))
SELECT coalesce(have.c_mktsegment, want.c_mktsegment) AS c_mktsegment, coalesce(actual, 0) AS actual, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
       coalesce(actual, 0) = coalesce(expected, 0) AS ok
FROM have FULL JOIN want ON have.c_mktsegment = want.c_mktsegment
"""
)
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quota_check(table(spark, sf_dir, "customer"), "c_mktsegment", EXPECTED_SEGMENTS)


@query(
    """
WITH sale AS (
  SELECT s_nationkey, s_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY v DESC, s_suppkey) AS r, sum(v) OVER (PARTITION BY s_nationkey) AS total FROM sale),
pct AS (
  SELECT s_nationkey, CAST(max(v) AS DOUBLE) * 100 / CAST(max(total) AS DOUBLE) AS a, CAST(sum(v) FILTER (WHERE r <= 5) AS DOUBLE) * 100 / CAST(max(total) AS DOUBLE) AS b
  FROM ranked GROUP BY s_nationkey
)
SELECT s_nationkey, round(a, 6) AS largest_pct, round(b, 6) AS top_five_pct,
       CASE WHEN a >= 50 OR b >= 80 THEN 'high' WHEN a >= 30 OR b >= 60 THEN 'medium' END AS level
FROM pct
"""
)
def supplier_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sales = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "s_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    exact = risks.concentration(sales, "s_nationkey", "s_suppkey", "v")
    a, b = F.col("largest_pct").cast("double"), F.col("top_five_pct").cast("double")
    return exact.select("s_nationkey", F.round(a, 6).alias("largest_pct"), F.round(b, 6).alias("top_five_pct"), policy.concentration_level(a, b).alias("level"))


@query(
    """
WITH yearly AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
grown AS (SELECT b.o_custkey, b.y, b.v, (b.v / a.v - 1) * 100 AS g FROM yearly b LEFT JOIN yearly a ON a.o_custkey = b.o_custkey AND a.y = b.y - 1 AND a.v > 0)
SELECT o_custkey, CAST(y AS INTEGER) AS year, round(g, 6) AS growth_pct, CASE WHEN g <= -20 THEN 'high' WHEN g < 0 THEN 'medium' END AS level FROM grown
"""
)
def revenue_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    grown = risks.growth(yearly, ["o_custkey"], "year", "v")
    return grown.select("o_custkey", "year", F.round("growth_pct", 6).alias("growth_pct"), policy.growth_level(F.col("growth_pct")).alias("level"))


@query(
    """
WITH net AS (
  SELECT o_custkey, year(o_orderdate) AS y, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2
), island AS (SELECT o_custkey, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS k FROM net WHERE v < 0),
run AS (SELECT o_custkey, k, count(*) AS n FROM island GROUP BY 1, 2)
SELECT o_custkey, max(n) AS loss_periods, CASE WHEN max(n) >= 3 THEN 'high' WHEN max(n) = 2 THEN 'medium' END AS level FROM run GROUP BY o_custkey
"""
)
def continuous_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    net = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(sign * F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    runs = risks.loss_runs(net, "o_custkey", "y", "v")
    return runs.select("o_custkey", "loss_periods", policy.loss_level(F.col("loss_periods")).alias("level"))


@query(
    """
WITH gold AS (
  SELECT doc_id + 2 AS line, toxic, quality, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'r1' END AS reviewer,
         CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS applicable, CASE WHEN doc_id % 4 = 0 THEN '0' ELSE '3' END AS gold_page,
         CASE WHEN toxic = 1 THEN 'nonsense' ELSE 'litigation' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'not_applicable' END AS expected_level
  FROM labels
)
SELECT line, 'reviewer is required' AS message FROM gold WHERE reviewer = ''
UNION ALL SELECT line, concat('unsupported v0.3 risk_code ''', CASE WHEN toxic = 1 THEN 'nonsense' END, '''') FROM gold WHERE toxic = 1
UNION ALL SELECT line, 'applicable row requires a positive gold_page' FROM gold WHERE applicable = 'true' AND gold_page = '0'
UNION ALL SELECT line, 'non-applicable row must use not_applicable level' FROM gold WHERE applicable = 'false' AND expected_level <> 'not_applicable'
"""
)
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        (d + 2).alias("line"), F.lit("c").alias("case_id"), F.lit("1").alias("stock_code"), F.lit("n").alias("company_name"), d.cast("string").alias("document_id"),
        F.when(F.col("toxic") == 1, "nonsense").otherwise("redemption_rights").alias("risk_code"), F.when(F.col("quality") == 1, "true").otherwise("false").alias("applicable"),
        F.when(d % 4 == 0, "0").otherwise("3").alias("gold_page"), F.lit("text").alias("exact_text"), F.lit("verified").alias("expected_status"),
        F.when(d % 2 == 0, "high").otherwise("not_applicable").alias("expected_level"), F.when(d % 5 == 0, "").otherwise("r1").alias("reviewer"), F.lit("draft").alias("review_status"),
    )
    return quality.validate_manifest(rows, risks.ENABLED)


@query()
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.uuid5(F.concat(F.lit("document:"), F.col("doc_id").cast("string"))).alias("uuid"))


@query(
    """
WITH issue AS (
  SELECT 0 AS phase, 'ORDER_OPEN' AS issue_code, o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 1, 'CUSTOMER_NEGATIVE', c_custkey FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 2, 'SUPPLIER_NEGATIVE', s_suppkey FROM supplier WHERE s_acctbal < 0
)
SELECT concat('DQ-', CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) AS issue_id, issue_code, k
FROM (SELECT *, row_number() OVER (ORDER BY phase, issue_code, k) AS n FROM issue)
"""
)
def issue_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = lambda name, cond, code, key: table(spark, sf_dir, name).where(cond).select(F.lit(code).alias("issue_code"), F.col(key).cast("long").alias("k"))
    phases = [
        phase("orders", "o_orderstatus = 'O'", "ORDER_OPEN", "o_orderkey"),
        phase("customer", "c_acctbal < 0", "CUSTOMER_NEGATIVE", "c_custkey"),
        phase("supplier", "s_acctbal < 0", "SUPPLIER_NEGATIVE", "s_suppkey"),
    ]
    return catalog.numbered_issues(phases, ["issue_code", "k"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
