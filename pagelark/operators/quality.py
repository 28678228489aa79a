"""Data-quality checks: uniqueness, key sets, quotas, domains, manifests. Findings are rows, never exceptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the schema lacks; no job runs."""
    return sorted(set(required) - set(df.columns))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with side `left_only` or `right_only`."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def attribute_differences(left: DataFrame, right: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys of both sides whose attributes differ, with the array of those."""
    renamed = right.select(key, *[F.col(a).alias(f"_r_{a}") for a in attributes])
    differing = F.filter(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"_r_{a}")), F.lit(a)) for a in attributes]), lambda x: x.isNotNull())
    return left.select(key, *attributes).join(renamed, key).select(key, differing.alias("differing")).where(F.size("differing") > 0)


def quota_check(df: DataFrame, group: str, expected: Mapping[str, int]) -> DataFrame:
    """Groups with their count, the expected one and whether they agree; groups on either side only count as 0."""
    spark = df.sparkSession
    want = spark.createDataFrame([(k, int(v)) for k, v in expected.items()], f"{group} string, expected long")
    have = df.groupBy(group).agg(F.count(F.lit(1)).alias("actual"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = have.join(want, group, "full").select(group, zero("actual"), zero("expected"))
    return joined.withColumn("ok", F.col("actual") == F.col("expected"))


def portable_path(path: Column) -> Column:
    """Relative, with slashes only."""
    return ~(path.contains(":") | path.contains("\\") | path.startswith("/")) & (path != "")


def sha256_shape(digest: Column) -> Column:
    return digest.rlike("^[0-9a-f]{64}$")


def upload_issue(path: Column, content: Column, limit: int = 200 << 20) -> Column:
    """Why an uploaded file isn't taken, null if it is."""
    return (
        F.when(~F.lower(path).endswith(".pdf"), "not_a_pdf_name")
        .when(content.isNull() | (F.octet_length(content) == 0), "empty_file")
        .when(F.octet_length(content) > limit, "file_too_large")
        .when(F.substring(content, 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "not_pdf_content")
    )


def violations(checks: Sequence[tuple[Column, str | Column]]) -> Column:
    """Messages of the checks that fail, in order; a null outcome fails."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for ok, m in checks]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def _required(*names: str) -> list[tuple[Column, str]]:
    return [(F.col(n).isNotNull(), f"{n} is required") for n in names]


def _at_least_one(name: str) -> tuple[Column, str]:
    return F.col(name).isNull() | (F.col(name) >= 1), f"{name} must be at least 1"


def _within(name: str, low: float, high: float) -> tuple[Column, str]:
    """NaN counts as outside."""
    return F.col(name).between(low, high), f"{name} must lie in {low} to {high}"


def page_messages() -> Column:
    """Messages of a page of a document: ids, a page from 1 on, some text."""
    return violations([*_required("document_id", "chunk_id", "page"), _at_least_one("page"), (F.length("text") > 0, "text must not be empty")])


def evidence_messages() -> Column:
    """Messages of an evidence row; its page may be unknown."""
    return violations([_at_least_one("page"), (F.length("text") > 0, "text must not be empty"), _within("relevance_score", 0, 1)])


# The domains of a risk.
RISK_CATEGORIES = ("financial", "legal", "business", "market")
RISK_LEVELS = ("low", "medium", "high", "critical")


def risk_messages() -> Column:
    """Messages of a risk row: code, category, level, and score and confidence within their ranges."""
    level = (F.col("level").isin(*RISK_LEVELS), "invalid level")
    return violations([*_required("risk_code"), (F.col("category").isin(*RISK_CATEGORIES), "invalid category"), level, _within("score", 0, 100), _within("confidence", 0, 1)])


def metric_messages() -> Column:
    """Messages of an extracted metric: a name, and months and page within range where they are known."""
    months = F.col("period_months").isNull() | F.col("period_months").between(1, 12)
    return violations([*_required("metric_name"), (months, "period_months must lie in 1 to 12"), _at_least_one("page")])


# Fixed values of the manifest contract.
MANIFEST_COLUMNS = (
    "case_id", "stock_code", "company_name", "document_id", "risk_code", "applicable", "gold_page", "exact_text",
    "expected_status", "expected_level", "reviewer", "second_reviewer", "review_status", "notes",
)
STATUSES = ("verified", "needs_review", "rejected")
LEVELS = ("low", "medium", "high", "critical", "not_applicable")
REVIEW_STATUSES = ("draft", "first_reviewed", "double_reviewed", "adjudicated")


def manifest_messages(risk_codes: Sequence[str]) -> Column:
    """Messages of a manifest row, without its line number; their texts are fixed values of the contract."""
    c = F.col
    applies, denied = c("applicable") == "true", F.coalesce(c("applicable") != "true", F.lit(True))
    page = F.trim(c("gold_page")).try_cast("int")
    return violations(
        [
            *[(stripped(c(f)) != "", f"{f} is required") for f in ("case_id", "stock_code", "company_name", "document_id", "reviewer")],
            (c("risk_code").isin(*risk_codes), F.concat(F.lit("unsupported v0.3 risk_code '"), F.coalesce("risk_code", F.lit("")), F.lit("'"))),
            (c("applicable").isin("true", "false"), "applicable must be true or false"),
            (c("expected_status").isin(*STATUSES), "invalid expected_status"),
            (c("expected_level").isin(*LEVELS), "invalid expected_level"),
            (c("review_status").isin(*REVIEW_STATUSES), "invalid review_status"),
            (denied | F.coalesce(page >= 1, F.lit(False)), "applicable row requires a positive gold_page"),
            (denied | (stripped(c("exact_text")) != ""), "applicable row requires exact_text"),
            (applies | (c("expected_level") == "not_applicable"), "non-applicable row must use not_applicable level"),
        ]
    )


def header_messages(rows: DataFrame) -> list[str]:
    """What is wrong with a manifest's columns, their order included; rows are judged only where it is nothing."""
    return [] if tuple(rows.columns) == MANIFEST_COLUMNS else ["CSV header does not match v03_annotation_v1"]


def validate_manifest(rows: DataFrame, risk_codes: Sequence[str], line: str = "line") -> DataFrame:
    """line and message of each finding; line is the row's number in the file, the header being 1."""
    return rows.select(F.col(line).cast("long").alias("line"), F.explode(manifest_messages(risk_codes)).alias("message"))


def acceptance(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """check and detail (the row as JSON) of every row that a check's DataFrame holds: all failures, not the first."""
    out = None
    for name, found in checks:
        rows = found.select(F.lit(name).alias("check"), F.to_json(F.struct(*found.columns)).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no checks")
    return out
