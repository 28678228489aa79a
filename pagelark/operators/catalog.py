"""Catalog building: coverage, codes, splits, bridges, issues.

Every operator takes and returns DataFrames, and but for numbering none runs a job. A side that is a small dimension is left to Spark's
own size estimate rather than forced into a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

#: The case that was used for development though its year belongs to validation; fixed values.
EXCEPTION_YEAR, EXCEPTION_CODE = 2024, "02410"

#: Symbols of a master's rows that only describe its columns; fixed values.
HEADER_NOISE = ("", "股票代码")

#: Order of severities; fixed values.
SEVERITIES = ("info", "warning", "error", "critical")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_non_blank(*columns: Column) -> Column:
    """The first that isn't blank, else a blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def truth(x: Column) -> Column:
    """"true" or "false" of a boolean-like text."""
    return F.when(F.lower(F.trim(x)).isin("true", "1", "yes", "y"), "true").otherwise("false")


def notes(*parts: Column) -> Column:
    """Those that aren't null, joined by semicolons."""
    return F.concat_ws("; ", *parts)


def listed_code(raw: Column) -> Column:
    """Exchange code of a five-digit code: exactly one leading zero goes; blank where the code is invalid."""
    valid = raw.rlike(r"^(?U)\d{5}$") & (raw != "00000")
    return F.when(valid, F.concat(F.regexp_replace(raw, "^0", ""), F.lit(".HK"))).otherwise("")


def code_method(raw: Column) -> Column:
    return F.when(listed_code(raw) != "", "filename_5digit_to_wind_hk_equity").otherwise("unmatched_invalid_filename_code")


def chronological_split(year: Column, code: Column, exception: tuple[int, str] = (EXCEPTION_YEAR, EXCEPTION_CODE)) -> Column:
    """struct<split, reason>; the exception comes first."""
    value = lambda split, reason: F.struct(F.lit(split).alias("split"), F.lit(reason).alias("reason"))
    return (
        F.when((year == exception[0]) & (code == exception[1]), value("development_exception", "used_by_v0.2_real_case_001"))
        .when(year.between(2020, 2023), value("development", "chronological_2020_2023"))
        .when(year == 2024, value("validation", "chronological_2024"))
        .when(year == 2025, value("blind_test", "chronological_2025_holdout"))
        .otherwise(value("quarantined", "outside_frozen_year_range"))
    )


def dashed_date(compact: Column) -> Column:
    """yyyyMMdd with dashes; other texts as they are."""
    return F.regexp_replace(compact, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def listing_relation(status: Column, listed: Column, first_trade: Column) -> Column:
    """How the first trade stands to the listing date; both are texts, blank or null where missing."""
    trade = dashed_date(first_trade)
    missing = lambda x: x.isNull() | (x == "")
    return (
        F.when(~status.eqNullSafe("matched"), "not_applicable_unmatched")
        .when(missing(listed), "not_comparable_missing_listed_date")
        .when(missing(first_trade), "no_eod_coverage")
        .when(trade == listed, "eod_starts_on_listed_date")
        .when(trade > listed, "eod_starts_after_listed_date")
        .otherwise("eod_starts_before_listed_date")
    )


def coverage_stats(facts: DataFrame, key: str, date: str) -> DataFrame:
    """row_count, first_trade_date and last_trade_date of each key; blank dates count as rows only."""
    day = blank_to_null(F.col(date))
    return facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(day).alias("first_trade_date"), F.max(day).alias("last_trade_date")
    )


def dataset_shape(facts: DataFrame, key: str, corrupt: str = "_corrupt_record") -> DataFrame:
    """rows, unique_codes (well-formed rows only) and malformed_rows of a permissively read table."""
    bad = F.col(corrupt).isNotNull() if corrupt in facts.columns else F.lit(False)
    return facts.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(~bad, F.col(key))).alias("unique_codes"), F.count_if(bad).alias("malformed_rows")
    )


def with_coverage(cases: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """cases with their coverage; without any, the count is 0 and the dates are null."""
    return cases.join(stats, key, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def bridge(cases: DataFrame, matches: DataFrame, master: DataFrame, case_key: str, match_keys: Sequence[str], master_keys: Sequence[str], status: str = "status") -> DataFrame:
    """cases with their match and, where that is "matched", the master row under the composite key.

    A matched row without a master row keeps nulls and bridge_issue tells; so it does where the master repeats the key, of
    whose rows the first stands. No row is dropped or multiplied.
    """
    rest = [c for c in master.columns if c not in master_keys]
    side = (
        master.groupBy(*[F.col(k).alias(f"_m_{k}") for k in master_keys])
        .agg(F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_found"))
        .select(*[f"_m_{k}" for k in master_keys], *[F.col(f"_row.{c}").alias(c) for c in rest], "_found")
    )
    on = [F.col(a) == F.col(f"_m_{b}") for a, b in zip(match_keys, master_keys)]
    matched = F.col(status) == "matched"
    joined = cases.join(matches, case_key, "left").join(side, on=[matched, *on], how="left")
    issue = (
        F.when(F.col(status).isNull(), "match_row_missing")
        .when(matched & F.col("_found").isNull(), "master_row_missing")
        .when(F.col("_found") > 1, "master_key_repeated")
    )
    return joined.withColumn("bridge_issue", issue).drop("_found", *[f"_m_{k}" for k in master_keys])


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def severity_rollup(issues: DataFrame, code: str = "issue_code", severity: str = "severity", status: str = "status", rank: Column | None = None) -> DataFrame:
    """issue_count, the highest severity and the sorted distinct statuses of each code."""
    order = severity_rank(F.col(severity)) if rank is None else rank
    return issues.groupBy(code).agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.max_by(severity, order).alias("max_severity"),
        F.array_join(F.array_sort(F.collect_set(status)), ", ").alias("statuses"),
    )


def numbered_issues(phases: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Issues of all phases with DQ-0001, DQ-0002, ...: phase by phase, each in the given order.

    A plain row number would bring all issues to one task, and one for each code those of a frequent code. Rows are ranged
    over partitions in the total order instead, and kept there; each partition is numbered by itself and shifted by the
    counts of the partitions before it.
    """
    tagged = None
    for i, phase in enumerate(phases):
        part = phase.withColumn("_phase", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    ranged = tagged.repartitionByRange("_phase", *order).withColumn("_part", F.spark_partition_id())
    ranged = Workspace(tagged.sparkSession).keep(ranged, "issues")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_phase", *order))
    return ranged.join(starts, "_part").withColumn("issue_id", F.format_string("DQ-%04d", number)).drop("_phase", "_part", "_before")


def coverage_issues(manifest: DataFrame) -> DataFrame:
    """Case issues of a manifest with case_id, relative_path, stock_code_wind, eod_available, parser_status, parser_message."""
    fixed = lambda **kw: [F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in kw.items()]
    no_rows = manifest.where(~F.col("eod_available").eqNullSafe("true")).select(
        *fixed(scope="case", case_id=F.col("case_id"), source_file="hkshareeodprices.csv", issue_code="EOD_NOT_AVAILABLE", severity="warning",
               status="accepted_degradation", description=F.concat("stock_code_wind", F.lit(" has no matching EOD rows")),
               recommended_action="Use for document-chain and degradation tests only")
    )
    failed = manifest.where("parser_status = 'pdf_metadata_failed'").select(
        *fixed(scope="case", case_id=F.col("case_id"), source_file=F.col("relative_path"), issue_code="PDF_METADATA_FAILED", severity="error",
               status="open", description=F.col("parser_message"), recommended_action="Inspect or replace the source PDF")
    )
    return no_rows.unionByName(failed)


def dataset_issues(shape: DataFrame) -> DataFrame:
    """Issues of the dataset as a whole, from one row of size, rows and malformed of the security master.

    The unit of traded amounts is always an open issue; a master that looks cut off is another, before it.
    """
    cut = truncated(F.col("size"), F.col("malformed"))
    fixed = lambda **kw: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in kw.items()])
    found = F.format_string("Security master is %d bytes with %d records and %d malformed rows; truncation is suspected", "size", "rows", "malformed")
    master = fixed(
        scope="dataset", case_id="", source_file="hksharedescription.csv", issue_code="SECURITY_MASTER_TRUNCATED", severity="critical",
        status="quarantined", description=found, recommended_action="Do not derive listing date, issue price or company mapping until replaced",
    )
    unit = fixed(
        scope="dataset", case_id="", source_file="hkshareeodprices.csv", issue_code="EOD_AMOUNT_UNIT_UNCONFIRMED", severity="warning",
        status="open", description=F.lit("The unit of S_DQ_AMOUNT is not confirmed for feature engineering"),
        recommended_action="Confirm against the official data dictionary before v0.4",
    )
    return shape.select(F.explode(F.when(cut, F.array(master, unit)).otherwise(F.array(unit))).alias("issue")).select("issue.*")


def bridge_issues(bridged: DataFrame, workbook: str) -> DataFrame:
    """Gaps of a bridge with case_id, official_match_status and has_institution_info."""
    unmatched = ~F.col("official_match_status").eqNullSafe("matched")
    lacking = ~unmatched & ~F.lower("has_institution_info").eqNullSafe("true")
    pick = lambda a, b: F.when(unmatched, a).otherwise(b)
    return bridged.where(unmatched | lacking).select(
        F.lit("case").alias("scope"), "case_id", F.lit(workbook).alias("source_file"),
        pick("OFFICIAL_IPO_MASTER_MATCH_MISSING", "OFFICIAL_IPO_INSTITUTION_INFO_MISSING").alias("issue_code"),
        F.lit("warning").alias("severity"), pick("open", "accepted_degradation").alias("status"),
        pick("No official IPO master row was supplied for this prospectus case", "Official IPO record is matched but InstitutionInfo is unavailable").alias("description"),
        pick("Retain as unavailable; review the official-source matching workflow before enrichment", "Use available IPO fields only; do not infer missing company-profile values").alias("recommended_action"),
    )


def without_header_noise(master: DataFrame, symbol: str = "Symbol") -> DataFrame:
    """The master's rows without the descriptions below its header."""
    return master.where(F.col(symbol).isNotNull() & ~F.col(symbol).isin(*HEADER_NOISE))


def with_annotation_status(manifest: DataFrame, sample: DataFrame, code: str = "stock_code_raw", exception: str = EXCEPTION_CODE) -> DataFrame:
    """manifest with annotation_status: reviewed by hand or automatically if the sample holds its code, else unreviewed."""
    by_hand = F.lower("manual_review").eqNullSafe("true")
    side = sample.groupBy(code).agg(F.max_by(F.when(by_hand, "shadow_manual_reviewed").otherwise("shadow_automatic"), by_hand.cast("int")).alias("_status"))
    status = F.when(F.col(code) == exception, "provisional_gold").otherwise(F.coalesce("_status", F.lit("unreviewed")))
    return manifest.join(side, code, "left").withColumn("annotation_status", status).drop("_status")


def truncated(size: Column, malformed: Column, limit: int = 262_144) -> Column:
    """Whether a table looks cut off: it ends at the limit, or has malformed rows."""
    return (size == limit) | (malformed > 0)
