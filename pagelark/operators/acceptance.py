"""Acceptance of a catalog and of a review sample: every failed check is a row, none hides another.

Each table of a contract is scanned once. A row gives items: the rules that it breaks, its keys, its group, its part of a
count. Items of one check and key are counted together, map-side first, so that all checks of all tables cost one shuffle;
what was expected comes in as items of constants. Most keys occur once, so a task holds about all items of its rows: rows are
dealt out by a hash before they are made into items, lest a task's memory follow the size of a file's parts. Only where
attributes are compared do values have to be sorted; else a key costs a few counters. Each check gives rows of check and
detail, and no rows mean that the catalog is accepted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import portable_path, sha256_shape

# Fixed values of the catalog contract.
MANIFEST = ("case_id", "stock_code_raw", "source_year", "relative_path", "sha256", "dataset_split", "parser_status")
COVERAGE = ("case_id", "eod_available")
SPLITS = ("case_id", "stock_code_raw", "source_year", "dataset_split", "is_blind_test")
BRIDGE = (
    "case_id", "source_workbook", "source_workbook_sha256", "listed_date_eod_relation", "official_match_status", "official_listed_date",
)
SAMPLE = ("case_id", "stock_code_raw", "source_year", "archive_filename", "source_filename", "manual_review", "selection_tags")
RELATIONS = (
    "not_applicable_unmatched", "not_comparable_missing_listed_date", "no_eod_coverage", "eod_starts_on_listed_date",
    "eod_starts_after_listed_date", "eod_starts_before_listed_date",
)
PARSER_STATUSES = ("not_run", "pdf_metadata_failed")
SAMPLE_SPLITS = ("development", "validation")
BLIND_YEAR, EXCLUDED_CODE, SPARSE_TAG = "2025", "02410", "low_text_density"


#: Tasks a core among which a table's rows are dealt out.
SHARES = 4
#: Rows of one broken rule that are made at once from their count.
REPEAT = 4096
#: An attribute's value; null is a value too.
VALUE = "struct<blank:boolean,text:string>"


def _item(kind: str, check: str, key: Column, detail: Column | None = None, side: int = 0, value: Column | None = None, n: int = 1, expected: int = 0) -> Column:
    """detail: what a failure shows; without one it is the key."""
    held = F.lit(None).cast(VALUE) if value is None else F.struct(value.isNull().alias("blank"), value.cast("string").alias("text"))
    parts = {"kind": F.lit(kind), "check": F.lit(check), "key": key, "detail": F.lit(None).cast("string") if detail is None else detail, "side": F.lit(side), "value": held, "n": F.lit(n).cast("bigint"), "expected": F.lit(expected).cast("bigint")}
    return F.struct(*[part.alias(name) for name, part in parts.items()])


def broken(key: str, rules: Sequence[tuple[str, Column]]) -> list[Column]:
    """Rules that a row breaks, each a row with the key; a null outcome breaks a rule."""
    name = F.col(key).cast("string")
    return [F.when(~F.coalesce(ok, F.lit(False)), _item("broken", check, name)) for check, ok in rules]


def unique(check: str, *keys: str) -> Column:
    """Keys that occur more than once, each a row."""
    parts = [F.col(k).cast("string") for k in keys]
    return _item("unique", check, F.to_json(F.array(*parts)), F.concat_ws("/", *parts)) if len(parts) > 1 else _item("unique", check, parts[0])


def group(check: str, name: str) -> Column:
    """Groups whose count is another than expected."""
    value = F.col(name).cast("string")
    return _item("group", check, value)


def counted(check: str, only: Column | None = None, kind: str = "count") -> Column:
    """The number of rows, or of those for which only holds, against the expected one; kind least: at least that many."""
    item = _item(kind, check, F.lit(""))
    return item if only is None else F.when(only, item)


def aligned(check: str, side: int, key: str, attributes: Sequence[str] = ()) -> list[Column]:
    """Keys that one of two sides (0 left, 1 right) lacks, and keys of both whose attributes differ.

    Null keys are no one's partner. A repeated key fails once for an attribute, if any two of its values differ.
    """
    name = F.col(key).cast("string")
    return [_item("key", check, name, side=side), *[_item("value", f"{check}_differs_{a}", name, side=side, value=F.col(a)) for a in attributes]]


def _dealt(df: DataFrame, shares: int) -> DataFrame:
    """Rows dealt out by their columns and the part that they come from, so that a task run again deals them alike.

    Unlike repartition(shares) it sorts no part first. Copies of one row spread as their parts do.
    """
    place = F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(shares)).cast("int")
    return df.withColumn("_share", place).repartitionById(shares, "_share")


def _valued(df: DataFrame, items: Sequence[Column]) -> bool:
    """Whether any item carries an attribute's value, which its type tells; no job runs."""
    return any(not item.dataType["value"].nullable for item in df.select(*items).schema)


def judged(tables: Sequence[tuple[DataFrame, Sequence[Column]]], expected: Sequence[tuple[str, str, Mapping[str, int]]]) -> DataFrame:
    """check and detail of all that fails. tables: each with the items of its rows; expected: kind, check and the count for
    each key (the empty one for counts), so that what has no rows is judged too."""
    wanted = [_item(kind, check, F.lit(key), n=0, expected=int(n)) for kind, check, counts in expected for key, n in counts.items()]
    spark = tables[0][0].sparkSession
    shares = SHARES * spark.sparkContext.defaultParallelism
    sides = [_dealt(df, shares).select(F.explode(F.array_compact(F.array(*items))).alias("i")) for df, items in tables]
    if wanted:
        sides.append(spark.range(1).select(F.explode(F.array(*wanted)).alias("i")))
    items = sides[0]
    for more in sides[1:]:
        items = items.unionAll(more)
    n, side = F.sum("n"), lambda at: F.count_if(F.col("side") == at) > 0
    differs = F.min("value") != F.max("value") if any(_valued(*t) for t in tables) else F.lit(False)
    tally = items.select("i.*").groupBy("kind", "check", "key", "detail").agg(
        n.alias("n"), F.sum("expected").alias("expected"), side(0).alias("left"), side(1).alias("right"), differs.alias("differs")
    ).withColumn("detail", F.coalesce("detail", "key"))
    kind, row = F.col("kind"), lambda check, detail: F.struct(check.alias("check"), detail.alias("detail"))
    itself, off = row(F.col("check"), F.col("detail")), F.col("n") != F.col("expected")
    paired = F.col("left") & F.col("right") & F.col("key").isNotNull()
    alone = lambda has, which: F.when(F.col(has) & ~paired, row(F.concat("check", F.lit(which)), F.col("detail")))
    found = (
        F.when(kind == "unique", F.array(F.when(F.col("n") > 1, itself)))
        .when(kind == "group", F.array(F.when(off, row(F.col("check"), F.format_string("%s: expected %d, got %d", "detail", "expected", "n")))))
        .when(kind == "count", F.array(F.when(off, row(F.col("check"), F.format_string("expected %d, got %d", "expected", "n")))))
        .when(kind == "least", F.array(F.when(F.col("n") < F.col("expected"), row(F.col("check"), F.col("n").cast("string")))))
        .when(kind == "key", F.array(alone("left", "_left_only"), alone("right", "_right_only")))
        .when(kind == "value", F.array(F.when(paired & F.col("differs"), itself)))
    )
    # a rule may be broken by any number of rows under one key, so their rows are made a few at a time
    starts = F.when(kind == "broken", F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(REPEAT).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    few = tally.withColumn("_from", F.explode(starts))
    rows = F.when(kind == "broken", F.array_repeat(itself, F.least(F.col("n") - F.col("_from"), F.lit(REPEAT)).cast("int"))).otherwise(F.array_compact(found))
    return few.select(F.explode(rows).alias("f")).select("f.*")


def _manifest(years: Mapping[str, int]) -> tuple[list[Column], list[tuple[str, str, Mapping[str, int]]]]:
    """Items of a manifest's rows, and what is expected of them."""
    year = F.col("source_year").cast("string")
    rules = [
        ("non_portable_relative_path", portable_path(F.col("relative_path"))),
        ("invalid_sha256", sha256_shape(F.col("sha256"))),
        ("blind_year_escaped", (year != BLIND_YEAR) | (F.col("dataset_split") == "blind_test")),
        ("unexpected_parser_status", F.col("parser_status").isin(*PARSER_STATUSES)),
    ]
    items = [counted("manifest_rows"), group("year_counts", "source_year"), unique("case_id_repeated", "case_id"), unique("stock_code_raw_repeated", "stock_code_raw"), *broken("case_id", rules)]
    return items, [("count", "manifest_rows", {"": sum(years.values())}), ("group", "year_counts", years)]


def manifest_failures(manifest: DataFrame, years: Mapping[str, int]) -> DataFrame:
    """Failures of a manifest by itself."""
    items, expected = _manifest(years)
    return judged([(manifest.select(*MANIFEST), items)], expected)


def catalog_failures(manifest: DataFrame, coverage: DataFrame, splits: DataFrame, bridge: DataFrame, years: Mapping[str, int], workbook: str, statuses: Mapping[str, int]) -> DataFrame:
    """Failures of a manifest and of the tables that go with it."""
    matched = F.col("official_match_status") == "matched"
    bridge_rules = [
        ("unexpected_source_workbook", F.col("source_workbook") == workbook),
        ("invalid_workbook_sha256", sha256_shape(F.col("source_workbook_sha256"))),
        ("invalid_listed_date_relation", F.col("listed_date_eod_relation").isin(*RELATIONS)),
        ("matched_row_lacks_listed_date", ~matched | (F.coalesce("official_listed_date", F.lit("")) != "")),
    ]
    blind = (F.col("source_year").cast("string") != BLIND_YEAR) | (F.col("is_blind_test") == "true")
    exception = (F.col("stock_code_raw") == EXCLUDED_CODE) & (F.col("dataset_split") == "development_exception")
    items, expected = _manifest(years)
    eod, split = ("coverage", ["eod_available"]), ("split", ["dataset_split"])
    side = lambda at, check, attributes=(): aligned(check, at, "case_id", attributes)
    tables = [
        (manifest.select(*MANIFEST, "eod_available"), [*items, *side(0, *eod), *side(0, *split), *side(0, "bridge")]),
        (coverage.select(*COVERAGE), [*side(1, *eod), unique("coverage_repeated", "case_id")]),
        (splits.select(*SPLITS), [*side(1, *split), unique("split_repeated", "case_id"), counted("development_exception", exception), *broken("case_id", [("blind_year_not_marked", blind)])]),
        (bridge.select(*BRIDGE), [*side(1, "bridge"), unique("bridge_repeated", "case_id"), group("bridge_status_counts", "official_match_status"), *broken("case_id", bridge_rules)]),
    ]
    return judged(tables, [*expected, ("count", "development_exception", {"": 1}), ("group", "bridge_status_counts", statuses)])


def sample_failures(sample: DataFrame, quotas: Mapping[str, int], manual: int, sparse: int) -> DataFrame:
    """Failures of a review sample by itself: size, uniqueness, quotas, reviews by hand, exclusions, sparse documents."""
    year = F.col("source_year").cast("string")
    rules = [
        ("blind_year_in_sample", (year != BLIND_YEAR) & ~F.col("archive_filename").startswith(f"{BLIND_YEAR}_")),
        ("development_case_in_sample", F.col("stock_code_raw") != EXCLUDED_CODE),
    ]
    items = [
        counted("sample_rows"), unique("case_id_repeated", "case_id"), unique("archive_source_repeated", "archive_filename", "source_filename"), group("year_quotas", "source_year"),
        counted("manual_reviews", F.col("manual_review") == "true"), *broken("case_id", rules),
        counted("too_few_sparse_documents", F.array_contains(F.split("selection_tags", r"\|"), SPARSE_TAG), kind="least"),
    ]
    expected = [("count", "sample_rows", {"": sum(quotas.values())}), ("group", "year_quotas", quotas), ("count", "manual_reviews", {"": manual}), ("least", "too_few_sparse_documents", {"": sparse})]
    return judged([(sample.select(*SAMPLE), items)], expected)


def sample_alignment(sample: DataFrame, manifest: DataFrame) -> DataFrame:
    """Failures of the sample's rows against the manifest under (source_year, stock_code_raw).

    A key that the sample repeats fails once; of its rows the first by case_id is compared.
    """
    keys = ["source_year", "stock_code_raw"]
    facts = ["source_filename", "stock_code_wind", "relative_path", "sha256", "dataset_split"]
    side = manifest.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in facts], F.lit(True).alias("_there"))
    one = sample.groupBy(*keys).agg(F.min(F.struct("case_id", "source_filename", "stock_code_wind")).alias("_s"), F.count(F.lit(1)).alias("_n")).select(*keys, "_n", "_s.*")
    found = one.join(side, keys, "left")
    there = F.coalesce("_there", F.lit(False))
    where_there = lambda ok: ~there | ok
    rules = [
        ("missing_from_manifest", there),
        ("filename_differs", where_there(F.col("source_filename") == F.col("_m_source_filename"))),
        ("wind_code_differs", where_there(F.col("stock_code_wind") == F.col("_m_stock_code_wind"))),
        ("relative_path_differs", where_there(F.substring_index("_m_relative_path", "/", -1) == F.col("source_filename"))),
        ("manifest_sha256_invalid", where_there(sha256_shape(F.col("_m_sha256")))),
        ("disallowed_split", where_there(F.col("_m_dataset_split").isin(*SAMPLE_SPLITS))),
        ("frozen_exclusion", where_there((F.col("source_year").cast("string") != BLIND_YEAR) & (F.col("stock_code_raw") != EXCLUDED_CODE))),
    ]
    row = lambda check, detail: F.struct(F.lit(check).alias("check"), detail.alias("detail"))
    failed = [F.when(~F.coalesce(ok, F.lit(False)), row(check, F.col("case_id").cast("string"))) for check, ok in rules]
    repeated = F.when(F.col("_n") > 1, row("sample_key_repeated", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    return found.select(F.explode(F.array_compact(F.array(repeated, *failed))).alias("f")).select("f.*")


def batch_outcomes(cases: DataFrame, pages: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each case of a batch: parser_status, failure_code, counts of pages and errors; no case stops another.

    pages is what the page scan gives, error rows included, with the case as document_id; failures of unpacking come as
    cases' failure_code. P-01 is a document that can't be read, P-02 one without text, P-05 one with failed pages.
    """
    bad = F.col("error_code").isNotNull()
    fatal = bad & ~F.coalesce("recoverable", F.lit(False))
    read = pages.groupBy(F.col("document_id").alias(case)).agg(
        F.count_if(~bad).alias("nonblank_page_count"), F.count_if(bad & ~fatal).alias("parser_error_count"), F.min(F.when(fatal, F.col("error_code"))).alias("_fatal")
    )
    unpacked = F.col("failure_code") if "failure_code" in cases.columns else F.lit(None).cast("string")
    failure = (
        F.when(unpacked.isNotNull(), "P-01")
        .when(F.col("_fatal") == "empty_pdf", "P-02")
        .when(F.col("_fatal").isNotNull() | F.col("nonblank_page_count").isNull(), "P-01")
        .when(F.col("parser_error_count") > 0, "P-05")
    )
    status = F.when(F.col("_code").isNull(), "completed").when(F.col("_code") == "P-05", "partial").otherwise("failed")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        cases.join(read, case, "left")
        .withColumn("_code", failure)
        .select(case, status.alias("parser_status"), F.coalesce("_code", F.lit("")).alias("failure_code"), zero("nonblank_page_count"), zero("parser_error_count"))
    )
