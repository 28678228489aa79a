"""Acceptance checks in one pass, held against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelark.operators import acceptance as a

KINDS = "k string, g string, v string, ok boolean"


def _plain(left, right, groups, least):
    out = [("broken", k) for k, _, _, ok in left if not ok]
    out += [("unique", k) for k, n in Counter(r[0] for r in left).items() if n > 1]
    out += [("pair", "/".join(x for x in p if x is not None)) for p, n in Counter((r[0], r[1]) for r in left).items() if n > 1]
    seen = Counter("null" if r[1] is None else r[1] for r in left)
    out += [("group", f"{g}: expected {groups.get(g, 0)}, got {seen[g]}") for g in {*seen, *groups} if seen[g] != groups.get(g, 0)]
    out += [("rows", f"expected 4, got {len(left)}")] * (len(left) != 4)
    few = sum(r[1] == "x" for r in left)
    out += [("few", str(few))] * (few < least)
    keys = [{r[0] for r in side} for side in (left, right)]
    both = {k for k in keys[0] & keys[1] if k is not None}
    out += [("side_left_only", k) for k in keys[0] - both] + [("side_right_only", k) for k in keys[1] - both]
    out += [("side_differs_v", k) for k in both if len({r[2] for r in [*left, *right] if r[0] == k}) > 1]
    return sorted(out, key=str)


@pytest.mark.parametrize(("left", "right"), [
    ([], []),
    ([("1", "x", "p", True), ("2", "y", "q", False), ("2", "y", "q", None), ("3", None, None, True), (None, "x", "p", False), (None, "x", "r", True)], [("1", "", "p", True), ("2", "", "z", True), ("3", "", None, True), ("9", "", "p", True), (None, "", "p", True)]),
    ([("1", "x", None, True)] * 4, [("1", "x", "p", True)] * 2),
])
def test_one_pass_agrees_with_plain_counts(spark, left, right):
    items = [*a.broken("k", [("broken", F.col("ok"))]), a.unique("unique", "k"), a.unique("pair", "k", "g"), a.group("group", "g"), a.counted("rows"), a.counted("few", F.col("g") == "x", kind="least"), *a.aligned("side", 0, "k", ["v"])]
    groups = {"x": 1, "w": 2}
    expected = [("group", "group", groups), ("count", "rows", {"": 4}), ("least", "few", {"": 1})]
    found = a.judged([(spark.createDataFrame(left, KINDS), items), (spark.createDataFrame(right, KINDS), a.aligned("side", 1, "k", ["v"]))], expected)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _plain(left, right, groups, 1)


def test_a_rule_broken_often_under_one_key(spark):
    rows = spark.range(10_001).select(F.lit("same").alias("k"), F.lit(False).alias("ok"))
    assert a.judged([(rows, a.broken("k", [("rule", F.col("ok"))]))], []).where("detail = 'same'").count() == 10_001


def test_each_table_is_scanned_once(spark, tmp_path):
    names = "case_id stock_code_raw source_year relative_path sha256 dataset_split parser_status eod_available is_blind_test source_workbook source_workbook_sha256 listed_date_eod_relation official_match_status official_listed_date"
    spark.createDataFrame([], ", ".join(f"{n} string" for n in names.split())).write.parquet(str(tmp_path / "t"))
    tables = [spark.read.parquet(str(tmp_path / "t")) for _ in range(4)]
    plan = a.catalog_failures(*tables, {"2024": 1}, "w.xlsx", {"matched": 1})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("Exchange hashpartitioning") == 1


def test_rows_of_one_task_are_dealt_out(spark):
    rows = spark.range(0, 20_000, 1, 1).select(F.col("id").cast("string").alias("k"))
    where = F.concat(F.lit("task "), F.spark_partition_id())
    found = a.judged([(rows, [F.when(F.spark_partition_id() >= 0, a._item("group", "rows", where))])], [])
    held = [int(r.detail.rsplit(" ", 1)[1]) for r in found.collect()]
    assert sum(held) == 20_000 and max(held) <= 20_000 // (a.SHARES * 4) * 1.2


def test_a_manifest_is_judged_without_sorting(spark):
    manifest = spark.createDataFrame([], ", ".join(f"{n} string" for n in [*a.MANIFEST, "unused"]))
    plan = a.manifest_failures(manifest, {"2024": 1})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "RoundRobin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_rows_are_dealt_alike_in_any_order_and_copies_spread_by_part(spark):
    rows = spark.range(0, 4_000, 1, 8).select(F.col("id").cast("string").alias("k"), (F.col("id") % 500).alias("at"))
    dealt = lambda df: sorted((r.k, r.share) for r in a._dealt(df, 16).select("k", F.spark_partition_id().alias("share")).collect())
    there = dealt(rows.sortWithinPartitions("at"))
    assert len(there) == 4_000 and there == dealt(rows.sortWithinPartitions(F.desc("at")))
    copies = spark.range(0, 8_000, 1, 8).select(F.lit("same").alias("k"))
    held = a._dealt(copies, 16).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 8_000 and len(held) > 2


@pytest.mark.parametrize("values", [["p", "q"], ["p", None], [None, None], ["p", "p"]])
def test_attributes_are_compared_whole_beside_items_without_one(spark, values):
    left = spark.createDataFrame([("1", values[0])], "k string, v string")
    right = spark.createDataFrame([("1", values[1])], "k string, v string")
    found = a.judged([(left, [a.unique("unique", "k"), F.when(F.col("k") == "1", a.aligned("side", 0, "k", ["v"])[1]), a.aligned("side", 0, "k")[0]]), (right, a.aligned("side", 1, "k", ["v"]))], [])
    assert [tuple(r) for r in found.collect()] == [("side_differs_v", "1")] * (values[0] != values[1])
