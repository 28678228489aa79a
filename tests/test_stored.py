"""Stored results: transactions, read-back, pruned lookups; and documents looked at by their pages."""

import os

import pytest
from pyspark.sql import functions as F

from pagelark.sources import pages, stored

ROW = "analysis_id long, status string, total double, words array<string>"


def results(spark, ids, total=1.0):
    return spark.createDataFrame([(i, "completed", total + i, ["現金", '"x"\n', None][: i % 4]) for i in ids], ROW)


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_what_is_written_comes_back_and_later_writes_win(spark, tmp_path):
    path = str(tmp_path / "r")
    stored.save(results(spark, range(50)), path, parts=4)
    stored.save(results(spark, range(40, 60), total=100.0), f"file:{path}", parts=2)
    got = {r.analysis_id: (r.total, r.words) for r in stored.stored(spark, path, ROW).collect()}
    assert got == {i: ((100.0 if i >= 40 else 1.0) + i, ["現金", '"x"\n', None][: i % 4]) for i in range(60)}
    assert {r.status for r in stored.outcomes(spark, path, results(spark, range(60))).collect()} == {"completed"}
    # the number of files follows from the partitions, whatever the number of ids
    assert sum(f.endswith(".parquet") for f in files_below(path)) <= 6
    assert [r.total for r in stored.stored(spark, path, ROW, only="45").collect()] == [145.0] and stored.stored(spark, path, ROW, only="nobody").count() == 0


def test_a_lookup_opens_one_file_of_each_write(spark, tmp_path):
    path = str(tmp_path / "r")
    stored.save(results(spark, range(200)), path, parts=8)
    files = [f for c in stored.commits(path) for f in c["files"]]
    assert len(files) > 4 and sum(f["rows"] for f in files) == 200
    found = stored._Reader({"path": path, "only": "77"}).partitions()
    assert len(found) == 1 and [r[0] for r in stored._Reader({"path": path, "only": "77"}).read(found[0])] == ["77"]
    assert stored._Reader({"path": path, "only": "zzz"}).partitions()[0].file == ""


def test_spoiled_rows_are_partial_and_never_read(spark, tmp_path):
    path, rows = str(tmp_path / "r"), results(spark, range(1, 31))
    stored.save(rows, path, parts=3, fault_modulus=7)
    states = {r.analysis_id: (r.status, r.save_error) for r in stored.outcomes(spark, path, rows.unionByName(results(spark, [99]))).collect()}
    bad = {7, 14, 21, 28, 99}
    assert states == {i: ("partial", "save_failure") if i in bad else ("completed", None) for i in [*range(1, 31), 99]}
    assert {r.analysis_id for r in stored.stored(spark, path, ROW).collect()} == set(range(1, 31)) - bad
    stored.save(results(spark, [7]), path)
    assert {r.save_error for r in stored.outcomes(spark, path, results(spark, [7])).collect()} == {None}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    stored.save(results(spark, range(10)), path, parts=2)
    before = files_below(path)
    hurt = results(spark, range(100, 400)).withColumn("total", F.when(F.col("analysis_id") == 399, F.raise_error(F.lit("injected fault")).cast("double")).otherwise(F.col("total")))
    with pytest.raises(Exception, match="injected fault"):
        stored.save(hurt, path, parts=4)
    assert files_below(path) == before and stored.stored(spark, path, ROW).count() == 10
    with pytest.raises(Exception, match="without an id"):
        stored.save(results(spark, [1]).withColumn("analysis_id", F.lit(None).cast("long")), path)
    with pytest.raises(Exception, match="only added to"):
        results(spark, [1]).select(F.lit("1").alias("id"), F.lit("{}").alias("body")).write.format(stored.NAME).option("path", path).mode("overwrite").save()
    assert files_below(path) == before
    # what isn't listed doesn't exist
    os.remove(next(f for f in before if f.endswith(".json")))
    assert stored.stored(spark, path, ROW).count() == 0


def test_nothing_written(spark, tmp_path):
    path = str(tmp_path / "r")
    assert stored.stored(spark, path, ROW).count() == 0
    stored.save(results(spark, [1]).limit(0), path)
    assert stored.stored(spark, path, ROW).count() == 0 and len(stored.commits(path)) == 1


def test_true_page_counts(spark):
    class Counted(pages.FormFeeds):
        """Fails where more than five pages of a document are decoded."""

        def __init__(self, content):
            super().__init__(content)
            self.decoded = 0

        def __getitem__(self, i):
            self.decoded += 1
            assert self.decoded <= 5
            return super().__getitem__(i)

    texts = {"blank": b"\f\f\f", "first": b"x\f\f\f\f", "sixth": b"\f" * 5 + b"text" + b"\f" * 14, "long": b"p\f" * 999, "empty": b"", "odd": b"\xff\xfe\fok", "one": b"x"}
    files = spark.createDataFrame([(f"/a/{n}.txt", bytearray(c)) for n, c in texts.items()] + [("/a/none.txt", None)], "path string, content binary")
    got = {r.document_id: (r.page_count, r.is_text, r.parser_status, r.error_count) for r in pages.inspect(files, Counted).collect()}
    assert got == {
        "blank": (4, False, "not_run", 0), "first": (5, True, "not_run", 0), "sixth": (20, True, "not_run", 0), "long": (1000, True, "not_run", 0),
        "empty": (0, False, "pdf_metadata_failed", 1), "odd": (2, True, "not_run", 0), "one": (1, True, "not_run", 0), "none": (0, False, "pdf_metadata_failed", 1),
    }
    decoded, counts = pages.pages(files.where("content is not null")), pages.inspect(files)
    told = {r.document_id: (r.page_count, r.is_text, r.parser_status) for r in pages.inspected(decoded, counts=counts).collect()}
    assert told["blank"] == (4, False, "not_run") and told["first"] == (5, True, "not_run")
    assert pages.inspect(files.limit(0)).count() == 0
