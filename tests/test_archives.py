"""Archives, long documents and sheets, read in parts."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelark.sources import archives, pages, tables


class Counting(io.FileIO):
    """A file that counts the bytes read from it."""

    total = 0

    def read(self, size=-1):
        found = super().read(size)
        Counting.total += len(found)
        return found


def test_members_are_read_by_seeking(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(50):
            z.writestr(f"in/{i}.pdf", bytes([i]) * 100_000)
    monkeypatch.setattr(archives, "_opened", lambda path: Counting(path))
    Counting.total, held = 0, archives._Archives()
    assert held.member(str(tmp_path / "z.zip"), "7.pdf") == (b"\x07" * 100_000, None)
    assert held.member(str(tmp_path / "z.zip"), "in/8.pdf") == (b"\x08" * 100_000, None)
    held.close()
    assert Counting.total < 300_000  # of five million bytes


def test_members_and_failures(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a+b 1.zip", "w") as z:
        z.writestr("x/p.pdf", b"one")
        z.writestr("p.pdf", b"two")
        z.writestr("empty.pdf", b"")
    broken = bytearray((tmp_path / "a+b 1.zip").read_bytes())
    broken[broken.index(b"two")] ^= 1
    (tmp_path / "c.zip").write_bytes(bytes(broken))
    (tmp_path / "no.zip").write_bytes(b"")
    ask = [("a+b 1.zip", "p.pdf"), ("a+b 1.zip", "x/p.pdf"), ("a+b 1.zip", "empty.pdf"), ("a+b 1.zip", None), ("c.zip", "p.pdf"), ("c.zip", "x/p.pdf"), ("gone.zip", "p.pdf"), (None, "p.pdf"), ("a+b 1.zip", "p.pdf")]
    wanted = spark.createDataFrame([(str(i), a, m) for i, (a, m) in enumerate(ask)], "case_id string, archive string, member string")
    # Spark's own reader leaves files of no bytes out
    files = pages.read_files(spark, str(tmp_path), "*.zip")
    got = {int(r.case_id): (None if r.content is None else bytes(r.content), r.failure_code) for r in archives.zip_members(files, wanted).collect()}
    assert got == {
        0: (b"two", None), 1: (b"one", None), 2: (b"", None), 3: (None, "member_missing"), 4: (None, "member_unreadable"), 5: (b"one", None),
        6: (None, "archive_missing"), 7: (None, "archive_missing"), 8: (b"two", None),
    }
    direct = spark.createDataFrame([("1", "no.zip", str(tmp_path / "no.zip"), "a"), ("2", "q", str(tmp_path / "q"), "a")], "case_id string, archive string, _path string, member string")
    assert {r.case_id: r.failure_code for r in archives.members(direct).collect()} == {"1": "archive_unreadable", "2": "archive_missing"}
    assert archives.zip_members(files, wanted.where("false")).count() == 0


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_ranges_of_pages_give_the_pages(spark, tmp_path, monkeypatch, block):
    texts = {"a": "one\f \fthree 世界\f\f five\f", "b": "\f\f", "c": "x" * 1000, "d": "\f".join(map(str, range(100)))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    monkeypatch.setattr(archives, "BLOCK", block)
    for name, text in texts.items():
        content = text.encode()
        for width in (1, 2, 7, 64):
            found = list(archives._ranges(str(tmp_path / f"{name}.txt"), width))
            assert [p for r in found for p in content[r[3] : r[4]].decode().split("\f")] == text.split("\f")
            assert found[0][5] == text.count("\f") + 1 and [r[1] for r in found[1:]] == [r[2] + 1 for r in found[:-1]]


def test_ranged_pages_and_inspection_agree_with_whole_documents(spark, tmp_path):
    contents = {"a": "one\f \fthree 世界\f\f five\f".encode(), "b": b"\f \f", "d": "\f".join(map(str, range(100))).encode(), "e": b"good\f\xff\xfe\fgood"}
    for name, content in contents.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    (tmp_path / "z.txt").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.txt"),) for n in [*contents, "z", "gone", "a"]] + [(None,)], "path string")
    index = archives.page_index(paths, width=3).cache()
    key = lambda r: (r.document_id, r.page, r.text, r.error_code)
    got = {key(r) for r in archives.ranged_pages(index).collect()}
    whole = pages.pages(pages.read_files(spark, str(tmp_path)).where(~F.col("path").endswith("e.txt")))
    extra = {("e", 1, "good", None), ("e", 2, None, "page_parse_failure"), ("e", 3, "good", None), ("z", None, None, "empty_pdf"), ("gone", None, None, "file_not_found")}
    assert got == {key(r) for r in whole.collect()} | extra
    few = archives.ranged_pages(index.where("first <= 50 and last >= 50")).where("document_id = 'd' and error_code is null")
    assert sorted(r.page for r in few.collect()) == [49, 50, 51]
    told = {r.document_id: (r.page_count, r.is_text, r.parser_status) for r in archives.inspect_index(index).collect()}
    assert told == {"a": (6, True, "not_run"), "b": (3, False, "not_run"), "d": (100, True, "not_run"), "e": (3, True, "not_run"), "z": (0, False, "pdf_metadata_failed"), "gone": (0, False, "pdf_metadata_failed")}


def test_sampled_pages_alone_are_decoded(spark):
    asked = archives.page_sample(F.lit(1000)).alias("p")
    assert spark.range(1).select(asked).first().p == [0, 250, 500, 750, 999]


def test_a_long_sheet_is_read_row_by_row(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("code"), F.when(F.col("id") % 2 == 0, F.lit("a<&>")).alias("note"))
    written = tables.write_sheets(rows.repartition(3), str(tmp_path / "w"), "S & T").cache()
    assert written.agg(F.sum("rows")).first()[0] == 30_000
    back = tables.sheets(written, "S & T", ["note", "code"])
    assert back.count() == 30_000 and {tuple(r) for r in back.where("code < 2").collect()} == {("a<&>", "0"), ("", "1")}
    assert tables.read_sheet(spark, str(tmp_path / "w"), "S & T", ["code"]).distinct().count() == 30_000


def test_memory_of_a_sheet_is_bounded():
    ns, data = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>text {i} é</t></si>' for i in range(1000))}</sst>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row><c t="s"><v>{i % 1000}</v></c><c><v>{i}</v></c></row>' for i in range(60_000))}</sheetData></worksheet>")
    tracemalloc.start()
    n = sum(row == [f"text {i % 1000} é", str(i)] for i, row in enumerate(tables.sheet_rows(data.getvalue(), "S")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 8 << 20
