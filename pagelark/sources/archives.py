"""Archives and long documents read in parts: tasks open a file, seek, and read what is asked for.

An archive's directory stands at its end, so a task that is asked for some members reads that and them, whatever else the
archive holds. A long document is first indexed, in blocks of bounded size, into ranges of pages with their place in the
file; ranges are rows, so that many tasks share one document, and a filter on the index decides what is read at all.

Paths are those that Arrow's file systems know (local ones, S3, HDFS).
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import INSPECTED, PAGES, page_sample
from .stored import place_of

#: Bytes that are read, or held before they are passed on, at once.
BLOCK = 4 << 20
MEMBERS = "case_id string, archive string, member string, content binary, failure_code string"
INDEX = "path string, first int, last int, start long, end long, page_count int, blank boolean, error_code string, error string"


def _opened(path: str) -> BinaryIO:
    system, place = place_of(path)
    return system.open_input_file(place)


def _names(source: zipfile.ZipFile) -> dict[str, str]:
    """Members by their last part and by their whole name, which goes first."""
    whole = source.namelist()
    return {PurePosixPath(n).name: n for n in whole} | {n: n for n in whole}


class _Archives:
    """The archive that was asked for last stays open, as rows come sorted by archive."""

    def __init__(self):
        self.path, self.file, self.zip, self.names, self.failure = None, None, None, {}, None

    def _turn_to(self, path: str) -> None:
        self.close()
        self.path, self.names, self.failure = path, {}, None
        try:
            self.file = _opened(path)
            self.zip = zipfile.ZipFile(self.file)
            self.names = _names(self.zip)
        except FileNotFoundError:
            self.failure = "archive_missing"
        except (zipfile.BadZipFile, OSError, ValueError):
            self.failure = "archive_unreadable"

    def member(self, path: str | None, name: str | None) -> tuple[bytes | None, str | None]:
        if path is None:
            return None, "archive_missing"
        if path != self.path:
            self._turn_to(path)
        if self.failure or name not in self.names:
            return None, self.failure or "member_missing"
        try:
            return self.zip.read(self.names[name]), None
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError):
            return None, "member_unreadable"

    def close(self) -> None:
        for held in (self.zip, self.file):
            if held is not None:
                held.close()
        self.file = self.zip = None


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [f.split()[0] for f in MEMBERS.split(", ")]
    archives, out, held = _Archives(), [], 0
    try:
        for batch in batches:
            for case, archive, path, member in batch[["case_id", "archive", "_path", "member"]].itertuples(index=False, name=None):
                content, failure = archives.member(path, member)
                out.append((case, archive, member, content, failure))
                held += len(content or b"")
                if held > BLOCK or len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        yield pd.DataFrame(out, columns=columns)
    finally:
        archives.close()


def members(wanted: DataFrame) -> DataFrame:
    """content of the wanted members: case_id, archive, member, content, failure_code; wanted has case_id, archive, member
    and _path, where the archive lies.

    Rows are ranged by archive and member, so an archive that holds most of them is read by many tasks, and each task reads
    the directory of an archive once. A failure (archive_missing, archive_unreadable, member_missing, member_unreadable)
    is that row's alone. A null path is a missing archive, a null member a missing one; repeated rows are answered alike.
    """
    ranged = wanted.select("case_id", "archive", "_path", "member").repartitionByRange("_path", "member").sortWithinPartitions("_path", "member")
    return ranged.mapInPandas(_read_members, MEMBERS)


def zip_members(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """members() of archives that are told by their file name; archives has path (its content isn't read), wanted case_id,
    archive and member. A name without a file is archive_missing."""
    named = archives.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("_path"))
    return members(wanted.select("case_id", "archive", "member").join(named, "archive", "left"))


def write_archives(items: DataFrame, folder: str) -> DataFrame:
    """One archive for each task, of items' rows (case_id, content); returns case_id, archive, member and _path.

    Names are new with each attempt of a task, so one that is run again leaves an archive that nothing names. Keep the
    result as a table before it is read twice.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place_of(folder)
        name = f"{uuid.uuid4().hex}.zip"
        path = f"{folder.rstrip('/')}/{name}"
        system.create_dir(root, recursive=True)
        rows: list[tuple] = []
        with system.open_output_stream(f"{root}/{name}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for case, content in zip(batch["case_id"], batch["content"]):
                    member = f"{len(rows):09d}.txt"
                    z.writestr(member, b"" if content is None else content)
                    rows.append((case, name, member, path))
        yield pd.DataFrame(rows, columns=["case_id", "archive", "member", "_path"])

    return items.select(F.col("case_id").cast("string").alias("case_id"), "content").mapInPandas(written, "case_id string, archive string, member string, _path string")


def write_volumes(items: DataFrame, folder: str) -> DataFrame:
    """One document for each task, whose pages, ended by form feeds, are items' rows (case_id, content); returns case_id,
    path and page. Contents must hold no form feed. Names are as those of write_archives."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place_of(folder)
        name = f"{uuid.uuid4().hex}.txt"
        system.create_dir(root, recursive=True)
        rows: list[tuple] = []
        with system.open_output_stream(f"{root}/{name}") as file:
            for batch in batches:
                for case, content in zip(batch["case_id"], batch["content"]):
                    file.write((b"\f" if rows else b"") + (content or b""))
                    rows.append((case, f"{folder.rstrip('/')}/{name}", len(rows) + 1))
        yield pd.DataFrame(rows, columns=["case_id", "path", "page"]).astype({"page": "int32"})

    return items.select(F.col("case_id").cast("string").alias("case_id"), "content").mapInPandas(written, "case_id string, path string, page int")


def _ranges(path: str, width: int) -> Iterator[tuple]:
    """Ranges of width pages of a form-feed text, read in blocks."""
    starts, pages, size, blank = [0], 1, 0, True
    with _opened(path) as file:
        while block := file.read(BLOCK):
            at = block.find(b"\f")
            while at >= 0:
                if pages % width == 0:
                    starts.append(size + at + 1)
                pages += 1
                at = block.find(b"\f", at + 1)
            blank = blank and not block.strip(b" \t\r\n\v\f")
            size += len(block)
    if not size:
        yield path, None, None, None, None, 0, True, "empty_pdf", "the file is empty"
        return
    for i, start in enumerate(starts):
        last = min((i + 1) * width, pages)
        # the form feed that ends the range's last page isn't part of it
        yield path, i * width + 1, last, start, (starts[i + 1] - 1 if last < pages else size), pages, blank, None, None


def page_index(paths: DataFrame, width: int = 64) -> DataFrame:
    """Ranges of at most width pages of each document (form-feed text): path, first and last page, start and end byte,
    page_count, whether the whole document is blank; or error_code and error of one that can't be opened.

    Repeated paths are one document, null paths none.
    """

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                try:
                    rows = list(_ranges(path, width))
                except FileNotFoundError as e:
                    rows = [(path, None, None, None, None, 0, None, "file_not_found", str(e))]
                except OSError as e:
                    rows = [(path, None, None, None, None, 0, None, "pdf_open_failure", str(e))]
                yield pd.DataFrame(rows, columns=columns).astype({"first": "Int32", "last": "Int32", "start": "Int64", "end": "Int64", "page_count": "Int32", "blank": "boolean"})

    return paths.where("path is not null").select("path").distinct().mapInPandas(indexed, INDEX)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the pages of each range; only the pages in _asked are decoded, if that isn't null."""
    for batch in batches:
        for path, first, last, start, end, asked in batch[["path", "first", "last", "start", "end", "_asked"]].itertuples(index=False, name=None):
            with _opened(path) as file:
                file.seek(int(start))
                parts = file.read(int(end) - int(start)).split(b"\f")
            rows = []
            for page in range(int(first), int(last) + 1) if asked is None else map(int, asked):
                try:
                    rows.append((path, page, parts[page - int(first)].decode("utf-8").strip(), None))
                except UnicodeDecodeError as e:
                    rows.append((path, page, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "int32"})


def _texts(index: DataFrame, asked: Column) -> DataFrame:
    some = index.where("first is not null").withColumn("_asked", asked).where("_asked is null or size(_asked) > 0")
    # ranges of one document would else stay in the task that indexed it
    dealt = some.select("path", "first", "last", "start", "end", "_asked").repartition("path", "first")
    return dealt.mapInPandas(_decoded, "path string, page int, text string, error string")


def ranged_pages(index: DataFrame, asked: Column | None = None) -> DataFrame:
    """Rows as those of pages.pages, for the pages of an index; asked (an array of pages of the range, null for all of them)
    narrows what is decoded.

    A page that isn't UTF-8 fails alone and is recoverable. Blank pages have no row; a blank or unreadable document has one
    with its error.
    """
    everything = F.lit(None).cast("array<int>")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    chunk = F.concat(name, F.lit(":page:"), F.col("page").cast("string"))
    good = F.col("error").isNull()
    read = _texts(index, everything if asked is None else asked).where(~good | (F.col("text") != "")).select(
        name.alias("document_id"), chunk.alias("chunk_id"), "page", F.when(good, "unknown").alias("section"), "text", F.when(good, "page_text").alias("block_type"),
        F.when(~good, "page_parse_failure").alias("error_code"), "error", F.when(~good, F.lit(True)).alias("recoverable"),
    )
    empty = F.col("error_code").isNotNull() | (F.col("blank") & (F.col("first") == 1))
    said = {"document_id": name, "error_code": F.coalesce("error_code", F.lit("empty_pdf")), "error": F.coalesce("error", F.lit("the document has no text")), "recoverable": F.lit(False)}
    fatal = index.where(empty).select(*[said.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in PAGES.split(", "))])
    return read.unionByName(fatal)


def inspect_index(index: DataFrame) -> DataFrame:
    """pages.inspect of indexed documents: of each only the ranges that hold a sampled page are read, and of these only the
    sampled pages, five at most, are decoded."""
    sampled = F.transform(page_sample(F.col("page_count")), lambda p: (p + 1).cast("int"))
    texts = _texts(index, F.filter(sampled, lambda p: p.between(F.col("first"), F.col("last"))))
    seen = texts.groupBy("path").agg(F.max(F.coalesce(F.col("text"), F.lit("")) != "").alias("_seen"))
    known = index.where("first = 1 or error_code is not null")
    bad = F.col("error_code").isNotNull()
    told = {
        "document_id": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "is_text": ~bad & F.coalesce("_seen", F.lit(False)), "parser_status": F.when(bad, "pdf_metadata_failed").otherwise("not_run"),
        "error_count": bad.cast("long"), "parser_message": F.when(bad, F.concat_ws(": ", "error_code", "error")).otherwise(""),
    }
    return known.join(seen, "path", "left").select(*[told.get(n, F.col(n)).cast(t).alias(n) for n, t in (f.split() for f in INSPECTED.split(", "))])
