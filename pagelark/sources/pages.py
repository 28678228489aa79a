"""Documents to pages.

Files come through Spark's binary reader, so any store that Spark reads will do, and pages are decoded in tasks. How bytes
become page texts is a decoder's business: a plain one splits text at form feeds; decoders for other formats are passed
in. Bad input gives rows with an error code, never an exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of the pages in order; raises PageError for what it can't read. A page that can't be read is None.
Decoder = Callable[[bytes], list[str | None]]

PAGES = "document_id string, chunk_id string, page int, section string, text string, block_type string, error_code string, error string, recoverable boolean"


class PageError(Exception):
    """A document that can't be decoded; code is one of non_pdf_file, pdf_open_failure, encrypted_pdf, empty_pdf."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def form_feed_pages(content: bytes) -> list[str | None]:
    """Pages of a UTF-8 text, split at form feeds."""
    try:
        return list(content.decode("utf-8").split("\f"))
    except UnicodeDecodeError as e:
        raise PageError("pdf_open_failure", str(e)) from None


def pdf_pages(content: bytes) -> list[str | None]:
    """Pages of a PDF through whichever reader is installed."""
    if not content.startswith(b"%PDF-"):
        raise PageError("non_pdf_file")
    try:
        import fitz
    except ImportError:
        raise PageError("pdf_open_failure", "no PDF reader is installed; pass a decoder") from None
    try:
        document = fitz.open(stream=content, filetype="pdf")
    except Exception as e:
        raise PageError("pdf_open_failure", str(e)) from None
    if document.needs_pass:
        raise PageError("encrypted_pdf")
    out: list[str | None] = []
    for i in range(document.page_count):
        try:
            out.append(document.load_page(i).get_text("text"))
        except Exception:
            out.append(None)
    return out


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def _rows(document: str, content: bytes | None, decoder: Decoder) -> Iterator[tuple]:
    fatal = lambda code, message: (document, None, None, None, None, None, code, message, False)
    if not content:
        yield fatal("empty_pdf", "the file is empty")
        return
    try:
        pages = decoder(content)
    except PageError as e:
        yield fatal(e.code, str(e))
        return
    if not pages:
        yield fatal("empty_pdf", "the document has no pages")
        return
    failed = any(p is None for p in pages)
    if not failed and not any(p.strip() for p in pages):
        yield fatal("empty_pdf", "the document has no text")
        return
    for i, text in enumerate(pages, 1):
        if text is None:
            yield document, f"{document}:page:{i}", i, None, None, None, "page_parse_failure", f"page {i}", True
        elif text.strip():
            yield document, f"{document}:page:{i}", i, "unknown", text.strip(), "page_text", None, None, None


def pages(files: DataFrame, decoder: Decoder = form_feed_pages, document_id: Column | None = None) -> DataFrame:
    """A row for each non-blank page, numbered from 1, and one for each error; error_code is null on pages.

    document_id: by default the file's name without its suffix.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1) if document_id is None else document_id
    names = [f.split()[0] for f in PAGES.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, c in zip(batch["document_id"], batch["content"]) for r in _rows(d, c, decoder)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page": "Int32", "recoverable": "boolean"})

    return files.select(name.alias("document_id"), "content").mapInPandas(decode, PAGES)


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Error rows, shaped as those of pages, for the paths of wanted that no file has: not_a_file where files lie below
    the path, else file_not_found. Both sides have path; a null path is file_not_found."""
    asked = wanted.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct()
    have = files.select(F.col("path").alias("_file")).distinct()
    # every folder above a file, so that folders are found by an equality join
    parts = F.split("_file", "/")
    above = have.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_folder")).distinct()
    lacking = asked.join(have, F.col("path") == F.col("_file"), "left_anti").join(above, F.col("path") == F.col("_folder"), "left")
    code = F.when(F.col("_folder").isNotNull(), "not_a_file").otherwise("file_not_found")
    values = {"document_id": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "error_code": code, "error": F.col("path"), "recoverable": F.lit(False)}
    return lacking.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in PAGES.split(", "))])


class FormFeeds:
    """Pages of a UTF-8 text by their places; only the pages that are asked for are decoded."""

    def __init__(self, content: bytes):
        self.content, self.edges = content, [-1, *(m.start() for m in re.finditer(b"\f", content)), len(content)]

    def __len__(self) -> int:
        return len(self.edges) - 1

    def __getitem__(self, i: int) -> str:
        try:
            return self.content[self.edges[i] + 1 : self.edges[i + 1]].decode("utf-8")
        except UnicodeDecodeError as e:
            raise PageError("pdf_open_failure", str(e)) from None


def sampled_places(count: int) -> list[int]:
    """Places, from 0, of the pages that stand for a document: first, quarters, last."""
    return sorted({0, count // 4, count // 2, count * 3 // 4, count - 1}) if count > 0 else []


INSPECTED = "document_id string, page_count int, is_text boolean, parser_status string, error_count long, parser_message string"


def inspect(files: DataFrame, opened: Callable[[bytes], Sequence[str | None]] = FormFeeds, document_id: Column | None = None) -> DataFrame:
    """A row for each file (path, content): page_count, is_text, parser_status, error_count, parser_message.

    opened gives a document's pages by place and their number; at most five pages of a document are decoded. Blank pages
    count. A sampled page that can't be decoded holds no text; an empty or unreadable file, or one without pages, is
    pdf_metadata_failed with no pages.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1) if document_id is None else document_id

    def looked_at(content: bytes | None) -> tuple:
        try:
            if not content:
                raise PageError("empty_pdf", "the file is empty")
            found = opened(content)
            if not len(found):
                raise PageError("empty_pdf", "the document has no pages")
        except PageError as e:
            return 0, False, "pdf_metadata_failed", 1, f"{e.code}: {e}"
        text = False
        for i in sampled_places(len(found)):
            try:
                text = text or bool((found[i] or "").strip())
            except PageError:
                continue
        return len(found), text, "not_run", 0, ""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *looked_at(c)) for d, c in zip(batch["document_id"], batch["content"])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in INSPECTED.split(", ")])

    return files.select(name.alias("document_id"), "content").mapInPandas(decode, INSPECTED)


def inspected(decoded: DataFrame, document: str = "document_id", counts: DataFrame | None = None) -> DataFrame:
    """A row for each document of pages(): page_count, is_text, parser_status, error_count, parser_message.

    Whether a document holds text is read from its sampled pages alone. Blank pages have no row in pages(), so counts
    (the document and its page_count) tells how many there are; without it the last page known stands for the count, and
    documents that end in blank pages are better looked at by `inspect`. A fatal error gives pdf_metadata_failed, except
    that of a counted document without text.
    """
    fatal = F.col("error_code").isNotNull() & ~F.coalesce("recoverable", F.lit(False))
    known = F.lit(None).cast("int")
    if counts is not None:
        decoded = decoded.join(counts.select(document, F.col("page_count").cast("int").alias("_known")), document, "left")
        known = F.col("_known")
        # a counted document without text is blank, not broken
        fatal = fatal & ~((F.col("error_code") == "empty_pdf") & (F.coalesce(known, F.lit(0)) > 0))
    counts_of = decoded.groupBy(document).agg(
        F.coalesce(F.max(known), F.max("page"), F.lit(0)).alias("page_count"), F.count_if(fatal).alias("error_count"), F.min(F.when(fatal, F.concat_ws(": ", "error_code", "error"))).alias("_message"),
        F.collect_set(F.when(F.col("text").isNotNull(), F.col("page") - 1)).alias("_texts"),
    )
    sampled = F.coalesce(F.arrays_overlap(page_sample(F.col("page_count")), F.transform("_texts", lambda p: p.cast("bigint"))), F.lit(False))
    failed = F.col("error_count") > 0
    return counts_of.select(
        document, F.when(failed, 0).otherwise(F.col("page_count")).alias("page_count"), (~failed & sampled).alias("is_text"),
        F.when(failed, "pdf_metadata_failed").otherwise("not_run").alias("parser_status"), "error_count", F.coalesce("_message", F.lit("")).alias("parser_message"),
    )


def page_sample(count: Column) -> Column:
    """Places, from 0, of the pages that stand for a document: first, quarters, last."""
    return F.when(count > 0, F.array_sort(F.array_distinct(F.array(F.lit(0).cast("bigint"), F.floor(count / 4), F.floor(count / 2), F.floor(count * 3 / 4), (count - 1).cast("bigint")))))


def zip_members(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """content of the wanted members; archives has path, wanted case_id, archive and member.

    A missing archive or member gives a failure_code instead. See archives.members for how they are read.
    """
    from . import archives as reader  # that module builds on this one

    return reader.zip_members(archives, wanted)


def file_facts(files: DataFrame) -> DataFrame:
    """path, file_size_bytes and sha256."""
    return files.select("path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"))


FILE_NAME = r"^(\d{5})_(\d{2}-\d{2}-\d{4})_(.+)_([^_]+)\.pdf$"
YEAR_FOLDER = r"(20\d{2})_(\d+)份/[^/]+$"


def discover(files: DataFrame) -> DataFrame:
    """Cases of files in year folders: case_id, source_year, source_filename, stock_code_raw, disclosure_date,
    company_short_name, offering_type, name_issue (null where the name is as it should be). Others are left out."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, FILE_NAME, i)
    decoded = files.withColumn("path", F.url_decode(F.regexp_replace("path", r"\+", "%2B")))
    year = F.regexp_extract("path", YEAR_FOLDER, 1)
    return decoded.where(F.col("path").rlike(YEAR_FOLDER) & F.lower("path").endswith(".pdf")).select(
        F.concat_ws("_", F.lit("ipo"), year, part(1)).alias("case_id"),
        year.cast("int").alias("source_year"),
        name.alias("source_filename"),
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("relative_path"),
        part(1).alias("stock_code_raw"),
        F.try_to_date(part(2), "dd-MM-yyyy").cast("string").alias("disclosure_date"),
        part(3).alias("company_short_name"),
        part(4).alias("offering_type"),
        F.when(~name.rlike(FILE_NAME), "unexpected_prospectus_filename").alias("name_issue"),
    )


def repeated_cases(cases: DataFrame) -> DataFrame:
    """case_id and n of discovered cases that occur more than once; there should be none."""
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mock_pages(spark: SparkSession, document: str = "mock") -> DataFrame:
    """Three fixed pages for trials without documents."""
    rows = [(document, f"{document}:page:{n}", n, "unknown", t, "page_text") for n, t in ((12, "revenue and loss for the year"), (48, "redemption rights of investors"), (76, "product pipeline before approval"))]
    return spark.createDataFrame(rows, "document_id string, chunk_id string, page int, section string, text string, block_type string")
