"""Stored results: a data source that writes in transactions, reads back what it wrote, and finds one id in one file.

A write stages Parquet files in a folder of its own. Each task reads its file back, row by row, and compares digests with
those of the rows it was given; then a commit lists the files with their least and greatest ids, and only listed files
exist for readers. The list appears by a rename, so a reader sees all of a write or nothing; what a failed write has staged
is deleted. Rows come ranged by id, so a lookup opens the one file of each write whose range holds the id, and the number
of files follows from the number of partitions, not of ids.

Paths are those that Arrow's file systems know (local ones, S3, HDFS). `fault_modulus` is for trials: rows whose id it
divides are spoiled on their way to the file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "stored_results"
STORED = "id string, body string, digest string, version long"

#: Rows of a batch on their way to and from a file; bounds the memory of a task.
BATCH = 2000


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest_of(key: str | None, body: str | None) -> str:
    return hashlib.sha256(json.dumps([key, body]).encode()).hexdigest()


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int
    least: str
    greatest: str


@dataclass
class Part(InputPartition):
    file: str
    version: int


def commits(path: str) -> list[dict]:
    """The lists of all committed writes, the oldest first."""
    system, root = place_of(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    read = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                read.append(json.loads(f.read()))
    return read


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.fault = int(options.get("fault_modulus", 0))

    def _batches(self, rows: Iterator) -> Iterator[list[tuple[str, str, str]]]:
        held = []
        for row in rows:
            held.append((row["id"], row["body"], digest_of(row["id"], row["body"])))
            if len(held) >= BATCH:
                yield held
                held = []
        if held:
            yield held

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = place_of(self.path)
        folder, name = f"{root}/jobs/{self.job}", uuid.uuid4().hex
        system.create_dir(folder, recursive=True)
        file, asked, least, greatest, rows = f"{folder}/{name}.parquet", f"{folder}/{name}.asked", None, None, 0
        schema = pa.schema([("id", pa.string()), ("body", pa.string()), ("digest", pa.string())])
        with system.open_output_stream(file) as out, pq.ParquetWriter(out, schema) as writer, system.open_output_stream(asked) as wanted:
            for batch in self._batches(iterator):
                ids = [r[0] for r in batch]
                least, greatest = min([*ids, least] if least is not None else ids), max([*ids, greatest] if greatest is not None else ids)
                rows += len(batch)
                bodies = [f"{b} " if self.fault and i.isdigit() and int(i) % self.fault == 0 else b for i, b, _ in batch]
                writer.write_batch(pa.record_batch([pa.array(ids, pa.string()), pa.array(bodies, pa.string()), pa.array([r[2] for r in batch])], schema=schema))
                wanted.write("".join(f"{r[2]}\n" for r in batch).encode())
        if not rows:
            return Staged("", 0, "", "")
        self._read_back(system, file, asked)
        return Staged(file, rows, least, greatest)

    @staticmethod
    def _read_back(system: fs.FileSystem, file: str, asked: str) -> None:
        """Writes, beside the file, whether each of its rows came back as it was given."""
        schema = pa.schema([("id", pa.string()), ("saved", pa.bool_())])
        with system.open_input_file(file) as f, system.open_input_stream(asked) as wanted, system.open_output_stream(f"{file}.outcome") as out, pq.ParquetWriter(out, schema) as writer:
            for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=["id", "body"]):
                ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                digests = wanted.read(65 * len(ids)).decode().split("\n")
                writer.write_batch(pa.record_batch([pa.array(ids, pa.string()), pa.array([digest_of(i, b) == d for i, b, d in zip(ids, bodies, digests)])], schema=schema))

    def commit(self, messages: list) -> None:
        system, root = place_of(self.path)
        files = [{"file": m.file, "rows": m.rows, "least": m.least, "greatest": m.greatest} for m in messages if m and m.rows]
        version = 1 + max((c["version"] for c in commits(self.path)), default=0)
        system.create_dir(f"{root}/commits", recursive=True)
        staged = f"{root}/commits/.{self.job}"
        with system.open_output_stream(staged) as out:
            out.write(json.dumps({"version": version, "job": self.job, "files": files}).encode())
        system.move(staged, f"{root}/commits/{version:012d}-{self.job}.json")

    def abort(self, messages: list) -> None:
        system, root = place_of(self.path)
        if system.get_file_info(f"{root}/jobs/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/jobs/{self.job}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.only, self.outcomes = options["path"], options.get("only"), options.get("outcomes") == "true"

    def partitions(self) -> list[InputPartition]:
        held = lambda f: self.only is None or f["least"] <= self.only <= f["greatest"]
        return [Part(f["file"], c["version"]) for c in commits(self.path) for f in c["files"] if held(f)] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        system, _ = place_of(self.path)
        with system.open_input_file(partition.file + (".outcome" if self.outcomes else "")) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (self.only is None or row[0] == self.only) and (self.outcomes or digest_of(row[0], row[1]) == row[2]):
                        yield (*row, partition.version)


class StoredResults(DataSource):
    """id, body (JSON), digest and version of each row of all committed writes; with outcomes=true id, saved and version."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id string, saved boolean, version long" if self.options.get("outcomes") == "true" else STORED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("stored results are only added to; a later write of an id replaces an earlier one")
        return _Writer(self.options)


def save(results: DataFrame, path: str, key: str = "analysis_id", parts: int | None = None, fault_modulus: int = 0) -> None:
    """Add results as one write, ranged by id. Rows with a null id can't be found again and are refused."""
    spark = results.sparkSession
    spark.dataSource.register(StoredResults)
    known = F.when(F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.raise_error(F.lit("a result without an id")))
    rows = results.select(known.alias("id"), F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("body"))
    ranged = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    ranged.write.format(NAME).option("path", path).option("fault_modulus", fault_modulus).mode("append").save()


def _source(spark: SparkSession, path: str, **options: str):
    spark.dataSource.register(StoredResults)
    return spark.read.format(NAME).options(path=path, **options).load()


def outcomes(spark: SparkSession, path: str, results: DataFrame, key: str = "analysis_id", status: str = "status") -> DataFrame:
    """key, status and save_error of results after the last write of each: one that didn't come back as it was is partial
    with save_failure, as is one that was never written; the others keep their status."""
    last = _source(spark, path, outcomes="true").groupBy("id").agg(F.max_by("saved", "version").alias("saved"))
    both = results.select(key, status, F.col(key).cast("string").alias("id")).join(last, "id", "left")
    saved = F.coalesce("saved", F.lit(False))
    return both.select(key, F.when(saved, F.col(status)).otherwise("partial").alias(status), F.when(~saved, "save_failure").alias("save_error"))


def stored(spark: SparkSession, path: str, schema: str, only: str | None = None) -> DataFrame:
    """The last stored row of each id, or of one id; rows whose body isn't what its digest says are left out."""
    rows = _source(spark, path, **({"only": only} if only is not None else {}))
    last = rows.groupBy("id").agg(F.max_by("body", "version").alias("body"))
    return last.select(F.from_json("body", schema).alias("r")).select("r.*")

