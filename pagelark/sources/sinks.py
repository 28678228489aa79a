"""Writers: results as JSON, catalogs as CSV, short reports as Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results(results: DataFrame, path: str, key: str = "analysis_id") -> None:
    """Results as JSON, one folder for each id, so that one is found without reading the others."""
    results.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def read_result(spark: SparkSession, path: str, analysis_id: str, schema) -> DataFrame:
    """The stored result of an id, from its folder alone; no rows if there is none."""
    with_key = f"{schema}, _key string" if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField("_key", T.StringType())])
    return spark.read.schema(with_key).json(path).where(F.col("_key") == analysis_id).drop("_key")


def payload(results: DataFrame, fields: Sequence[str], key: str = "analysis_id") -> DataFrame:
    """key and payload: the fields, in order, as one JSON text; missing ones are null in it."""
    have = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return results.select(key, F.to_json(F.struct(*have), {"ignoreNullFields": "false"}).alias("payload"))


def redacted(context: Column, hidden: Sequence[str] = ("path", "prospectus_path")) -> Column:
    """A map without the entries that tell where files lie."""
    return F.map_filter(context, lambda k, _: ~k.isin(*hidden))


def differences(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeats counted; columns that sets can't compare are compared as JSON."""
    plain = lambda df: df.select(F.to_json(F.struct(*sorted(df.columns))).alias("row"))
    a, b = plain(written), plain(read)
    return a.exceptAll(b).withColumn("side", F.lit("written_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("read_only")))


def save_outcomes(results: DataFrame, read: DataFrame, key: str = "analysis_id", status: str = "status") -> DataFrame:
    """key, status and save_error of each result after it was read back: one that came back otherwise, or not at all, is
    partial with save_failure; the others keep their status. Compared as JSON, one row an id; a null key never comes back."""
    text = lambda df, name: df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias(name))
    back = text(read, "_read").groupBy(key).agg(F.min("_read").alias("_read"), F.max("_read").alias("_other"))
    both = results.select(key, status, F.to_json(F.struct(*sorted(results.columns))).alias("_written")).join(back, key, "left")
    same = F.col("_written").eqNullSafe(F.col("_read")) & F.col("_written").eqNullSafe(F.col("_other"))
    return both.select(key, F.when(same, F.col(status)).otherwise("partial").alias(status), F.when(~same, "save_failure").alias("save_error"))


def write_catalog(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """A catalog as UTF-8 CSV files with byte-order mark and header: fixed columns, missing ones and nulls blank, rows
    ranged by the order."""
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    # the mark stands before the first name of each file's header
    marked = df.orderBy(*order).select(*have).toDF("\ufeff" + columns[0], *columns[1:])
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def overview(title: str, counts: Sequence[Row], issues: Sequence[Row]) -> str:
    """Markdown of collected aggregates: a table of groups and one of issue codes."""
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]
    out = [f"# {title}", ""]
    if counts:
        out += [*table(counts[0].__fields__, counts), ""]
    if issues:
        out += ["## Issues", "", *table(issues[0].__fields__, issues), ""]
    return "\n".join(out)
