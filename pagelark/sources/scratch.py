"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that spark.checkpoint.dir names.

    A local session may leave it unset, and then a temporary folder of this machine does; on a cluster that would lose
    data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagelark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pagelark-{uuid.uuid4().hex}"


class Workspace:
    """Writes the outcome of a stage and reads it back.

    That cuts lineage, so a lost executor costs no more than a stage, and keeps each plan small enough for the optimiser:
    stages here are wide expression trees, which would otherwise be inlined into one another.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_folder(spark)
        self.count = 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(kept)] = (kept, path)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete the files of frames that keep gave; nothing may read them any more."""
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            if entry := self.kept.pop(id(df), None):
                place = jvm.org.apache.hadoop.fs.Path(entry[1])
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
