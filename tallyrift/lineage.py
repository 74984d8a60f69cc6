"""Tables that an iterative operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder where the session names none; only local sessions (tests) use it.
LOCAL_FOLDER = "/tmp/checkpoints/tallyrift"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, whose executors are the driver, may go without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written in place of a long lineage; a lost executor loses none of them.

    ``keep`` writes and reads again, ``forget`` deletes what nothing reads any more. As a context it deletes everything
    after an error; what the result reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.paths)}"
        self.paths[path] = True
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def forget(self, *tables: DataFrame) -> None:
        for df in tables:
            if self.paths.get(df.kept_at):
                delete(self.spark, df.kept_at)
                self.paths[df.kept_at] = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            delete(self.spark, self.folder)
