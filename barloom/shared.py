"""Tables in the folder that all machines share: lineage ends there, and a lost executor costs a read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a local master gets a folder of its own, removed at exit, and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="barloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


class Scratch:
    """Written tables of one run. Those that its result doesn't read go when the run ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for df in list(self.paths):
            self.drop(df)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/barloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        del self.paths[df]
        return df

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(df))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
