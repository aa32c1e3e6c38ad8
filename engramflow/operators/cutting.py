"""Cutting the lineage of iterative plans into the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, whose executors see the driver's disk, may do without the setting."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    have = context._jsc.sc().getCheckpointDir()
    if not have.isEmpty():
        return have.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="engramflow-")


#: Since Spark 4.1: whether the shuffle files of a plan are removed at its end. Else they stay until the driver's heap is collected, which it may not be before a query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Plans that are made and run meanwhile leave no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with swept(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written by column into the shared folder: for wide rows of which several plans read some columns each. Their size is known, so small ones are broadcast.
    Columns are packed, rows of a checkpoint are not."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Removes the files of frames from stored(), once nothing that is still to be worked out reads them."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("rows-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def together(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both in no more partitions than a shuffle has: in a loop, a union of unions would have more of them, and more tasks, each round."""
    return a.unionByName(b).coalesce(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
