"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cutting import cut, shared_folder

__all__ = ["SPACE", "cut", "pick", "release", "shared_folder", "shuffle_parts", "table", "trim"]

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact case; other columns, whatever their names, are left behind."""
    have = df.columns
    at = [have.index(n) for n in names]
    low = [c.lower() for c in have]
    if any(low.count(n.lower()) > 1 for n in names):
        df = df.toDF(*[f"_c{i}" for i in range(len(have))])
        return df.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])
    return df.select(*[F.col(f"`{n}`") for n in names])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that this worker has freed back to the system: workers serve later stages too, beside an executor's heap that has grown."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more, such as those before a cut: it learns of them when the
    driver's memory is collected, which by itself may be long after an iterative plan has written all its rounds."""
    spark._jvm.System.gc()
